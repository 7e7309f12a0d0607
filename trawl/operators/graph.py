"""Link graphs: PageRank, HITS, metrics, label propagation, modularity, paths.

Graphs are edge tables (src, dst, weight). Iterations are joins and aggregates; every few rounds the
ranks are cut off from their lineage by a table in the shared folder, which survives lost executors. Edges
are partitioned by source once and keep that partitioning over all rounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    A checkpoint would keep the estimated sizes of the plan it cuts off; where a round joins two
    tables made of the last one's, these square every round, to numbers of millions of digits.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in the shared folder, which keeps its partitioning."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, eps: float = 1e-6, teleport: DataFrame | None = None, normalised: bool = False, every: int = 5) -> DataFrame:
    """(id, rank) of the last round, or of the first that moves less than ``eps`` in all.

    A vertex gives rank * weight / (number of its links), or with ``normalised`` / (sum of their
    weights). ``teleport`` (id, bias) makes it personalised or topic-sensitive; biases are scaled
    to 1. Rank that reaches vertices without links is dropped, as is usual without a sink rule.
    """
    v = vertices(edges)
    n = v.count()
    if not n:
        return v.withColumn("rank", F.lit(1.0))
    out = edges.groupBy("src").agg((F.sum("weight") if normalised else F.count(F.lit(1))).alias("out"))
    e = kept(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")).repartition("src"))
    if teleport is None:
        base = v.withColumn("bias", F.lit(1.0 / n))
    else:
        total = teleport.agg(F.sum("bias")).first()[0] or 1.0
        base = v.join(teleport.groupBy("id").agg((F.sum("bias") / total).alias("bias")), "id", "left").fillna(0.0, ["bias"])
    base = cut(base)
    rank = base.select("id", F.lit(1.0 / n).alias("rank"))
    for i in range(1, rounds + 1):
        got = e.join(rank, e["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = base.join(got, base["id"] == got["dst"], "left").select("id", ((1 - damping) * F.col("bias") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % every == 0 or i == rounds:
            new = cut(new)
            moved = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            rank = new
            if moved < eps:
                break
        else:
            rank = new
    return rank


def hits(edges: DataFrame, rounds: int = 10, eps: float = 0.0) -> DataFrame:
    """(id, hub, authority), each of Euclidean norm 1, of the last round or the first that moves no more than ``eps`` in all."""
    e = cut(edges.select("src", "dst").distinct())
    v = vertices(e)
    state = v.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"))
    for _ in range(rounds):
        a = e.join(state, e["src"] == state["id"]).groupBy("dst").agg(F.sum("hub").alias("a"))
        a = v.join(a, v["id"] == a["dst"], "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a"))
        na = a.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm"))
        a = a.crossJoin(F.broadcast(na)).select("id", F.when(F.col("norm") > 0, F.col("a") / F.col("norm")).otherwise(0.0).alias("authority"))
        h = e.join(a, e["dst"] == a["id"]).groupBy("src").agg(F.sum("authority").alias("h"))
        h = v.join(h, v["id"] == h["src"], "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h"))
        nh = h.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("norm"))
        h = h.crossJoin(F.broadcast(nh)).select("id", F.when(F.col("norm") > 0, F.col("h") / F.col("norm")).otherwise(0.0).alias("hub"))
        new = cut(h.join(a, "id"))
        moved = F.sum(F.abs(F.col("hub") - F.col("h0")) + F.abs(F.col("authority") - F.col("a0")))
        old = state.withColumnsRenamed({"hub": "h0", "authority": "a0"})
        state = new
        if eps and (new.join(old, "id").agg(moved).first()[0] or 0.0) <= eps:
            break
    return state


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_links, out_links) of every vertex."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_links"), F.sum("o").alias("out_links"))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, mean and greatest degrees, density."""
    d = degrees(edges)
    one = d.agg(F.count(F.lit(1)).alias("vertices"), F.sum("out_links").alias("edges"), F.max("in_links").alias("max_in"), F.max("out_links").alias("max_out"))
    n, m = F.col("vertices"), F.col("edges")
    return one.withColumn("mean_degree", m / n).withColumn("density", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, coefficient): links among a vertex's out-neighbours over possible ones.

    Every triangle is found once, from its vertex of least (degree, id) and the pairs of its later
    neighbours, which bounds the pairs by m ** 1.5; it then counts for each of its vertices that
    links to the other two.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    both = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    pair = both.groupBy("a", "b").agg(F.bool_or("up").alias("ab"), F.bool_or(~F.col("up")).alias("ba"))
    ends = pair.select(F.col("a").alias("id")).unionAll(pair.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rank = lambda c: ends.select(F.col("id").alias(c), F.struct("n", "id").alias(f"r{c}"))
    p = pair.join(rank("a"), "a").join(rank("b"), "b")
    lower = F.col("ra") < F.col("rb")
    # x links to y if xy, y to x if yx; x comes before y
    p = p.select(
        F.when(lower, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest("ra", "rb").alias("ry"),
        F.when(lower, F.col("ab")).otherwise(F.col("ba")).alias("xy"), F.when(lower, F.col("ba")).otherwise(F.col("ab")).alias("yx"),
    )
    one = p.select("x", "y", "ry", "xy", "yx")
    two = p.select("x", F.col("y").alias("z"), F.col("ry").alias("rz"), F.col("xy").alias("xz"), F.col("yx").alias("zx"))
    third = p.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("xy").alias("yz"), F.col("yx").alias("zy"))
    tri = one.join(two, "x").where("ry < rz").join(third, ["y", "z"])
    inside = lambda v, a, b, ab, ba: F.struct(F.col(v).alias("v"), F.when(F.col(a) & F.col(b), F.col(ab).cast("int") + F.col(ba).cast("int")).otherwise(0).alias("t"))
    found = tri.select(F.explode(F.array(inside("x", "xy", "xz", "yz", "zy"), inside("y", "yx", "yz", "xz", "zx"), inside("z", "zx", "zy", "xy", "yx"))).alias("f"))
    t = found.groupBy(F.col("f.v").alias("v")).agg(F.sum("f.t").alias("t"))
    share = F.when(F.col("d") > 1, F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return out.join(t, out["src"] == t["v"], "left").select(F.col("src").alias("id"), share.alias("coefficient"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): all vertices take their neighbours' commonest label at once, ties to the least."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    both = cut(both)
    label = cut(vertices(edges).select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        n = both.join(label, both["dst"] == label["id"]).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = n.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("new"))
        new = cut(label.join(best, label["id"] == best["src"], "left").select("id", F.coalesce("new", "label").alias("label")))
        changed = new.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        label = new
        if not changed:
            break
    return label


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row (modularity): inner share less expected share, undirected, weights summed."""
    e = edges.where("src <> dst").select("src", "dst", "weight")
    l = label.select("id", "label")
    m = e.agg(F.sum("weight").alias("m"))
    inner = e.join(l.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(l.withColumnsRenamed({"id": "dst", "label": "b"}), "dst").where("a = b").groupBy(F.col("a").alias("label")).agg(F.sum("weight").alias("w"))
    ends = e.select(F.col("src").alias("id"), "weight").union(e.select("dst", "weight")).join(l, "id").groupBy("label").agg(F.sum("weight").alias("d"))
    q = F.coalesce(F.col("w"), F.lit(0.0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2
    return ends.join(inner, "label", "left").crossJoin(F.broadcast(m)).agg(F.sum(q).alias("modularity"))


def communities(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(label, size, internal, external, density, conductance) of every community."""
    l = label.select("id", "label")
    size = l.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    e = edges.where("src <> dst").join(l.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(l.withColumnsRenamed({"id": "dst", "label": "b"}), "dst")
    ends = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("label"), (F.col("a") == F.col("b")).alias("inner"))
    c = ends.groupBy("label").agg(F.count_if("inner").alias("internal"), F.count_if(~F.col("inner")).alias("external"))
    n, i, x = F.col("size"), F.coalesce("internal", F.lit(0)), F.coalesce("external", F.lit(0))
    return size.join(c, "label", "left").select(
        "label", "size", i.alias("internal"), x.alias("external"), F.when(n > 1, 2 * i / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(2 * i + x > 0, x / (2 * i + x)).otherwise(0.0).alias("conductance")
    )


def shortest_paths(edges: DataFrame, source, rounds: int = 20) -> DataFrame:
    """(id, distance) of what is reached from ``source`` in unit steps, breadth first."""
    e = edges.select("src", "dst").distinct()
    seen = cut(edges.sparkSession.createDataFrame([(source, 0)], f"id {edges.schema['src'].dataType.simpleString()}, distance int"))
    front = seen
    for i in range(1, rounds + 1):
        step = e.join(front, e["src"] == front["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").select("id", F.lit(i).alias("distance")))
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front))
    return seen


def top_vertices(rank: DataFrame, by: str, k: int = 10) -> DataFrame:
    return rank.orderBy(F.desc(by), "id").limit(k)


def local_moves(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, label) by synchronous modularity moves: each vertex goes to the neighbouring community of
    greatest gain k_in - k * total / (2 m), if that beats its own; to lesser labels in one round and to
    greater ones in the next, so that two vertices don't swap."""
    both = edges.where("src <> dst").select("src", "dst", "weight")
    both = cut(both.union(both.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    k = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    m2 = k.agg(F.sum("k").alias("m2"))
    label = cut(k.select("id", "k", F.col("id").alias("label")))
    still = 0
    for i in range(rounds):
        total = label.groupBy("label").agg(F.sum("k").alias("total"))
        near = both.join(label.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        own = label.select("id", F.col("k"), F.col("label").alias("own"))
        c = near.join(total, "label").join(own, "id").crossJoin(F.broadcast(m2))
        t = F.col("total") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
        c = c.withColumn("gain", F.round(F.col("w") - F.col("k") * t / F.col("m2"), 9))
        best = c.groupBy("id").agg(F.min_by("label", F.struct(-F.col("gain"), "label")).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"))
        moved = label.join(best, "id", "left")
        go = (F.col("gain") > F.coalesce("stay", F.lit(0.0))) & (F.col("to") > F.col("label") if i % 2 else F.col("to") < F.col("label"))
        new = cut(moved.select("id", "k", F.when(go, F.col("to")).otherwise(F.col("label")).alias("label"), F.coalesce(go, F.lit(False)).alias("moved")))
        n = new.where("moved").limit(1).count()
        label = new.drop("moved")
        still = 0 if n else still + 1
        if still == 2:
            break
    return label.select("id", "label")


def annealed(edges: DataFrame, rounds: int = 30, heat: float = 0.01, cooling: float = 0.85, seed: int = 7) -> DataFrame:
    """(id, label) of the greatest modularity met while cooling from ``heat``.

    In a round each vertex of a random half draws one neighbouring community and goes there if that
    gains modularity, or else with probability exp(gain / heat); draws are hashes of (id, round, seed).
    """
    both = edges.where("src <> dst").select("src", "dst", "weight")
    both = cut(both.union(both.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    k = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    m2 = k.agg(F.sum("k")).first()[0]
    label = best = cut(k.select("id", "k", F.col("id").alias("label")))
    if not m2:
        return label.select("id", "label")
    top = modularity(edges, label).first()[0]
    for i in range(rounds):
        draw = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed * 1009 + i)), F.lit(1 << 20)) / (1 << 20)  # noqa: B023, E731
        total = label.groupBy("label").agg(F.sum("k").alias("total"))
        near = both.join(label.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        c = near.join(total, "label").join(label.select("id", "k", F.col("label").alias("own")), "id")
        t = F.col("total") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
        c = c.withColumn("gain", F.col("w") - F.col("k") * t / m2)
        other = F.when(F.col("label") != F.col("own"), F.struct(draw("id", "label").alias("d"), "label", "gain"))
        stay = label.withColumnRenamed("label", "own").join(total.withColumnRenamed("label", "own"), "own").select("id", (-F.col("k") * (F.col("total") - F.col("k")) / m2).alias("alone"))
        c = c.groupBy("id").agg(F.min(other).alias("to"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay")).join(stay, "id")
        gain = 2 * (F.col("to.gain") - F.coalesce("stay", "alone")) / m2
        go = (draw("id", F.lit("half")) < 0.5) & ((gain > 0) | (draw("id", F.lit("heat")) < F.exp(gain / heat)))
        to = c.where(F.col("to").isNotNull() & go).select("id", F.col("to.label").alias("new"))
        label = cut(label.join(to, "id", "left").select("id", "k", F.coalesce("new", "label").alias("label")))
        now = modularity(edges, label).first()[0]
        if now > top:
            best, top = label, now
        heat *= cooling
    return best.select("id", "label")


def added(pages: DataFrame, links: DataFrame, more: DataFrame) -> DataFrame:
    """``links`` (src, dst, weight) with ``more``, of which only those between known pages (id) are kept; the first of a pair stands."""
    both = links.withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1)))
    known = both.join(pages.select(F.col("id").alias("src")), "src", "left_semi").join(pages.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.groupBy("src", "dst").agg(F.min_by("weight", F.struct("_n", "weight")).alias("weight"))
