"""Document stores as change tables: versions, filters, boolean search, pages of results, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.operators.index import index_tokens


def stored(store: DataFrame, docs: DataFrame, status: str = "ACTIVE") -> DataFrame:
    """``store`` with a next version of each of ``docs`` (doc_id, content): append only, checksum sha256."""
    last = store.groupBy("doc_id").agg(F.max("version").alias("v"))
    new = docs.select("doc_id", "content").join(last, "doc_id", "left").select(
        "doc_id", "content", F.lit(status).alias("status"), (F.coalesce("v", F.lit(0)) + 1).alias("version"), F.sha2("content", 256).alias("checksum")
    )
    return store.unionByName(new)


def deleted(store: DataFrame, ids: DataFrame) -> DataFrame:
    """``store`` with a version of status DELETED for each known id: a soft delete."""
    last = current(store, None).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return store.unionByName(last.withColumn("version", F.col("version") + 1).withColumn("status", F.lit("DELETED")))


def current(store: DataFrame, status: str | None = "ACTIVE") -> DataFrame:
    """The last version of every document, of one status unless that is None."""
    cols = [c for c in store.columns if c != "doc_id"]
    last = store.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "version").alias("s")).select("doc_id", "s.*")
    return last if status is None else last.where(F.col("status") == status)


def history(store: DataFrame, doc_id) -> DataFrame:
    return store.where(F.col("doc_id") == doc_id).orderBy("version")


def verified(store: DataFrame) -> DataFrame:
    """Versions whose content doesn't hash to their checksum."""
    return store.where(F.sha2("content", 256) != F.col("checksum"))


def matching(docs: DataFrame, status: str | None = None, language: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Documents that meet every given filter; all of ``tags`` must be present."""
    if status is not None:
        docs = docs.where(F.col("status") == status)
    if language is not None:
        docs = docs.where(F.col("lang") == language)
    if tags:
        docs = docs.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0)
    return docs


def boolean_search(docs: DataFrame, terms: list[str], mode: str = "all") -> DataFrame:
    """(doc_id, hits, tf) of documents with all, or any, of the terms."""
    t = docs.select("doc_id", F.explode(index_tokens(F.col("text"))).alias("term")).where(F.col("term").isin(terms))
    r = t.groupBy("doc_id").agg(F.countDistinct("term").alias("hits"), F.count(F.lit(1)).alias("tf"))
    return r.where(F.col("hits") == len(set(terms))) if mode == "all" else r


def page(results: DataFrame, order: list, number: int = 1, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` (1 to 100) rows; the order should end in an id."""
    size = min(max(size, 1), 100)
    return results.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def suggestions(terms: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """Terms (term, df) that start with ``prefix``, most frequent first, 50 at most."""
    return terms.where(F.col("term").startswith(prefix.lower())).orderBy(F.desc("df"), "term").limit(min(most, 50))


def highlighted(text: Column, terms: list[str]) -> Column:
    """Occurrences of the terms between <em> and </em>, whatever their case."""
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(terms) + r")\b", "<em>$1</em>")


def without(index: DataFrame, ids: DataFrame) -> DataFrame:
    """An index without the postings of some documents."""
    return index.join(ids.select("doc_id"), "doc_id", "left_anti")


def expired(transactions: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Completed transactions older than ``seconds``."""
    return transactions.where(F.col("status").isin("COMMITTED", "ABORTED") & (F.unix_seconds(now) - F.unix_seconds("ended") > seconds))


def kept_backups(backups: DataFrame, n: int) -> DataFrame:
    """The last n backups of each set."""
    return backups.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(F.desc("created"), "backup_id"))).where(F.col("_n") <= n).drop("_n")


def glob(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a path matches an include and no exclude pattern of * and ?."""

    def like(p):
        rx = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.[]{}()+^$|" else c for c in p)
        return path.rlike(f"^{rx}$")

    yes, no = F.lit(False), F.lit(False)
    for p in include:
        yes = yes | like(p)
    for p in exclude:
        no = no | like(p)
    return yes & ~no


def incremental(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, checksum) that a manifest lacks or knows with another checksum."""
    return files.join(manifest.select("path", "checksum"), ["path", "checksum"], "left_anti")


def transactions(events: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """(txn, status, operations) of a log (txn, seq, action, ts): committed or aborted by its last such
    action, else aborted if it began more than ``seconds`` ago, else active. What follows an end doesn't count."""
    end = F.min_by("action", F.when(F.col("action").isin("commit", "abort"), F.col("seq")))
    at = F.min(F.when(F.col("action").isin("commit", "abort"), F.col("seq")))
    t = events.groupBy("txn").agg(end.alias("end"), at.alias("at"), F.min("ts").alias("began"))
    n = events.where("action = 'operation'").join(t.select("txn", "at"), "txn").where("at IS NULL OR seq < at").groupBy("txn").agg(F.count(F.lit(1)).alias("operations"))
    late = F.unix_seconds(now) - F.unix_seconds("began") > seconds
    status = F.when(F.col("end") == "commit", "COMMITTED").when((F.col("end") == "abort") | late, "ABORTED").otherwise("ACTIVE")
    return t.join(n, "txn", "left").select("txn", status.alias("status"), F.coalesce("operations", F.lit(0)).alias("operations"))


def two_phase(votes: DataFrame, participants: DataFrame) -> DataFrame:
    """(txn, decision): commit if every registered participant voted yes, else abort; a missing vote is a no."""
    yes = votes.where("vote").select("txn", "participant").distinct().join(participants.select("participant"), "participant", "left_semi")
    n = participants.select("participant").distinct().agg(F.count(F.lit(1)).alias("all"))
    got = votes.select("txn").distinct().join(yes.groupBy("txn").agg(F.count(F.lit(1)).alias("yes")), "txn", "left").crossJoin(F.broadcast(n))
    return got.select("txn", F.when(F.coalesce("yes", F.lit(0)) == F.col("all"), "commit").otherwise("abort").alias("decision"))


def hit_rate(log: DataFrame, *by: str) -> DataFrame:
    """(by, requests, hits, rate) of a cache's log with a boolean ``hit``."""
    n, h = F.count(F.lit(1)), F.count_if("hit")
    return log.groupBy(*by).agg(n.alias("requests"), h.alias("hits"), (h / n).alias("rate"))


def invalidated(entries: DataFrame, depends: DataFrame, include: list[str], now: Column | None = None) -> DataFrame:
    """Keys to drop: those that match a pattern, those expired by ``now``, and all that depends on them (key, on).

    Rounds go out from the first of these until nothing is new, however long the chains are.
    """
    from trawl.operators.graph import cut

    hit = glob(F.col("key"), include)
    if now is not None:
        hit = hit | F.coalesce(F.col("expires") <= now, F.lit(False))
    on = cut(depends.select("on", "key"))
    seen = front = cut(entries.where(hit).select("key").distinct())
    while True:
        step = on.join(front.select(F.col("key").alias("on")), "on", "left_semi").select("key").distinct()
        front = cut(step.join(seen, "key", "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front))
    return seen.join(entries.select("key").distinct(), "key", "left_semi")


def breaker(calls: DataFrame, now: Column, failures: int = 5, seconds: int = 60) -> DataFrame:
    """(key, state, failing): open after ``failures`` failures in a row, half_open once it has rested ``seconds``, else closed."""
    last_ok = calls.groupBy("key").agg(F.max(F.when(F.col("ok"), F.struct("ts", "id"))).alias("ok_at"))
    after = calls.join(last_ok, "key").where("NOT ok AND (ok_at IS NULL OR struct(ts, id) > ok_at)").groupBy("key").agg(F.count(F.lit(1)).alias("failing"), F.max("ts").alias("last"))
    n = F.coalesce("failing", F.lit(0))
    state = F.when(n < failures, "closed").when(F.unix_seconds(now) - F.unix_seconds("last") >= seconds, "half_open").otherwise("open")
    return last_ok.join(after, "key", "left").select("key", state.alias("state"), n.alias("failing"))
