"""Toxicity: a linear-chain conditional random field over words tags toxic spans.

Labels are of documents, so the training tokens are labelled first: in a toxic document, a word
is a toxic token if its core, or a stem with an ending behind it, is found far more often in toxic
documents than in others. The field has two states, hashed emission features and a table of transitions,
learnt by gradient steps on the exact likelihood. Scoring runs forward-backward over whole texts;
the marginals give spans, and the log-odds of their noisy-or, set against the labels of the
training documents by a logistic line, gives the document's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import _LOWER, PIECE_BYTES, U64, Powers, byte_codes, mixed, pieces, texts_of, words_of
from trawl.llm.quality import _LETTER, held_out

TRAIN_DOCS = {1: 1000, 0: 2000}  # documents of either label to learn from, at most: those of least hash
TRAIN_BYTES = 6_000_000  # of whole texts of either label, at most; a text that doesn't fit any more is passed over
BITS = 18  # of the table of emission weights of each feature
STEMS = (4, 5, 6, 7)  # bytes of a stem
STEPS = 30
RIDGE = 0.5  # pull of every weight towards 0, so that a word seen once or twice teaches little
TAG = 0.5  # a word is tagged if its marginal is above this
FLOOR = 0.1  # lesser marginals don't add up
LEAST_EVIDENCE = 0.01  # so that no evidence has a logarithm


def token_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """(features, words) of hashes: the core without marks at its ends in lower case, its stems, and its length.

    A stem has an ending behind it: a core of just that length has a key of its own.
    """
    if not len(starts):
        return np.zeros((len(STEMS) + 2, 0), U64)
    letter = np.flatnonzero(_LETTER[data])
    letter = np.append(letter, len(data))
    lo = letter[np.searchsorted(letter, starts)]
    hi = letter[np.maximum(np.searchsorted(letter, ends) - 1, 0)] + 1
    bare = (lo >= ends) | (hi <= lo)
    lo, hi = np.where(bare, starts, lo), np.where(bare, ends, hi)
    prefix = powers.prefix(byte_codes(0)[_LOWER][data])
    keys = [powers.ranges(prefix, lo, hi, 11)]
    keys += [powers.ranges(prefix, lo, np.minimum(lo + k, hi), 11 + k) + (hi - lo > k).astype(U64) for k in STEMS]
    keys.append(powers.ranges(prefix, lo, lo, 30) + (hi - lo).astype(U64) * U64(0x9E3779B97F4A7C15))
    return np.stack(keys)


def emission_slots(keys: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Slots of the word's own keys and of the cores before and after it in its text."""
    core = keys[0]
    before, after = np.ones_like(core), np.full_like(core, 2)
    before[1:] = core[:-1]
    before[fresh] = U64(1)
    after[:-1] = core[1:]
    after[:-1][fresh[1:]] = U64(2)
    out = np.empty((len(keys) + 2, len(core)), np.int32)
    for k, row in enumerate([*keys, before * U64(3), after * U64(5)]):
        out[k] = ((row * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int32) + np.int32(k << BITS)
    return out


def scan(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """x[t] = (p + q x[t-1]) / (r + s x[t-1]) over a whole sequence.

    Rows of the sequence advance together: first their transforms are composed, then the values
    at row ends are carried from row to row, then every row is filled in.
    """
    n = len(p)
    rows = max(1, min(4096, n // 32))
    width = -(-n // rows)
    pad = rows * width - n
    lay = lambda v, fill: np.concatenate([v, np.full(pad, fill)]).reshape(rows, width).T.copy()
    p, q, r, s = lay(p, 0.0), lay(q, 1.0), lay(r, 1.0), lay(s, 0.0)
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)  # x -> (b + a x) / (d + c x)
    for t in range(width):
        na, nb = q[t] * a + p[t] * c, q[t] * b + p[t] * d
        nc, nd = s[t] * a + r[t] * c, s[t] * b + r[t] * d
        top = 1 / np.maximum(np.maximum(np.maximum(na, nb), np.maximum(nc, nd)), 1e-300)
        a, b, c, d = na * top, nb * top, nc * top, nd * top
    at, x = [], 1.0
    for ra, rb, rc, rd in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()):
        at.append(x)
        x = (rb + ra * x) / max(rd + rc * x, 1e-300)
    x = np.array(at)
    out = np.empty((width, rows))
    for t in range(width):
        x = (p[t] + q[t] * x) / (r[t] + s[t] * x)
        out[t] = x
    return out.T.ravel()[:n]


@dataclass
class Field:
    """Emission weights (features * 2**BITS) of the toxic state, log transitions and start."""

    weights: np.ndarray
    move: np.ndarray  # [from, to]
    start: float
    line: tuple[float, float] = (0.0, 1.0)  # of a document's log-odds over the log of its evidence

    def odds(self, slot: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(e, a, b): emission, forward odds and backward odds of the toxic state for each word."""
        e = np.zeros(slot.shape[1])
        for row in slot:
            e += self.weights[row]
        e = np.exp(np.clip(e, -30, 30))
        t = np.exp(self.move)
        n = len(e)
        a = scan(np.where(fresh, np.exp(self.start) * e, t[0, 1] * e), np.where(fresh, 0, t[1, 1] * e), np.where(fresh, 1, t[0, 0]), np.where(fresh, 0, t[1, 0]))
        last = np.concatenate([fresh[1:], [True]]) if n else fresh
        nxt = np.concatenate([e[1:], [1.0]]) if n else e
        back = [np.where(last, 1, t[1, 0]), np.where(last, 0, t[1, 1] * nxt), np.where(last, 1, t[0, 0]), np.where(last, 0, t[0, 1] * nxt)]
        b = scan(*(v[::-1] for v in back))[::-1]
        return e, a, b

    def marginals(self, slot: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        if not len(fresh):
            return np.zeros(0)
        _, a, b = self.odds(slot, fresh)
        x = a * b
        return x / (1 + x)


def label_tokens(keys: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of toxic texts are toxic tokens.

    A key tells if it is in 4 toxic texts and 3 % of them at least and 30 times as frequent among
    them as among the others; or if its distinct words, counted once a text, are 10 times as
    frequent and a likelihood ratio of 40 or more speaks against chance. Cores come first; stems
    are counted over the words that nothing before has explained.
    """
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    out = np.zeros(len(owner), bool)
    for row in keys[: 1 + len(STEMS)]:
        left = np.flatnonzero(~out)
        _, code = np.unique(row[left], return_inverse=True)
        size = int(code.max(initial=-1)) + 1
        pair = np.unique(code.astype(np.int64) * len(toxic) + owner[left])
        kind, doc = pair // len(toxic), pair % len(toxic)
        hits = np.bincount(kind, toxic[doc], size)
        others = np.bincount(kind, ~toxic[doc], size)
        telling = (hits >= max(4, 0.03 * n_toxic)) & (hits / n_toxic >= 30 * (others + 0.5) / n_clean)
        # each distinct word of a text with this key
        _, one = np.unique(mixed(keys[0][left] ^ mixed(owner[left].astype(U64), 51)) + row[left], return_index=True)
        doc, kind = owner[left][one], code[one]
        in_toxic, all_words = np.bincount(kind, toxic[doc], size), np.bincount(kind, minlength=size)
        rate = max(1e-9, toxic[doc].mean()) if len(doc) else 1.0
        surprise = 2 * in_toxic * np.log(np.maximum(in_toxic, 1e-9) / np.maximum(all_words * rate, 1e-9))
        odds = (in_toxic / rate) / np.maximum((all_words - in_toxic + 0.5) / max(1e-9, 1 - rate), 1e-9)
        telling |= (hits >= 4) & (odds >= 10) & (surprise >= 40)
        out[left[telling[code]]] = True
    return out & toxic[owner]


def evidence(marginal: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each text, minus the log of the chance that none of its words is toxic; marginals up to FLOOR don't add up."""
    loud = marginal > FLOOR
    return np.bincount(owner[loud], -np.log1p(-np.minimum(marginal[loud], 1 - 1e-12)), n)


def _line(x: np.ndarray, toxic: np.ndarray, weight: dict[int, float]) -> tuple[float, float]:
    """A logistic line of the label over the log of the evidence, by Newton steps."""
    if toxic.all() or not toxic.any():
        return 0.0, 1.0
    z = np.stack([np.ones(len(x)), np.log(x + LEAST_EVIDENCE)])
    w = np.where(toxic, weight[1], weight[0])
    beta = np.array([0.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(beta @ z, -30, 30)))
        grad = z @ (w * (toxic - p)) - 0.01 * beta
        beta = beta + np.linalg.solve((z * (w * p * (1 - p))) @ z.T + 0.01 * np.eye(2), grad)
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[1] > 0 else (0.0, 1.0)


def fit(data: np.ndarray, off: np.ndarray, toxic: np.ndarray, weight: dict[int, float] | None = None) -> Field:
    """The field from whole texts and their labels, a few megabytes of text at a time.

    ``weight``: what a text of either label counts where documents' scores are set against labels.
    """
    powers = Powers()
    cuts = [0]
    while cuts[-1] < len(toxic):
        cuts.append(min(len(toxic), max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + PIECE_BYTES, "right")) - 1)))
    parts, label_keys, owners = [], [], []
    for lo, hi in zip(cuts, cuts[1:]):
        part = data[off[lo] : off[hi]]
        starts, ends, first = words_of(part, off[lo : hi + 1] - off[lo])
        if not len(starts):
            continue
        keys = token_keys(part, starts, ends, powers)
        owner = np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(first))
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
        parts.append((emission_slots(keys, fresh), fresh))
        label_keys.append(keys[: 1 + len(STEMS)])
        owners.append(owner)
    e_dim = (len(STEMS) + 4) << BITS
    field = Field(np.zeros(e_dim), np.zeros((2, 2)), -3.0)
    if not parts:
        return field
    y = label_tokens(np.concatenate(label_keys, axis=1), np.concatenate(owners), toxic)
    del label_keys
    y = np.split(y, np.cumsum([len(o) for o in owners])[:-1])
    # a prior against the toxic state; what a word adds is learnt
    field.move[:] = np.log([[0.98, 0.02], [0.9, 0.1]])
    params = np.concatenate([field.weights, field.move.ravel(), [field.start]]).astype(np.float32)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        field = Field(params[:e_dim], params[e_dim : e_dim + 4].reshape(2, 2).astype(float), float(params[-1]))
        grad = np.zeros_like(params)
        for (slot, fresh), tag in zip(parts, y):
            _gradient(field, slot, fresh, tag, grad, e_dim)
        grad[:e_dim] -= RIDGE * params[:e_dim]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        params = params + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    field = Field(params[:e_dim], params[e_dim : e_dim + 4].reshape(2, 2).astype(float), float(params[-1]))
    found = [evidence(field.marginals(slot, fresh), owner, len(toxic)) for (slot, fresh), owner in zip(parts, owners)]
    field.line = _line(np.sum(found, axis=0), toxic, weight or {0: 1.0, 1: 1.0})
    return field


def _gradient(field: Field, slot: np.ndarray, fresh: np.ndarray, tag: np.ndarray, grad: np.ndarray, e_dim: int) -> None:
    """Add the log-likelihood's gradient: what the tags have less what the field expects."""
    e, a, b = field.odds(slot, fresh)
    miss = tag - a * b / (1 + a * b)
    for k, row in enumerate(slot):
        at = k << BITS
        grad[at : at + (1 << BITS)] += np.bincount(row - at, miss, 1 << BITS)
    inner = ~fresh[1:]
    t = np.exp(field.move)
    prev, eb = a[:-1][inner], (e * b)[1:][inner]
    xi = np.stack([np.full(len(prev), t[0, 0]), t[0, 1] * eb, prev * t[1, 0], prev * t[1, 1] * eb])
    yi = tag.astype(np.int64)
    grad[e_dim : e_dim + 4] += np.bincount(yi[:-1][inner] * 2 + yi[1:][inner], minlength=4) - (xi / xi.sum(0)).sum(1)
    grad[-1] += miss[fresh].sum()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: dict[int, int] = TRAIN_DOCS) -> Field:
    """The field from at most ``most`` whole labelled texts of either label that aren't held out.

    Of rows that share an id the least text stands for it; at most TRAIN_BYTES of either label
    are taken, so what reaches the driver is bounded.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(f"{label} IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(~held_out(F.col("doc_id")))
    there = dict(known.groupBy("y").count().collect())
    pick = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y])
        pick = part if pick is None else pick.union(part)
    # a bounded number of rows: so are the broadcasts
    size, text_key = F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text")
    rows = docs.select("doc_id", size.alias("size"), text_key.alias("text_key")).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "y")
    sizes = rows.agg(F.min(F.struct("size", "text_key")).alias("one")).select("doc_id", "y", "one.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, taken = {0: TRAIN_BYTES, 1: TRAIN_BYTES}, []
    for r in sizes:
        if r["size"] <= left[r["y"]]:
            left[r["y"]] -= r["size"]
            taken.append((r["doc_id"], r["text_key"], r["y"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(taken, f"doc_id {kind}, text_key long, y int")
    got = docs.select("doc_id", "text").withColumn("text_key", text_key).join(F.broadcast(chosen), ["doc_id", "text_key"]).dropDuplicates(["doc_id"])
    got = got.orderBy("doc_id").select("text", "y").toArrow().combine_chunks()
    if not got.num_rows:
        return Field(np.zeros((len(STEMS) + 4) << BITS), np.zeros((2, 2)), -3.0)
    col = got["text"]
    data, off = texts_of(col.chunk(0) if isinstance(col, pa.ChunkedArray) else col)
    toxic = got["y"].to_numpy() == 1
    # the sample holds either label in proportions of its own
    weight = {y: there.get(y, 0) / max(1, int((toxic == y).sum())) for y in (0, 1)}
    top = max(weight.values())
    return fit(data, off, toxic, {y: w / top for y, w in weight.items()})


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of ``docs``.

    spans are the offending (start, end) offsets in the text's UTF-8 bytes with their marginals.
    Null and empty texts have the score of texts without evidence and no spans; rows with a null doc_id are scored and never
    learnt from; repeated rows get equal results; without labels every score is 0.
    Only doc_id, text and the label are read, so other columns may have any name.
    """
    field = train(docs, labels, label)
    field.weights = field.weights.astype(np.float32)
    # plain arrays: a broadcast instance would need the package on every worker
    model = docs.sparkSession.sparkContext.broadcast((field.weights, field.move, field.start, field.line))

    def rows(batches):
        powers, crf = Powers(), Field(*model.value)
        for part, data, off in pieces(batches):
            starts, ends, first = words_of(data, off)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            fresh = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            if len(owner) and crf.weights.any():
                marginal = crf.marginals(emission_slots(token_keys(data, starts, ends, powers), fresh), fresh)
            else:
                marginal = np.zeros(len(owner))
            if crf.weights.any():
                base, slope = crf.line
                score = 1 / (1 + np.exp(-np.clip(base + slope * np.log(evidence(marginal, owner, len(n)) + LEAST_EVIDENCE), -30, 30)))
            else:
                score = np.zeros(len(n))
            hit = np.flatnonzero(marginal > TAG)
            spans = pa.StructArray.from_arrays(
                [pa.array(starts[hit] - off[owner[hit]]), pa.array(ends[hit] - off[owner[hit]]), pa.array(marginal[hit])], names=["start", "end", "marginal"]
            )
            bound = np.searchsorted(owner[hit], np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(pa.array(bound), spans)], names=["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double, spans array<struct<start:long,end:long,marginal:double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
