"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a table of additions by bin, learnt by cyclic boosting: in turn, a shallow tree
over the feature's histogram of gradients adds a small step to its table. Then the pairs with the
largest gain on what is left get tables too. A score is the sum of looked-up additions.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import Powers, pieces, staged, word_hashes, words_of

FEATURES = (
    "log_words", "log_bytes", "word_length", "longest_word", "capitals", "bangs", "bars", "marks", "digits", "stops", "commas", "non_ascii",
    "distinct_words", "distinct_phrases", "same_as_last", "commonest_word", "short_words", "lines", "repeated_lines",
)
TRAIN_ROWS = 20_000  # labelled documents to learn from, at most: those of least hash
BINS = 48
ROUNDS = 250
PAIRS = 6
PAIR_BINS = 12
PAIR_ROUNDS = 80
RATE = 0.08


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CAPITAL = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _CAPITAL | _class("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_MARK = _class("%*&$#@^~<>{}[]\\_=+")
_DIGIT = _class("0123456789")


def _distinct(group: np.ndarray, items: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items of each group, and the count of each group's commonest item."""
    if not len(items):
        return np.zeros(n), np.zeros(n)
    key = np.sort((group.astype(np.uint64) << np.uint64(44)) | (items >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(new, len(key)))
    owner = (key[new] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, size)
    return np.bincount(owner, minlength=n).astype(float), most


def features_of(data: np.ndarray, off: np.ndarray, powers: Powers) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(off) - 1
    starts, ends, first = words_of(data, off)
    words = np.diff(first)
    size = np.diff(off)
    w1, b1 = np.maximum(words, 1), np.maximum(size, 1)

    def of(table):
        return np.diff(np.concatenate([[0], np.cumsum(table[data] if isinstance(table, np.ndarray) else data == table)])[off])

    h = word_hashes(data, starts, ends, powers)
    group = np.repeat(np.arange(n), words)
    length = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, group, length)
    distinct, most = _distinct(group, h, n)
    prefix = powers.prefix(h)
    four = powers.windows(prefix, 4, 9)
    inside = group[: len(four)] == group[3 : 3 + len(four)]
    phrases, _ = _distinct(group[: len(four)][inside], four[inside], n)
    again = np.bincount(group[1:][(h[1:] == h[:-1]) & (group[1:] == group[:-1])], minlength=n) if len(h) else np.zeros(n)
    # a line is what stands between line feeds and a text's ends
    cuts = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], cuts + 1]))
    line_owner = np.searchsorted(off, line_start, "right") - 1
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else line_end
    ok = (line_owner < n) & (line_end > line_start)
    line_start, line_end, line_owner = line_start[ok], line_end[ok], line_owner[ok]
    lines = np.bincount(line_owner, minlength=n)
    kinds, _ = _distinct(line_owner, word_hashes(data, line_start, line_end, powers), n)
    letters = np.maximum(of(_LETTER), 1)
    return np.stack(
        [
            np.log1p(words), np.log1p(size), np.bincount(group, length, n) / w1, longest, of(_CAPITAL) / letters, of(33) / w1, of(124) / w1, of(_MARK) / w1,
            of(_DIGIT) / b1, of(46) / w1, of(44) / w1, of(np.arange(256) > 127) / b1, distinct / w1, phrases / np.maximum(words - 3, 1), again / w1,
            most / w1, np.bincount(group, length <= 3, n) / w1, lines / w1, (lines - kinds) / np.maximum(lines, 1),
        ],
        axis=1,
    ).astype(np.float32)


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of whole texts; null and empty texts have zeros."""

    def rows(batches):
        powers = Powers()
        for part, data, off in pieces(batches):
            x = features_of(data, off, powers)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
                names=["doc_id", "features"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, features array<float>")


@dataclass
class Additive:
    """Cut points and additions of every feature and pair."""

    base: float
    cuts: list
    tables: list
    pairs: list
    pair_cuts: list
    pair_tables: list

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cut, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps by bin from a tree of ``depth`` over a histogram; a leaf has hessian 1 at least."""
    out = np.zeros(len(g))

    def grow(lo, hi, depth):
        G, H = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if depth and hi - lo > 1:
            gl, hl = G[:-1], H[:-1]
            gr, hr = G[-1] - gl, H[-1] - hl
            gain = np.where((hl >= 1) & (hr >= 1), gl**2 / (hl + 1) + gr**2 / (hr + 1) - G[-1] ** 2 / (H[-1] + 1), -1)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9:
                grow(lo, lo + k + 1, depth - 1)
                grow(lo + k + 1, hi, depth - 1)
                return
        out[lo:hi] = G[-1] / (H[-1] + 1)

    grow(0, len(g), depth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut in four of a two-way histogram."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a = (G[:-1, :-1], H[:-1, :-1])
    b = (G[:-1, -1:] - a[0], H[:-1, -1:] - a[1])
    c = (G[-1:, :-1] - a[0], H[-1:, :-1] - a[1])
    d = (G[-1, -1] - a[0] - b[0] - c[0], H[-1, -1] - a[1] - b[1] - c[1])
    gain = sum(x**2 / (y + 1) for x, y in (a, b, c, d)) - G[-1, -1] ** 2 / (H[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.empty_like(g)
    for (x, y), rows, cols in ((a, slice(0, i + 1), slice(0, j + 1)), (b, slice(0, i + 1), slice(j + 1, None)), (c, slice(i + 1, None), slice(0, j + 1)), (d, slice(i + 1, None), slice(j + 1, None))):
        step[rows, cols] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Learn tables from rows ``x`` and labels ``y``; without both labels the score is the prior."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    d = x.shape[1]
    cut = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1])) if len(v) else np.zeros(0)
    cuts = [cut(x[:, f], BINS) for f in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    few = [cut(x[:, f], PAIR_BINS) for f in range(d)]
    model = Additive(base, cuts, tables, [], few, [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    margin = np.full(len(y), base)

    def gradients():
        q = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(ROUNDS):
        for f in range(d):
            g, h = gradients()
            n = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, n), np.bincount(bins[f], h, n))
            tables[f] += step
            margin += step[bins[f]]
    rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(few)]

    def two_way(a, b, v):
        na, nb = len(few[a]) + 1, len(few[b]) + 1
        return np.bincount(rough[a] * nb + rough[b], v, na * nb).reshape(na, nb)

    g, h = gradients()
    ok = [f for f in range(d) if len(few[f])]
    ranked = sorted(((_quadrants(two_way(a, b, g), two_way(a, b, h))[0], a, b) for i, a in enumerate(ok) for b in ok[i + 1 :]), reverse=True)
    model.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(few[a]) + 1, len(few[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            step = RATE * _quadrants(two_way(a, b, g), two_way(a, b, h))[1]
            table += step
            margin += step[rough[a], rough[b]]
    return model


def held_out(doc_id):
    """Documents whose labels are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(features: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> Additive:
    """A model from at most ``rows`` labelled documents that aren't held out, those of least hash."""
    known = labels.select("doc_id", F.col(label).alias("y")).where(f"{label} IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    got = (
        features.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("features", "y")
        .toArrow()
    )
    x = np.array(got["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES)).astype(np.float64)
    return fit(x, got["y"].to_numpy().astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored from zero features; rows with a null doc_id are scored and
    never learnt from; repeated rows get equal scores; without usable labels the score is 0.5.
    Only doc_id, text and the label are read, so other columns may have any name.
    """
    table = staged(feature_table(docs), "features")
    # plain arrays and lists: a broadcast instance would need the package on every worker
    model = docs.sparkSession.sparkContext.broadcast(astuple(train(table, labels, label)))

    def rows(batches):
        additive = Additive(*model.value)
        for b in batches:
            x = b.column("features").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(additive.score(x))], names=["doc_id", "score"])

    scored = table.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
