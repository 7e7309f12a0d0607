"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is cut before every run of blanks into marked words (blanks stand for the mark). Pieces
never cross such a cut, so the best segmentation of a text joins those of its words. The distinct
words of a part of the text are sorted, which puts them in the depth-first order of their trie;
going from one to the next keeps the forward scores of the common prefix and extends from there.
Scores are the vocabulary file's: the segmentation with the greatest sum wins, of equals the one
with the longest last piece. A character without a piece costs the least score less 10 and comes
out as byte pieces. So does the mark's own character in a text, which keeps decoding exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trawl.llm.common import Powers, pieces, spread, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 200_000  # words whose segmentation a task remembers
PART_BYTES = 1_000_000


@dataclass
class Vocabulary:
    """Pieces by their text, suffixes of pieces, and the bytes of every id.

    It is broadcast as a plain tuple, since an instance would need the package on every worker;
    the cache in that tuple lives as long as the worker.
    """

    table: dict[str, tuple[float, int]]  # a suffix that is no piece has id -1
    byte_ids: list[int]
    unknown: float
    data: np.ndarray
    off: np.ndarray
    cache: dict[int, tuple] = field(default_factory=dict)

    def plain(self) -> tuple:
        return self.table, self.byte_ids, self.unknown, self.data, self.off, self.cache


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file; word marks must only stand at the start of a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces_, byte_ids, blobs = {}, [0] * 256, []
    normal = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(p[1:-1], 16)
            byte_ids[value] = i
            blobs.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            blobs.append(b"")
        else:
            text = p.replace(MARK, " ")
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {i} has a mark behind other characters")
            pieces_[text] = (model.get_score(i), i)
            normal.append(model.get_score(i))
            blobs.append(text.encode())
    low = min(normal, default=0.0)
    table = dict(pieces_)
    for t in pieces_:
        for k in range(1, len(t)):
            table.setdefault(t[k:], (0.0, -1))
    return Vocabulary(table, byte_ids, low - 10, np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0] + [len(b) for b in blobs]))


def segment(words: list[str], v: Vocabulary) -> list[tuple[int, ...]]:
    """Ids of each of the sorted ``words``; forward scores of common prefixes are reused."""
    out = []
    score, size, ids = [0.0], [0], [0]
    last = ""
    get = v.table.get
    for w in words:
        n, k = len(w), min(len(last), len(w))
        same = k if last[:k] == w[:k] else next(i for i in range(k) if last[i] != w[i])
        del score[same + 1 :], size[same + 1 :], ids[same + 1 :]
        for i in range(same + 1, n + 1):
            best, length, which = -1e300, 1, -1
            for k in range(1, i + 1):
                hit = get(w[i - k : i])
                if hit is None:
                    break
                if hit[1] >= 0:
                    s = score[i - k] + hit[0]
                    if s >= best:
                        best, length, which = s, k, hit[1]
            one = get(w[i - 1])
            if one is None or one[1] < 0:  # no piece for this character
                s = score[i - 1] + v.unknown
                if s > best or (s == best and length <= 1):
                    best, length, which = s, 1, -1
            score.append(best)
            size.append(length)
            ids.append(which)
        last = w
        path, i = [], n
        while i:
            if ids[i] >= 0:
                path.append(ids[i])
            else:
                path.extend(v.byte_ids[b] for b in reversed(w[i - 1].encode()))
            i -= size[i]
        path.reverse()
        out.append(tuple(path))
    return out


def encode_part(data: np.ndarray, off: np.ndarray, v: Vocabulary, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of all texts."""
    n = np.diff(off)
    full = n > 0
    # a blank before every text that isn't empty
    marked = np.insert(data, off[:-1][full], 0x20)
    off = np.concatenate([[0], np.cumsum(n + full)])
    blank = marked == 0x20
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[off[:-1][full]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(marked))
    first = np.searchsorted(starts, off)
    h = word_hashes(marked, starts, ends, powers)
    kinds, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    cache = v.cache
    if len(cache) > CACHE:
        cache.clear()
    keys = kinds.tolist()
    new = [i for i, k in enumerate(keys) if k not in cache]
    if new:
        raw = marked.tobytes()
        words = sorted((raw[starts[where[i]] : ends[where[i]]].decode("utf-8", "replace"), keys[i]) for i in new)
        for (_, k), path in zip(words, segment([w for w, _ in words], v)):
            cache[k] = path
    paths = [cache[k] for k in keys]
    size = np.fromiter(map(len, paths), np.int64, len(paths))
    flat = np.fromiter(chain.from_iterable(paths), np.int32, int(size.sum()))
    at = np.cumsum(size) - size
    mine = size[inverse]
    ids = flat[np.repeat(at[inverse], mine) + spread(mine)]
    return ids, np.concatenate([[0], np.cumsum(mine)])[first]


def decode_part(ids: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts; the blank that encoding put first is dropped."""
    size = np.diff(v.off)[ids]
    data = v.data[np.repeat(v.off[:-1][ids], size) + spread(size)]
    bound = np.concatenate([[0], np.cumsum(size)])[off]
    full = np.diff(bound) > 0
    lead = bound[:-1][full]
    lead = lead[data[lead] == 0x20]
    owner = np.searchsorted(bound, lead, "right") - 1
    drop = np.zeros(len(bound) - 1, np.int64)
    drop[owner] = 1
    return np.delete(data, lead), bound - np.concatenate([[0], np.cumsum(drop)])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` with ids, n_tokens and round_trip (whether decoding the ids gives the text back).

    An empty text has no ids; a null text has null ids, no tokens and a true round_trip; very long
    words are one path. Input columns named like an output are replaced.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model).plain())  # bounded by the model file
    out = ("ids", "n_tokens", "round_trip")
    docs = docs.drop(*out)
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["ids array<int>, n_tokens long, round_trip boolean"])

    def rows(batches):
        v, powers = Vocabulary(*vocabulary.value), Powers()
        for part, data, off in pieces(batches, most=PART_BYTES):
            ids, bound = encode_part(data, off, v, powers) if len(data) else (np.zeros(0, np.int32), np.zeros(len(off), np.int64))
            back, back_off = decode_part(ids, bound, v)
            same = np.diff(back_off) == np.diff(off)
            if len(back) == len(data):
                wrong = np.flatnonzero(back != data)
                same[np.searchsorted(off, wrong, "right") - 1] = False
            else:
                for i in np.flatnonzero(same):
                    same[i] = np.array_equal(back[back_off[i] : back_off[i + 1]], data[off[i] : off[i + 1]])
            null = pa.compute.is_null(part.column(names.index("text"))).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(bound.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), lists, pa.array(np.diff(bound)), pa.array(same)], names=[*names, *out])

    return docs.mapInArrow(rows, schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with decoded_text from ids; null ids give a null text, no ids an empty one."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(load(model).plain())
    rows = rows.drop("decoded_text")
    names = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["decoded_text string"])

    def texts(batches):
        v = Vocabulary(*vocabulary.value)
        for b in batches:
            col = b.column(names.index("ids"))
            size = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy()
            data, off = decode_part(col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]), v)
            raw = data.tobytes()
            text = [None if x else raw[a:z].decode("utf-8", "replace") for x, a, z in zip(pa.compute.is_null(col).to_pylist(), off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*names, "decoded_text"])

    return rows.mapInArrow(texts, schema)
