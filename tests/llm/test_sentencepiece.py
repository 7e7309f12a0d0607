import random

import pytest

from trawl.llm import sentencepiece_viterbi as sv
from trawl.session import table

TEXTS = [None, "", " ", "a", "  two  blanks ", "one\ntwo\tthree", "ünï 漢字 🙂 ▁mark", "x" * 3000, "the the there then they", "\u0000null", "a▁b ▁"]


def library():
    """The installed library over the same pieces, told to segment by scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sv.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def brute(word, v):
    """The best sum over all segmentations, without reuse."""
    best = [0.0] + [-1e300] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            hit = v.table.get(word[j:i])
            if hit and hit[1] >= 0:
                best[i] = max(best[i], best[j] + hit[0])
        one = v.table.get(word[i - 1])
        if one is None or one[1] < 0:
            best[i] = max(best[i], best[i - 1] + v.unknown)
    return best[-1]


def test_shared_prefixes_give_the_best_sum():
    v = sv.load()
    score = {i: s for s, i in v.table.values() if i >= 0}
    rng = random.Random(2)
    words = sorted({" " + "".join(rng.choice("theranoiü漢") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    back = set(v.byte_ids)
    for w, ids in zip(words, sv.segment(words, v)):
        data, off = sv.decode_part(__import__("numpy").array(ids), __import__("numpy").array([0, len(ids)]), v)
        assert (" " + data.tobytes().decode()) == w
        unknown = sum(1 for c in w if (v.table.get(c) or (0, -1))[1] < 0)
        assert sum(score[i] for i in ids if i not in back) + unknown * v.unknown == pytest.approx(brute(w, v))


def test_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = sv.decode(sv.encode(df)).orderBy("doc_id").collect()
    assert [r.decoded_text for r in rows] == TEXTS
    assert all(r.round_trip for r in rows)
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[0].ids is None and rows[1].ids == []
    assert sv.encode(df.limit(0)).count() == 0


def test_words_score_as_in_the_library():
    """The library's n-best search over a lattice finds no better segmentation of any word."""
    sp, v = library(), sv.load()
    score = {i: s for s, i in v.table.values() if i >= 0}
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    words = sorted({" " + w for t in texts[:60] for w in t.split()})[:1500]
    words = [w for w in words if all((v.table.get(c) or (0, -1))[1] >= 0 for c in w)]
    for w, ids in zip(words, sv.segment(words, v)):
        best = sp.nbest_encode_as_ids(w[1:], 3)[0]
        assert sum(score[i] for i in ids) == sum(score[i] for i in best), w


def test_documents_round_trip(spark):
    rows = sv.encode(table(spark, "/root/testdata/sf0.01", "documents")).select("text", "ids", "round_trip", "n_tokens").collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
