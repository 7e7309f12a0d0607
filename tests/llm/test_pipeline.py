import corpus_pipeline
from test_dedup import brute_suffix
from test_join import brute

from trawl.llm.common import staged
from trawl.session import table

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(staged(stage(spark, kept[-1], SF), name))
        assert kept[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in texts[1] for i in good) >= 0.97 * len(good)
    assert sum(i in texts[1] for i, q in labels.items() if q == 0) <= 0.2 * (len(labels) - len(good))
    component = {i: c for i, (_, c, _) in brute(list(texts[1].items())).items()}
    assert set(texts[2]) == {i for i, c in component.items() if i == c}
    ids = sorted(texts[2])
    gone = dict(zip(ids, brute_suffix([texts[2][i] for i in ids], corpus_pipeline.REPEATED_BYTES)))
    for i in ids:
        n, removed, _, _ = gone[i]
        if i in texts[3]:
            left = len(texts[3][i].encode())
            assert n - removed <= left <= n - removed + 6 * gone[i][2]  # spans narrowed to characters
        else:
            assert removed > 0
    assert set(texts[4]) <= set(texts[3]) and len(texts[4]) < len(texts[3])


def test_run_returns_round_trips(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
