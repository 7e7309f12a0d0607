import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from trawl.session import session
from trawl.llm.common import staged, staging
from trawl.llm.registry import queries
spark = session("alone", "2", 2)
names = ["op1_ngram_jaccard_join", "op2_toxicity", "op3_suffix_dedup", "op6_sentencepiece", "op7_substring_dedup", "op8_decontamination", "op9_quality_classifier", "op10_embedding_near_dedup"]
for name in names:
    with staging(spark):
        print(name, queries()[name](spark, "/root/testdata/sf0.001").count())
import corpus_pipeline
print("pipeline", corpus_pipeline.run(spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split("\n")) == 10


def test_scope_deletes_what_it_staged(spark):
    from trawl.llm.common import staged, staging

    with staging(spark):
        inner = staged(spark.range(3), "inner")
        kept = staged(inner, "kept", keep=True)
        where = [d.inputFiles()[0].removeprefix("file://") for d in (inner, kept)]
        assert all(map(os.path.exists, where))
    assert [os.path.exists(w) for w in where] == [False, True] and kept.count() == 3
