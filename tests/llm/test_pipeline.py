import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece
from papyra.llm import quality, secrets
from pyspark.sql import functions as F

from test_overlap import slow_kept
from test_text_scans import slow_hits, slow_secrets

SF = "/root/testdata/sf0.001"


def test_pipeline_like_brute_force(spark, documents):
    model = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = [r for r in documents.collect()]
    scores = model.score(quality.matrix([r["text"].encode() for r in docs]))
    docs = [r for r, s in zip(docs, scores, strict=True) if s >= 0.3]
    stay = slow_kept({r["doc_id"]: r["text"] for r in docs})
    docs = [r for r in docs if r["doc_id"] in stay]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r for r in docs if not slow_hits(r["text"], items)[1]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for r in docs:
        text, at, out = r["text"], 0, ""
        for a, _, e in slow_secrets(text)[1]:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, e)
        ids = library.encode(out + text[at:], add_bos=True, add_eos=True)
        want[r["doc_id"]] = (len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids))
    got = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < documents.count()


def test_stages_keep_the_columns(spark, documents):
    docs = documents.withColumn("ids", F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_stages_take_odd_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()


def test_secret_stage_counts_anew(spark, documents):
    before = {r["doc_id"]: r for r in documents.collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(documents).collect()}
    for r in corpus_pipeline.secret_scan(spark, documents, SF).collect():
        assert r["n_chars"] == len(r["text"])
        if not spans[r["doc_id"]]:
            assert r == before[r["doc_id"]]


#: A function with 200 MB in small pieces, that holds itself in a cycle like a model with its memos; a later piece keeps the heap's end in use.
HELD = """
import re
from papyra.llm.common import _made

def resident():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

class Large:
    def __init__(self):
        self.memo, self.own = [bytes(1000) for _ in range(200_000)], self.run

    def run(self, texts):
        return texts

least = resident()
_made("large", Large, ())
held, last = resident(), bytes(1000)
_made("small", lambda: len, ())
print(least, held, resident())
"""


def test_a_worker_gives_back_what_an_earlier_stage_held():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(corpus_pipeline.__file__).parent)
    least, held, after = map(int, subprocess.run([sys.executable, "-c", HELD], cwd=root, capture_output=True, text=True, check=True).stdout.split())
    assert held - least > 150
    assert after - least < 50
