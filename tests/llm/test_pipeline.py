"""The pipeline against its stages done one by one by brute force, on the smallest tables; and its guard."""

import math
import subprocess
import sys

import pytest
import sentencepiece

import corpus_pipeline
from lakewright.llm import piece_codec, quality_model, secret_scan
from lakewright.llm.base import WordHashes
from lakewright.llm.decontaminate import op2_decontamination
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as near


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append((name, docs.columns, {r["doc_id"]: r for r in rows}))
    return out


def test_stages(stages, spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in raw.collect()}
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    (n1, c1, good), (n2, c2, single), (n3, c3, clean), (n4, c4, plain), (n5, _, ids) = stages
    assert [n1, n2, n3, n4, n5] == [n for n, _ in corpus_pipeline.STAGES] and c1 == c2 == c3 == c4 == raw.columns

    weights, bias = quality_model.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    hashes = WordHashes()

    def score(text):
        at = quality_model.places(text, hashes)
        return 1 / (1 + math.exp(-(bias + (float(weights[at].sum()) * quality_model.SCALE / len(at) if len(at) else 0.0))))

    assert set(good) == {i for i, r in before.items() if score(r["text"]) >= quality_model.KEEP_AT}
    classes = near([(i, r["text"]) for i, r in good.items()])
    assert set(single) == {i for i, least, _ in classes if i == least}
    assert set(clean) == {i for i, r in single.items() if not contaminated(r["text"], items)[4]}
    assert set(plain) == set(clean) == set(ids)
    for i, r in plain.items():
        base = secret_scan.base_spans(clean[i]["text"])
        assert all(clean[i]["text"][a:b] not in r["text"] or b - a < 12 for a, _, b in base) and r["n_chars"] == len(r["text"])
        if not base and not secret_scan.candidates(clean[i]["text"]):
            assert r["text"] == clean[i]["text"]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    assert all(r["ids"] == library.encode(plain[i]["text"]) and r["round_trip"] for i, r in ids.items())


def test_run_is_its_stages(stages, spark, sf_dir):
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: list(r["ids"]) for i, r in stages[-1][2].items()}


def test_most_clean_documents_stay(stages, spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = stages[0][2]
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) / len(good) > 0.95 and sum(i in kept for i in bad) / max(1, len(bad)) < 0.3


def test_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")]
    assert len([n for n in names if n[:2] == "op" and n[2].isdigit()]) == 13 and "pipeline" in names and op2_decontamination


def test_the_rest_works_without_this_subpackage():
    code = "import sys; sys.modules['lakewright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'lateral_top1' in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0]).returncode == 0
