"""Language identification: held-out accuracy, leakage, cases."""

import zstandard
from pyspark.sql import functions as F

from lakewright.llm import language_id as op
from lakewright.llm.quality_model import held_out

BIG, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    out = op.op6_language_id(spark, BIG).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL AND length(text) > 200")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 50 and right / n > 0.97
    bad = out.where("score < 0 OR score > 1 OR score IS NULL").count()
    assert bad == 0


def test_held_out_is_the_checksum(spark):
    import zlib

    got = {r["i"]: r["h"] for r in spark.range(500).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(500)}


def test_learns_only_from_the_other_folds(spark, docs_of):
    """Labels of held-out rows change nothing."""
    docs = docs_of(*[f"{'der die das und ist nicht ' if k % 2 else 'the of and is not that '}" * 20 for k in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    lied = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert op.samples(docs) == op.samples(lied) and set(op.samples(docs)) == {"de", "en"}


def test_cases(spark, docs_of):
    train = docs_of(*[("the cat sat on the mat and the dog ran " if k % 2 else "le chat est sur la table et le chien court ") * 5 for k in range(20)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    texts = op.samples(train)
    docs = docs_of(None, "", "123 ... !", "the dog sat on the mat and the cat ran", "le chien est sur la table et le chat court", "the dog sat on the mat and the cat ran", "x" * 100_000)
    got = op.identify_language(docs, texts).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got][:6] == ["und", "und", "und", "en", "fr", "en"] and got[0]["score"] == 0.0 and got[6]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got) and got[0]["rejected"]
    assert op.identify_language(docs.limit(0), texts).count() == 0
    assert {r["lang_pred"] for r in op.identify_language(docs, op.samples(train.where("lang IS NULL"))).collect()} == {"und"}


def test_every_language_is_learnt(docs_of):
    docs = docs_of(*[f"some text of language {k % 300 + 1000}" * 3 for k in range(1200)]).withColumn("lang", F.format_string("l%03d", F.col("doc_id") % 300))
    assert len(op.samples(docs)) == 300 and {len(x) for x in op.samples(docs, total_bytes=300 * 10).values()} == {10}


def test_a_scarce_language_takes_no_dictionaries_from_the_others():
    text = {"a": b"the cat and the dog " * 20_000, "b": b"le chat et le chien " * 20_000, "c": b"x y z"}
    held = op.Compressors(text)
    assert held.dicts == op.DICTS and [len(own) for _, own in held.by_language] == [6, 6, 1]
    assert held.predict("the dog and the cat")[0] == "a" and held.predict("le chien et le chat")[0] == "b"


def test_long_texts_teach(docs_of):
    docs = docs_of(*["une phrase assez longue " * 2000] * 8).withColumn("lang", F.lit("fr"))
    assert set(op.samples(docs)) == {"fr"}


def plain_sizes(texts, text, k):
    """Compressed bytes by language, one dictionary and chunk after the other."""
    data, out = op.letters(text), []
    for lang in sorted(texts):
        parts = [texts[lang][i : i + op.DICT_BYTES] for i in range(0, len(texts[lang]), op.DICT_BYTES)]
        made = zstandard.ZstdCompressionDict(parts[k % len(parts)], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(sum(len(zstandard.ZstdCompressor(dict_data=made, compression_params=op.PARAMETERS).compress(data[i : i + op.CHUNK])) for i in range(0, len(data), op.CHUNK)))
    return out


def test_against_plain_compression(spark):
    """Every text of the small table: the language with the fewest bytes, over as many dictionaries as the margin asks for."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = op.samples(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in op.op6_language_id(spark, SMALL).collect()}
    dicts = max(-(-len(x) // op.DICT_BYTES) for x in texts.values())
    for r in docs.select("doc_id", "text").collect()[::5]:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]] == "und"
            continue
        total = plain_sizes(texts, r["text"], 0)
        for k in range(1, dicts):
            first, second = sorted(total)[:2]
            if (second - first) / second >= 2 * op.NARROW:
                break
            total = [a + b for a, b in zip(total, plain_sizes(texts, r["text"], k), strict=True)]
        assert got[r["doc_id"]] == sorted(texts)[total.index(min(total))]


def test_repeated_rows_do_not_swell_the_sample(docs_of):
    pairs = [(k, f"text number {k} of many") for k in range(30)]
    once, often = docs_of(*pairs), docs_of(*pairs, *[(1, "text number 1 of many")] * 500)
    assert 0 < len(op.samples(often)["xx"]) <= len(op.samples(once)["xx"])


def test_a_repeated_row_does_not_crowd_out_its_language(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of(*((k, f"text {chr(97 + k % 26)} of some words {k}") for k in range(3000))).select("doc_id", "text", "lang")
    again = docs.unionAll(spark.range(1_000_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same row").alias("text"), F.lit("xx").alias("lang")))
    assert op.samples(again).keys() == {"xx"} and len(op.samples(again)["xx"]) > 1000
