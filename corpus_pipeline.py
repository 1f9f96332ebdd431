"""From raw documents to token ids: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What it
returns is computed when it is written, so each bounds the session's Arrow batches first.

Cases, stage by stage. Quality classifier: a null or empty text scores by the bias alone, as any other; repeated rows are
judged each on its own. Near-duplicates: rows without an id or a word all stay, of equal rows one; of a class the least
id, of several rows with that id the first. Decontamination: texts without words stay; an item without words is no
window. Secret scans: a null text stays null. SentencePiece: a null text gives no ids. An empty table gives an empty result in each. Other
columns of docs go along to the last stage, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm.base import Scratch, bound_batches, table
from lakewright.llm.decontaminate import uncontaminated
from lakewright.llm.ngram_join import one_of_each_class
from lakewright.llm.piece_codec import encode_pieces
from lakewright.llm.quality_model import accepted
from lakewright.llm.secret_scan import without_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go."""
    bound_batches(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near-duplicates stays, the one with the least id."""
    bound_batches(spark)
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold benchmark passages beyond the limit go; of the others, the passages."""
    bound_batches(spark)
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark."""
    bound_batches(spark)
    return without_secrets(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts."""
    bound_batches(spark)
    return encode_pieces(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", pieces),
]

#: SQL can't express trained models, chosen paths or piece encodings; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "corpus-pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
