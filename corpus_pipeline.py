"""A corpus pipeline: toxicity, near duplicates, repeated passages, personal data, packing.

``STAGES`` lists (name, function).  Each function takes ``(spark, docs,
sf_dir)`` and works on every row that the stage before it kept; all but the
last return the columns of ``documents``.  ``n_chars`` follows the text.

Null and empty texts pass every stage (as empty ones from the third on) and
have length 0 in the last.  Rows with a null id are scored, cleaned and packed
like others but are nobody's near duplicate.  Of rows that repeat an id and
have words one stays.  Very long texts are whole.  Other columns than those of
``documents`` are dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import jaccard, packing, pii, suffix, toxicity
from wavemill.llm.common import checkpointed, executors_let_go, let_go, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns that stages work on, in a session whose batches are small and whose driver and executors have let go of the stage before."""
    let_go(spark)
    executors_let_go(spark)
    small_batches(spark)
    return docs.select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not call toxic."""
    docs = rows_of(spark, docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_toxic").where("_toxic < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of sets of five-word shingles linked at a similarity of 0.8 or more."""
    docs = rows_of(spark, docs)
    return jaccard.keep_one(docs, jaccard.similar_classes(docs, words=5, threshold=(80, 100)))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the whole characters in byte strings of 200 that occur again."""
    kept = suffix.remove_repeats(rows_of(spark, docs), whole_characters=True, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data, under the session's key or one drawn for the application."""
    done = pii.pseudonymise(rows_of(spark, docs), pii.application_key(spark))
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a token-budget batch of its length bucket."""
    return packing.pack(rows_of(spark, docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: The stages hold trained models and hashes that SQL cannot express; a test holds run() against brute force on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
