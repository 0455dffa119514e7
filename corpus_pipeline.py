"""The corpus pipeline: toxicity filter, near-duplicate filter, repeated passages, benchmark filter, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns
of `documents` (the last: packed pieces); run() writes each stage's rows as Parquet and reads them again.
Every stage gives no rows for no rows, takes null ids and texts and very long texts as they are, and leaves
further columns alone: while an operator works they bear names that no operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm import decontaminate, jaccard, packing, recompress, toxicity
from vocalis.llm.shared import drop, release, written
from vocalis.session import prepare, table

#: Near copies: words of a shingle and least Jaccard similarity in per cent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
_APART = "_own_"


def _set_apart(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under names of their own."""
    return docs.withColumnsRenamed({c: _APART + c for c in docs.columns if c not in ("doc_id", "text")})


def _as_before(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, of that order and those names."""
    return done.select(*(F.col(c if c in ("doc_id", "text") else _APART + c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours do not call toxic (score below a half).

    Null and empty texts get the share of toxic labels and stay unless that is a half or more; without
    labels all stay. Repeated rows stay or go together.
    """
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _as_before(toxicity.score_documents(_set_apart(docs), model, keep_text=True, evidence=False, clean_only=True), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that of the smallest id, among several texts of that id the one whose hash is smallest.

    Rows without words are no copies of each other and stay, but of rows equal in id and text one is left
    in any case. Null ids are larger than any and equal to each other.
    """
    prepare(spark)
    key = F.xxhash64(F.col("text").cast("string"))
    groups = jaccard.jaccard_components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT, key=key)
    keep = groups.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg((F.count("*") > 1).alias("_several"))
    rows = _set_apart(docs).withColumn("_text_key", key).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")))
    one = rows.where("NOT _several").unionByName(rows.where("_several").dropDuplicates(["doc_id", "text"]))
    return _as_before(one, docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; one of which nothing remains goes.

    A text that loses nothing, null and empty ones among them, stays as it is; another has its kept words
    joined by one space and n_chars counted anew. Repeated rows of 35 words or more remove each other.
    """
    prepare(spark)
    done = recompress.remove_repeats(_set_apart(docs), whole_as_is=True).where("n_removed = 0 OR n_removed < n_words").withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(_APART + "n_chars"))
        done = done.withColumn(_APART + "n_chars", chars)
    return _as_before(done, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, without a benchmark all stay, repeated rows stay or go together."""
    prepare(spark)
    found = decontaminate.find_contamination(_set_apart(docs), table(spark, sf_dir, "benchmark"), keep_text=True, clean_only=True)
    return _as_before(found, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens; null and empty texts are the end id alone, repeated rows are packed once each."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Neighbour votes and token ids are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
            release(spark)
        before = docs
    return docs
