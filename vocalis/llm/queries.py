"""The queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocalis.llm import bwtmerge, chat, decontaminate, editcount, html, itq, jaccard, packing, recompress, toxicity
from vocalis.session import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return editcount.count_after_edits(docs.withColumn("edits", editcount.standard_edits()))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeats_digest(recompress.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwtmerge.copies_digest(bwtmerge.remove_later_copies(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    probe = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(chat.canonical_turns(rows.select("conv_id", "turn", "role", "text").unionByName(more))))


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, evidence=False).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_edit_counts": op2_edit_counts,
    "op3_recompression": op3_recompression,
    "op4_bwt_merge": op4_bwt_merge,
    "op5_chat_format": op5_chat_format,
    "op6_itq": op6_itq,
    "op7_html_text": op7_html_text,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
}
