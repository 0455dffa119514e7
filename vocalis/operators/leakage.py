"""Leakage checks: one DataFrame each, united into a report (severity, check, n, examples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.schemas import UNKNOWN_SPEAKER

HASH_BYTES = 262144
#: Examples that a check shows, where more than one.
EXAMPLES = {"utterance_overlap": 5, "speaker_conflict": 5}


class LeakageError(AssertionError):
    """The manifest's splits are not independent."""


def content_hash(content: Column, n: int = HASH_BYTES) -> Column:
    """SHA-1 of the first n bytes; empty if there are none to read."""
    return F.coalesce(F.sha1(F.substring(content, 1, n)), F.lit(""))


def utterance_overlap(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("utt_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def duplicate_ids(manifest: DataFrame) -> DataFrame:
    return manifest.agg((F.count("*") - F.countDistinct("utt_id")).alias("n_duplicates"))


def speaker_conflicts(manifest: DataFrame, train_splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """Known speakers in several splits: an error if a training split or one corpus alone is concerned, else a note."""
    known = manifest.where(F.col("speaker").isNotNull() & (F.col("speaker") != UNKNOWN_SPEAKER))
    sets = known.groupBy("speaker").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.collect_set("source_corpus")).alias("corpora")).where(F.size("splits") > 1)
    bad = F.arrays_overlap("splits", F.array(*map(F.lit, train_splits))) | (F.size("corpora") == 1)
    return sets.withColumn("severity", F.when(bad, "error").otherwise("note"))


def hash_groups(hashed: DataFrame, column: str = "hash") -> DataFrame:
    """Groups of more than one file of equal content, over all or within one split; files without hash are no group."""
    named = hashed.where(F.col(column) != "")
    # Ids of a hash are counted up by (hash, split, id) first, so that no task holds all ids of a frequent one.
    groups = named.groupBy(column).agg(F.count("*").alias("size"), F.countDistinct("split").alias("n_splits")).where("size > 1")
    return groups.join(least_ids(named.join(groups.select(column), column, "left_semi"), column, 3), column)


def least_ids(rows: DataFrame, key: str, n: int, id_col: str = "utt_id") -> DataFrame:
    """(key, examples): the n smallest distinct ids of each key, kept to n in every partial step."""
    salted = rows.select(key, F.col(id_col).cast("string").alias("_id")).distinct().withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(64)))

    def least(df: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_id"))
        return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")

    few = least(salted, [key, "_salt"])
    return least(few, [key]).groupBy(key).agg(F.sort_array(F.collect_list("_id")).alias("examples"))


def report(manifest: DataFrame, hashed: DataFrame | None = None, train_splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """hashed: manifest rows with `hash`, if contents are to be compared."""

    def part(df: DataFrame, severity: Column, check: str, example: Column, n: Column | None = None) -> DataFrame:
        """Counted by severity, with the EXAMPLES[check] smallest examples."""
        rows = df.withColumns({"severity": severity, "_one": example.cast("string")})
        totals = rows.groupBy("severity").agg(F.lit(check).alias("check"), (F.count("*") if n is None else n).cast("long").alias("n"))
        return totals.join(least_ids(rows, "severity", EXAMPLES.get(check, 1), "_one"), "severity").select("severity", "check", "n", "examples")

    error, note = F.lit("error"), F.lit("note")
    out = part(utterance_overlap(manifest), error, "utterance_overlap", F.col("utt_id"))
    out = out.unionByName(part(duplicate_ids(manifest).where("n_duplicates > 0"), error, "duplicate_ids", F.col("n_duplicates"), F.sum("n_duplicates")))
    out = out.unionByName(part(speaker_conflicts(manifest, train_splits), F.col("severity"), "speaker_conflict", F.concat(F.col("speaker"), F.lit(": "), F.array_join("splits", ", "))))
    if hashed is not None:
        groups = hash_groups(hashed)
        out = out.unionByName(part(groups.where("n_splits > 1"), error, "duplicate_audio", F.array_join("examples", ", ")))
        out = out.unionByName(part(groups.where("n_splits = 1"), note, "duplicates_within_split", F.array_join("examples", ", "), F.sum(F.col("size") - 1)))
        out = out.unionByName(part(hashed.where("hash = ''"), note, "unreadable", F.col("utt_id")))
    return out


def check(manifest: DataFrame, hashed: DataFrame | None = None, train_splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """The report; raises if it has errors."""
    out = report(manifest, hashed, train_splits)
    errors = out.where("severity = 'error'").collect()
    if errors:
        raise LeakageError("; ".join(f"{r.check}: {r.n}, for example {r.examples}" for r in errors))
    return out
