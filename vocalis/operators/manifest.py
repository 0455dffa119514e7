"""The manifest: finishing, union, storage and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.schemas import LABEL_IDS, MANIFEST, require_columns


def label_id(label: Column) -> Column:
    """0 for bonafide, 1 for spoof; anything else is an error."""
    out = F.lit(None).cast("long")
    for name, n in LABEL_IDS.items():
        out = F.when(F.lower(label) == name, F.lit(n).cast("long")).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("long"))


def finalize(rows: DataFrame, source_corpus: str, split: str) -> DataFrame:
    """Canonical columns in canonical order."""
    return rows.withColumns({"label": F.lower("label"), "label_id": label_id(F.col("label")), "source_corpus": F.lit(source_corpus), "split": F.lit(split)}).select(*MANIFEST.names)


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (f.select(*MANIFEST.names) for f in frames))


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def resolved_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def save(manifest: DataFrame, path: str, fmt: str = "parquet", by_split: bool = False) -> None:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    out = manifest.write.mode("overwrite")
    if by_split:
        out = out.partitionBy("split")
    if fmt == "csv":
        out.option("header", True).option("emptyValue", '""').csv(path)
    else:
        out.parquet(path)


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        got = spark.read.option("header", True).csv(path)
        require_columns(got, MANIFEST.names)
        return got.select(*(F.col(f.name).cast(f.dataType) for f in MANIFEST))
    if kind == "parquet":
        return require_columns(spark.read.parquet(path), MANIFEST.names).select(*MANIFEST.names)
    raise ValueError(f"unknown format {kind!r}")


def class_balance(manifest: DataFrame) -> DataFrame:
    """Utterances by corpus and split, a column for each label, their total and the share of spoof in per cent."""
    out = manifest.where("source_corpus IS NOT NULL AND split IS NOT NULL").groupBy("source_corpus", "split")
    out = out.agg(*(F.count_if(F.col("label") == n).alias(n) for n in LABEL_IDS))
    total = F.col("bonafide") + F.col("spoof")
    return out.withColumn("total", total).withColumn("spoof_pct", F.round(F.try_divide(100.0 * F.col("spoof"), total), 1))


def attack_by_split(manifest: DataFrame, splits: tuple[str, ...] | None = None) -> DataFrame:
    """Utterances by attack, a column for each split: the named ones, or all there are."""
    if splits is None:
        splits = tuple(r[0] for r in manifest.select("split").where("split IS NOT NULL").distinct().orderBy("split").collect())
    return manifest.groupBy("attack").agg(*(F.count_if(F.col("split") == s).alias(s) for s in splits))


def speakers_per_split(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.countDistinct("speaker").alias("n_speakers"))


def summarize(manifest: DataFrame) -> str:
    """A text report of the three small aggregates."""
    lines = [f"{manifest.count()} utterances", "", "corpus / split: bonafide, spoof, total, spoof %"]
    lines += [f"{r.source_corpus} / {r.split}: {r.bonafide}, {r.spoof}, {r.total}, {r.spoof_pct}" for r in class_balance(manifest).orderBy("source_corpus", "split").collect()]
    attacks = manifest.groupBy("attack").pivot("split").count().na.fill(0).orderBy("attack")
    lines += ["", "attack: " + ", ".join(attacks.columns[1:])] + [f"{r[0]}: " + ", ".join(map(str, r[1:])) for r in attacks.collect()]
    return "\n".join([*lines, "", "speakers"] + [f"{r.split}: {r.n_speakers}" for r in speakers_per_split(manifest).orderBy("split").collect()])


def write(manifest: DataFrame, folder: str, fmt: str = "parquet", hashed: DataFrame | None = None, train_splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """The sinks of a build: <folder>/all, <folder>/by_split partitioned by split, and <folder>/summary as text; the leakage report.

    Leakage errors raise before anything is written.
    """
    from vocalis.operators import leakage

    report = leakage.check(manifest, hashed, train_splits)
    save(manifest, f"{folder.rstrip('/')}/all", fmt)
    save(manifest, f"{folder.rstrip('/')}/by_split", fmt, by_split=True)
    write_text(manifest.sparkSession, f"{folder.rstrip('/')}/summary", summarize(manifest))
    return report


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small report as one text file below path."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is not in the listing."""
    return manifest.join(files.select("path"), "path", "left_anti")
