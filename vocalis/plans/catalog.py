"""Named queries over the driver's tables, each with the DuckDB SQL of the same result where SQL has it.

`documents` with `labels` stand for a manifest (source: speaker, lang: attack, text: contents),
`embeddings` for short signals, `lineitem` for scored rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.functions import signal
from vocalis.operators import experiments, features, leakage, manifest, metrics, models, qc, sampling
from vocalis.session import table
from vocalis.sources import protocol

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# ---- manifest -------------------------------------------------------------------------------------------

_SPLIT = "CASE doc_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'eval' ELSE 'train' END"
_M = f"""(SELECT printf('LA_T_%07d', doc_id) AS utt_id, 'data/' || source || '/' || doc_id || '.flac' AS path,
 CASE WHEN quality = 1 THEN 'bonafide' ELSE 'spoof' END AS label, (CASE WHEN quality = 1 THEN 0 ELSE 1 END)::BIGINT AS label_id,
 source AS speaker, lang AS attack, 'docs' AS source_corpus, {_SPLIT} AS split FROM documents JOIN labels USING (doc_id))"""


def _split():
    return F.when(F.col("doc_id") % 5 == 0, "val").when(F.col("doc_id") % 5 == 1, "eval").otherwise("train")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    label = F.when(F.col("quality") == 1, "bonafide").otherwise("spoof")
    path = F.concat(F.lit("data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".flac"))
    return rows.select(F.format_string("LA_T_%07d", "doc_id").alias("utt_id"), path.alias("path"), label.alias("label"), manifest.label_id(label).alias("label_id"), F.col("source").alias("speaker"), F.col("lang").alias("attack"), F.lit("docs").alias("source_corpus"), _split().alias("split"))


@query(f"SELECT * FROM {_M}")
def manifest_build(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(f"SELECT source_corpus, split, count(*) FILTER (label = 'bonafide') AS bonafide, count(*) FILTER (label = 'spoof') AS spoof, count(*) AS total, round(100.0 * count(*) FILTER (label = 'spoof') / count(*), 1) AS spoof_pct FROM {_M} GROUP BY 1, 2")
def class_balance_pivot(spark, sf_dir):
    return manifest.class_balance(_manifest(spark, sf_dir))


@query(f"SELECT attack, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'eval') AS eval FROM {_M} GROUP BY 1")
def attack_split_pivot(spark, sf_dir):
    return manifest.attack_by_split(_manifest(spark, sf_dir))


@query(f"SELECT split, count(DISTINCT speaker) AS n_speakers FROM {_M} GROUP BY 1")
def speakers_per_split(spark, sf_dir):
    return manifest.speakers_per_split(_manifest(spark, sf_dir))


@query(f"SELECT label, count(*) AS n FROM {_M} GROUP BY 1")
def value_counts_label(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1 ORDER BY chars DESC, source LIMIT 5")
def top_sources(spark, sf_dir):
    got = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))
    return got.orderBy(F.desc("chars"), "source").limit(5)


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def first_per_group(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("lang", "doc_id").alias("lang"))


@query("SELECT printf('LA_T_%07d', doc_id) AS utt_id, 'audio/' || printf('LA_T_%07d', doc_id) || '.flac' AS path, 'spoof' AS label, 1::BIGINT AS label_id, source AS speaker, lang AS attack, 'docs' AS source_corpus, 'train' AS split FROM documents SEMI JOIN labels USING (doc_id)")
def semi_join_labelled(spark, sf_dir):
    """A listing's utterances, those with a file alone."""
    utt = F.format_string("LA_T_%07d", "doc_id")
    listing = table(spark, sf_dir, "documents").select(utt.alias("utt_id"), F.col("source").alias("speaker"), F.col("lang").alias("attack"), F.lit("spoof").alias("label"))
    files = table(spark, sf_dir, "labels").select(F.concat(F.lit("/data/audio/"), utt, F.lit(".flac")).alias("path"))
    return protocol.from_protocol(listing, "/data/audio", "docs", "train", files, "/data")


@query("SELECT source, count(*) AS n_missing FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 1")
def anti_join_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"))
    return manifest.missing_files(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"))).groupBy("source").agg(F.count("*").alias("n_missing"))


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def lookup_join(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"SELECT split, label, count(*) AS n FROM {_M} WHERE split IN ('train', 'val') AND speaker <> 'src3' GROUP BY 1, 2")
def filter_predicates(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return m.where(F.col("split").isin("train", "val") & ~F.col("speaker").eqNullSafe("src3")).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(f"SELECT utt_id, label, split FROM {_M} WHERE split = 'train' UNION ALL SELECT utt_id, label, split FROM {_M} WHERE split = 'val'")
def union_train_val(spark, sf_dir):
    m = _manifest(spark, sf_dir).select("utt_id", "label", "split")
    return m.where("split = 'train'").unionByName(m.where("split = 'val'"))


@query(f"SELECT speaker FROM {_M} WHERE split = 'train' INTERSECT SELECT speaker FROM {_M} WHERE split IN ('val', 'eval')")
def split_intersect(spark, sf_dir):
    m = _manifest(spark, sf_dir).select("speaker", "split")
    return m.where("split = 'train'").select("speaker").intersect(m.where("split IN ('val', 'eval')").select("speaker"))


@query(f"SELECT attack, speaker FROM {_M} WHERE split = 'train' EXCEPT ALL SELECT attack, speaker FROM {_M} WHERE split IN ('val', 'eval')")
def split_except(spark, sf_dir):
    m = _manifest(spark, sf_dir).select("attack", "speaker", "split")
    return m.where("split = 'train'").drop("split").exceptAll(m.where("split IN ('val', 'eval')").drop("split"))


@query(f"SELECT utt_id, label AS true_label, label_id AS true_label_id, doc % 2 AS predicted_label_id, CASE WHEN doc % 2 = 1 THEN 'spoof' ELSE 'bonafide' END AS predicted_label, doc / 7.0 AS svm_score FROM (SELECT *, substr(utt_id, 6)::BIGINT AS doc FROM {_M})")
def prediction_table(spark, sf_dir):
    doc = F.substr("utt_id", F.lit(6)).cast("long")
    return experiments.predictions(_manifest(spark, sf_dir).withColumns({"pred": doc % 2, "score": doc / 7.0}))


# ---- protocol lines and paths -----------------------------------------------------------------------------

_LINES5 = "(SELECT o_orderkey, printf('LA_%04d LA_T_%07d  - ', o_custkey % 10000, o_orderkey) || CASE WHEN o_orderkey % 3 = 0 THEN '- bonafide ' WHEN o_orderkey % 11 = 1 THEN 'junk' ELSE printf('A%02d spoof', o_orderkey % 19) END AS value FROM orders)"
_LINES8 = "(SELECT o_orderkey, printf('LA_%04d DF_E_%07d nocodec corpus ', o_custkey % 10000, o_orderkey) || CASE WHEN o_orderkey % 4 = 0 THEN '- Bonafide' ELSE printf('A%02d SPOOF', o_orderkey % 19) END || ' notrim eval' AS value FROM orders)"


def _lines(spark, sf_dir, eight: bool) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    if eight:
        tail = F.concat(F.when(key % 4 == 0, "- Bonafide").otherwise(F.format_string("A%02d SPOOF", key % 19)), F.lit(" notrim eval"))
        head = F.format_string("LA_%04d DF_E_%07d nocodec corpus ", F.col("o_custkey") % 10000, key)
    else:
        tail = F.when(key % 3 == 0, "- bonafide ").when(key % 11 == 1, "junk").otherwise(F.format_string("A%02d spoof", key % 19))
        head = F.format_string("LA_%04d LA_T_%07d  - ", F.col("o_custkey") % 10000, key)
    return o.select("o_orderkey", F.concat(head, tail).alias("value"))


def _parsed_sql(lines: str) -> str:
    return rf"""SELECT utt_id, coalesce(sp, 'unknown') AS speaker, coalesce(atk, 'bonafide') AS attack, label FROM (
 SELECT list_filter(w, lambda t: regexp_full_match(t, '(LA|PA|DF)_[TDE]_[0-9]+'))[1] AS utt_id, list_filter(w, lambda t: regexp_full_match(t, '(LA|PA)_[0-9]{{4}}'))[1] AS sp,
  list_filter(w, lambda t: regexp_full_match(t, 'A[0-9]{{2}}'))[1] AS atk, lower(list_filter(w, lambda t: lower(t) IN ('bonafide', 'spoof'))[1]) AS label
 FROM (SELECT regexp_split_to_array(value, '\s+') AS w FROM {lines})) WHERE utt_id IS NOT NULL AND label IS NOT NULL"""


@query(_parsed_sql(_LINES5))
def protocol_parse_short(spark, sf_dir):
    return protocol.parsed(_lines(spark, sf_dir, False)).select("utt_id", "speaker", "attack", "label")


@query(_parsed_sql(_LINES8))
def protocol_parse_long(spark, sf_dir):
    return protocol.parsed(_lines(spark, sf_dir, True)).select("utt_id", "speaker", "attack", "label")


@query(f"SELECT count(*) AS n_lines, count(*) FILTER (value NOT LIKE '%bonafide%' AND value NOT LIKE '%spoof%') AS n_rejected FROM {_LINES5}")
def protocol_reject_count(spark, sf_dir):
    lines = _lines(spark, sf_dir, False)
    return lines.agg(F.count("*").alias("n_lines")).join(protocol.parsed(lines).agg(F.count("*").alias("_ok"))).select("n_lines", (F.col("n_lines") - F.col("_ok")).alias("n_rejected"))


# Directory names to be told apart, given to both sides as the input; the SQL states the rule in its own words.
_NAMES = ("LJSpeech-1.1", "ljspeech_MelGAN", "ljspeech_melgan_large", "LJSpeech_parallel_wavegan", "ljspeech_hifiGAN", "jsut_multi_band_melgan", "jsut_ver1.1", " JSUT ", "ljspeech_waveglow", "ljspeech_WaveRNN", "ljspeech_waveflow", "ljspeech_avocodo", "ljspeech_bigvgan", "jsut_diffwave", "some_vocoder", "common_voices_TTS", "stargan", "real_speech", "bonafide_set", "wavenet", "conformer_2", "tacotron", "misc")
_DIRS = f"(SELECT p_partkey, list_extract([{', '.join(repr(n) for n in _NAMES)}], (p_partkey % {len(_NAMES)})::INTEGER + 1) AS dir FROM part)"
_GENERATOR = "regexp_matches(lower(dir), 'melgan|wavegan|hifigan|waveglow|wavernn|waveflow|avocodo|bigvgan|diffwave|vocoder|tts|gan')"
_REAL = "regexp_matches(lower(dir), 'ljspeech|jsut|real|bonafide')"


def _dirs(spark, sf_dir):
    names = F.array(*map(F.lit, _NAMES))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_NAMES)).cast("int")).alias("dir"))


@query(f"SELECT p_partkey, CASE WHEN {_REAL} AND NOT {_GENERATOR} THEN 'bonafide' ELSE 'spoof' END AS label, regexp_replace(lower(trim(dir)), '^(ljspeech_|jsut_)', '') AS generator, NOT {_REAL} AND NOT {_GENERATOR} AS odd FROM {_DIRS}")
def directory_labels(spark, sf_dir):
    d = F.col("dir")
    return _dirs(spark, sf_dir).select("p_partkey", protocol.directory_label(d).alias("label"), protocol.generator_name(d).alias("generator"), protocol.unrecognised(d).alias("odd"))


@query(f"SELECT 'corpus/' || dir AS top, dir || '/f' || p_partkey AS utt_id, 'corpus/' || dir || '/wavs/f' || p_partkey || '.wav' AS path, CASE WHEN {_REAL} AND NOT {_GENERATOR} THEN 'bonafide' ELSE regexp_replace(lower(trim(dir)), '^(ljspeech_|jsut_)', '') END AS attack, CASE WHEN contains(lower(dir), 'ljspeech') THEN 'ljspeech' WHEN contains(lower(dir), 'jsut') THEN 'jsut' ELSE lower(dir) END AS speaker FROM {_DIRS}")
def directory_manifest(spark, sf_dir):
    files = _dirs(spark, sf_dir).select(F.concat(F.lit("/data/corpus/"), "dir", F.lit("/wavs/f"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("path"))
    m = protocol.from_directories(files, "/data/corpus", "c", "s", "/data")
    return m.select(F.regexp_extract("path", "^(corpus/[^/]*)", 1).alias("top"), "utt_id", "path", "attack", "speaker")


@query("SELECT count(*) FILTER (k = 0) AS n_rows, count(*) FILTER (k = 1) AS n_skipped, count(*) FILTER (k = 2) AS n_ignored, count(*) FILTER (k = 0) AS n_unknown_speaker FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 5 = 1 THEN 1 ELSE 0 END AS k FROM orders)")
def protocol_line_counts(spark, sf_dir):
    """Comments behind a tab and blank lines, lines without a label, and usable lines without a speaker."""
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, F.when(F.col("o_orderkey") % 2 == 0, "\t # LA_T_1 spoof").otherwise(" \t ")).when(k == 1, F.concat(F.lit("LA_T_"), F.col("o_orderkey").cast("string"), F.lit(" - -"))).otherwise(F.concat(F.lit("LA_T_"), F.col("o_orderkey").cast("string"), F.lit("\t- - SPOOF")))
    return protocol.line_counts(table(spark, sf_dir, "orders").select(value.alias("value")))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS relative, CASE WHEN starts_with(url, '/') THEN url ELSE '/root/' || url END AS resolved, regexp_extract(url, '([^/]+)$', 1) AS last_part FROM pages")
def path_relativize(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", manifest.relative_path(u, "https:").alias("relative"), manifest.resolved_path(u, "/root").alias("resolved"), F.regexp_extract(u, "([^/]+)$", 1).alias("last_part"))


@query("SELECT p_partkey, printf('mfcc_%02d', p_size) AS feature, replace(replace(lower(p_name), ' ', '_'), '+', '_plus_') AS slug, CASE WHEN p_size <= 1 THEN 1 ELSE pow(2, ceil(log2(p_size)))::BIGINT END AS pow2, round_even(p_size * 16001 / 1000.0, 0)::BIGINT AS samples FROM part")
def scalar_functions(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("mfcc_%02d", size).alias("feature"), F.replace(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("+"), F.lit("_plus_")).alias("slug"), signal.next_power_of_two(size).alias("pow2"), signal.ms_to_samples(size, 16001).alias("samples"))


# ---- leakage and sampling -----------------------------------------------------------------------------------

# In every ten documents two bear the id of the document before: once in the same split, once in another.
_ID = "doc_id - CASE WHEN doc_id % 10 IN (3, 6) THEN 1 ELSE 0 END"
_U = f"(SELECT printf('U%05d', {_ID}) AS utt_id, source AS speaker, lang AS source_corpus, {_SPLIT} AS split, coalesce(sha1(text), '') AS hash FROM documents)"


def _units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    own = F.col("doc_id") - F.when((F.col("doc_id") % 10).isin(3, 6), 1).otherwise(0)
    return d.select(F.format_string("U%05d", own).alias("utt_id"), F.col("source").alias("speaker"), F.col("lang").alias("source_corpus"), _split().alias("split"), F.coalesce(F.sha1(F.col("text").cast("binary")), F.lit("")).alias("hash"))


@query(f"SELECT utt_id, count(DISTINCT split) AS n_splits FROM {_U} GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_utt_overlap(spark, sf_dir):
    return leakage.utterance_overlap(_units(spark, sf_dir))


@query(f"SELECT count(*) - count(DISTINCT utt_id) AS n_duplicates FROM {_U}")
def duplicate_id_count(spark, sf_dir):
    return leakage.duplicate_ids(_units(spark, sf_dir))


@query(f"SELECT speaker, array_to_string(s, ',') AS splits, array_to_string(c, ',') AS corpora, CASE WHEN list_contains(s, 'train') OR len(c) = 1 THEN 'error' ELSE 'note' END AS severity FROM (SELECT speaker, list_sort(list(DISTINCT split)) AS s, list_sort(list(DISTINCT source_corpus)) AS c FROM {_U} WHERE speaker <> 'unknown' GROUP BY 1) WHERE len(s) > 1")
def leak_speaker_conflict(spark, sf_dir):
    got = leakage.speaker_conflicts(_units(spark, sf_dir))
    return got.withColumns({"splits": F.array_join("splits", ","), "corpora": F.array_join("corpora", ",")})


_H = f"(SELECT hash, count(*) AS size, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list(DISTINCT utt_id))[1:3], ',') AS examples FROM {_U} WHERE hash <> '' GROUP BY 1 HAVING count(*) > 1)"


@query(f"SELECT * FROM {_H} WHERE n_splits > 1")
def leak_duplicate_hash(spark, sf_dir):
    return leakage.hash_groups(_units(spark, sf_dir)).where("n_splits > 1").withColumn("examples", F.array_join("examples", ","))


@query(f"SELECT count(*) AS n_groups, coalesce(sum(size - 1), 0)::BIGINT AS excess FROM {_H} WHERE n_splits = 1")
def leak_within_split_dups(spark, sf_dir):
    return leakage.hash_groups(_units(spark, sf_dir)).where("n_splits = 1").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).cast("long").alias("excess"))


def _report_sql() -> str:
    overlap = f"(SELECT utt_id FROM {_U} GROUP BY 1 HAVING count(DISTINCT split) > 1)"
    spk = f"(SELECT speaker || ': ' || array_to_string(s, ', ') AS e, CASE WHEN list_contains(s, 'train') OR nc = 1 THEN 'error' ELSE 'note' END AS severity FROM (SELECT speaker, list_sort(list(DISTINCT split)) AS s, count(DISTINCT source_corpus) AS nc FROM {_U} WHERE speaker IS NOT NULL AND speaker <> 'unknown' GROUP BY 1) WHERE len(s) > 1)"
    h = f"(SELECT hash, count(*) AS size, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list(DISTINCT utt_id))[1:3], ', ') AS e FROM {_U} WHERE hash <> '' GROUP BY 1 HAVING count(*) > 1)"
    parts = (
        f"SELECT 'error' AS severity, 'utterance_overlap' AS \"check\", count(*) AS n, list_sort(list(DISTINCT utt_id))[1:5] AS x FROM {overlap}",
        f"SELECT 'error', 'duplicate_ids', count(*) - count(DISTINCT utt_id), [(count(*) - count(DISTINCT utt_id))::VARCHAR] FROM {_U}",
        f"SELECT severity, 'speaker_conflict', count(*), list_sort(list(DISTINCT e))[1:5] FROM {spk} GROUP BY 1",
        f"SELECT 'error', 'duplicate_audio', count(*), [min(e)] FROM {h} WHERE n_splits > 1",
        f"SELECT 'note', 'duplicates_within_split', coalesce(sum(size - 1), 0)::BIGINT, [min(e)] FROM {h} WHERE n_splits = 1",
        f"SELECT 'note', 'unreadable', count(*), [min(utt_id)] FROM {_U} WHERE hash = ''",
    )
    return f"SELECT severity, \"check\", n, array_to_string(x, ' | ') AS examples FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query(_report_sql())
def leakage_report(spark, sf_dir):
    u = _units(spark, sf_dir)
    return leakage.report(u, u).withColumn("examples", F.array_join("examples", " | "))


# A seeded permutation is beyond SQL, so the places it puts first are given for each number of speakers up to 64.
_FIRST = ", ".join(f"({n}, {int(i)})" for n in range(2, 65) for i in np.random.RandomState(1337).permutation(n)[: math.ceil(0.15 * n)])


@query(f"WITH m AS {_M}, s AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT speaker FROM m WHERE split = 'train')), v AS (SELECT speaker FROM s JOIN (VALUES {_FIRST}) f(n, i) USING (n, i)) SELECT CASE WHEN m.split = 'train' AND v.speaker IS NOT NULL THEN 'val' ELSE m.split END AS split, m.speaker, count(*) AS n FROM m LEFT JOIN v USING (speaker) GROUP BY ALL")
def group_disjoint_split(spark, sf_dir):
    m = sampling.speaker_disjoint_split(_manifest(spark, sf_dir))
    return m.groupBy("split", "speaker").agg(F.count("*").alias("n"))


@query(f"SELECT utt_id, split FROM (SELECT utt_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('1337:' || utt_id), utt_id) AS k FROM {_M}) WHERE k <= 20")
def sample_per_split(spark, sf_dir):
    return sampling.sample_per_split(_manifest(spark, sf_dir), 60).select("utt_id", "split")


@query(f"WITH m AS (SELECT *, CASE label WHEN 'spoof' THEN 'bonafide' ELSE 'spoof' END AS l FROM {_M}) SELECT utt_id, l AS label FROM m WHERE l = 'bonafide' UNION ALL (SELECT utt_id, l FROM m WHERE l = 'spoof' ORDER BY md5('1337:' || utt_id), utt_id LIMIT (SELECT count(*) FROM m WHERE l = 'bonafide'))")
def balanced_undersample(spark, sf_dir):
    # The rarer class must be bonafide here, so the two change places.
    m = _manifest(spark, sf_dir).withColumn("label", F.when(F.col("label") == "spoof", "bonafide").otherwise("spoof"))
    return sampling.balanced(m).select("utt_id", "label")


# ---- signals ------------------------------------------------------------------------------------------------

_X = "(SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def _signals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", signal.as_double(F.col("embedding")).alias("x"))


def _rounded(x, k: int = 5):
    return F.transform(x, lambda v: F.round(v, k))


def _tall(df: DataFrame, column: str = "y") -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("i", "v")).select("vec_id", "i", F.round("v", 5).alias("v"))


def _tall_sql(values: str, source: str = _X) -> str:
    return f"SELECT vec_id, (unnest(range(len(y))))::INTEGER AS i, round(unnest(y), 5) AS v FROM (SELECT vec_id, {values} AS y FROM {source})"


@query(_tall_sql("[CASE WHEN i = 1 THEN x[1] ELSE x[i] - 0.97 * x[i - 1] END FOR i IN range(1, len(x) + 1)]"))
def pre_emphasis(spark, sf_dir):
    return _tall(_signals(spark, sf_dir).select("vec_id", signal.pre_emphasis(F.col("x")).alias("y")))


@query(_tall_sql("[v / list_max([abs(u) FOR u IN x]) FOR v IN x]"))
def peak_normalize(spark, sf_dir):
    return _tall(_signals(spark, sf_dir).select("vec_id", signal.peak_normalize(F.col("x")).alias("y")))


@query(_tall_sql("[x[(i - 1) % 64 + 1] FOR i IN range(1, 101)]"))
def fix_length_repeat(spark, sf_dir):
    return _tall(_signals(spark, sf_dir).select("vec_id", signal.fix_length(F.col("x"), 100).alias("y")))


@query(_tall_sql("[coalesce(x[i], 0) FOR i IN range(1, 101)]"))
def fix_length_zeros(spark, sf_dir):
    return _tall(_signals(spark, sf_dir).select("vec_id", signal.fix_length(F.col("x"), 100, "zeros").alias("y")))


@query(_tall_sql("x[1:40]"))
def fix_length_head(spark, sf_dir):
    return _tall(_signals(spark, sf_dir).select("vec_id", signal.fix_length(F.col("x"), 40).alias("y")))


@query(_tall_sql("x[vec_id % 25 + 1 : vec_id % 25 + 40]"))
def fix_length_crop(spark, sf_dir):
    return _tall(_signals(spark, sf_dir).select("vec_id", signal.fix_length(F.col("x"), 40, start=(F.col("vec_id") % 25).cast("int")).alias("y")))


_FR = "(SELECT vec_id, label, k, x[8 * k + 1 : 8 * k + 16] AS f FROM (SELECT vec_id, label, x, unnest(range(7)) AS k FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)))"


def _frames(spark, sf_dir) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", "label", F.posexplode(signal.frames(F.col("x"), 16, 8)).alias("k", "f"))


@query(f"SELECT vec_id, k::INTEGER AS k, len(f)::INTEGER AS n, round(list_sum([f[i] * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 16)) FOR i IN range(1, 17)]), 5) AS windowed_sum FROM {_FR}")
def frame_signal(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", "k", F.size("f").alias("n"), F.round(signal.total(signal.windowed(F.col("f"), signal.hamming(16))), 5).alias("windowed_sum"))


@query(f"SELECT vec_id, k::INTEGER AS k, round(list_sum([v * v FOR v IN f]) / 16, 6) AS energy FROM {_FR}")
def frame_energy(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", "k", F.round(signal.mean_square(F.col("f")), 6).alias("energy"))


@query(f"SELECT vec_id, k::INTEGER AS k, list_sum([CASE WHEN (abs(f[i]) > 1e-10 AND f[i] < 0) <> (abs(f[i + 1]) > 1e-10 AND f[i + 1] < 0) THEN 1 ELSE 0 END FOR i IN range(1, 16)]) / 16.0 AS zcr FROM {_FR}")
def zero_crossing_rate(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", "k", (signal.zero_crossings(F.col("f")) / 16.0).alias("zcr"))


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) < 25 THEN 0 ELSE 1 + (count(*) - 25) // 10 END AS n_frames FROM events GROUP BY 1")
def num_frames(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("n_frames", signal.num_frames(F.col("n"), 25, 10))


@query("SELECT i::BIGINT AS i, round(0.54 - 0.46 * cos(2 * pi() * i / 400), 6) AS w FROM range(400) t(i)")
def hamming_window(spark, sf_dir):
    return spark.range(400).select(F.col("id").alias("i"), F.round(0.54 - 0.46 * F.cos(2 * math.pi * F.col("id") / 400), 6).alias("w"))


_MAG = "(SELECT vec_id, label, k, [sqrt(pow(list_sum([f[t] * cos(2 * pi() * b * (t - 1) / 16) FOR t IN range(1, 17)]), 2) + pow(list_sum([f[t] * sin(2 * pi() * b * (t - 1) / 16) FOR t IN range(1, 17)]), 2)) FOR b IN range(9)] AS m FROM " + _FR + ")"


def _spectra(spark, sf_dir) -> DataFrame:
    return _frames(spark, sf_dir).select("vec_id", "label", "k", signal.magnitudes(F.col("f"), 16).alias("m"))


@query(f"SELECT vec_id, k::INTEGER AS k, (unnest(range(9)))::INTEGER AS bin, round(unnest(m), 5) AS mag FROM {_MAG}")
def magnitude_spectrum(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", "k", F.posexplode("m").alias("bin", "mag")).withColumn("mag", F.round("mag", 5))


@query(f"SELECT vec_id, k::INTEGER AS k, round(coalesce(list_sum([m[b] * (b - 1) * 1000 FOR b IN range(1, 10)]) / nullif(list_sum(m), 0), 0), 3) AS centroid FROM {_MAG}")
def spectral_centroid(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", "k", F.round(signal.centroid(F.col("m"), 1000.0), 3).alias("centroid"))


@query(f"SELECT vec_id, k::INTEGER AS k, round(sqrt(list_sum([m[b] * pow((b - 1) * 1000 - c, 2) FOR b IN range(1, 10)]) / list_sum(m)), 3) AS bandwidth FROM (SELECT *, list_sum([m[b] * (b - 1) * 1000 FOR b IN range(1, 10)]) / list_sum(m) AS c FROM {_MAG})")
def spectral_bandwidth(spark, sf_dir):
    m = _spectra(spark, sf_dir).withColumn("c", signal.centroid(F.col("m"), 1000.0))
    return m.select("vec_id", "k", F.round(signal.bandwidth(F.col("m"), F.col("c"), 1000.0), 3).alias("bandwidth"))


@query(f"SELECT vec_id, k::INTEGER AS k, (list_position([list_sum(m[1:b]) >= 0.85 * list_sum(m) FOR b IN range(1, 10)], true) - 1)::INTEGER AS rolloff_bin FROM {_MAG}")
def spectral_rolloff(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", "k", signal.rolloff_bin(F.col("m")).alias("rolloff_bin"))


_FLUX = f"SELECT vec_id, k::INTEGER AS k, round(sqrt(sum(pow(p - q, 2))), 5) AS flux FROM (SELECT vec_id, k, b, v AS p, lag(v, 1, v) OVER (PARTITION BY vec_id, b ORDER BY k) AS q FROM (SELECT vec_id, k, unnest(range(9)) AS b, unnest([u / (list_sum(m) + 1e-10) FOR u IN m]) AS v FROM {_MAG})) GROUP BY 1, 2"


@query(_FLUX)
def spectral_flux(spark, sf_dir):
    from pyspark.sql import Window

    p = F.transform("m", lambda v: v / (signal.total(F.col("m")) + 1e-10))
    before = F.lag("p").over(Window.partitionBy("vec_id").orderBy("k"))
    got = _spectra(spark, sf_dir).select("vec_id", "k", p.alias("p")).withColumn("q", F.coalesce(before, "p"))
    return got.select("vec_id", "k", F.round(F.sqrt(signal.total(F.zip_with("p", "q", lambda a, b: F.pow(a - b, 2)))), 5).alias("flux"))


_BANK = [[max(0.0, min((b - i * 8 / 5) / (8 / 5), ((i + 2) * 8 / 5 - b) / (8 / 5))) for b in range(9)] for i in range(4)]


def _lit(m: list[list[float]]) -> str:
    return "[" + ", ".join("[" + ", ".join(map(repr, r)) + "]" for r in m) + "]"


_DCT = [[math.sqrt((1 if c == 0 else 2) / 4) * math.cos(math.pi * c * (2 * i + 1) / 8) for i in range(4)] for c in range(3)]
_LOG = f"(SELECT vec_id, k, [ln(greatest(list_sum([r[b] * m[b] * m[b] FOR b IN range(1, 10)]), 1e-10)) FOR r IN {_lit(_BANK)}] AS e FROM {_MAG})"


def _log_bands(spark, sf_dir) -> DataFrame:
    bands = [F.log(F.greatest(signal.total(F.zip_with("m", F.array(*map(F.lit, r)), lambda v, w: v * v * w)), F.lit(1e-10))) for r in _BANK]
    return _spectra(spark, sf_dir).select("vec_id", "k", F.array(*bands).alias("e"))


@query(f"SELECT vec_id, k::INTEGER AS k, (unnest(range(4)))::INTEGER AS band, round(unnest(e), 4) AS log_energy FROM {_LOG}")
def linear_filterbank_log(spark, sf_dir):
    return _log_bands(spark, sf_dir).select("vec_id", "k", F.posexplode("e").alias("band", "v")).select("vec_id", "k", "band", F.round("v", 4).alias("log_energy"))


@query(f"SELECT vec_id, k::INTEGER AS k, (unnest(range(3)))::INTEGER AS c, round(unnest([list_sum([d[i] * e[i] FOR i IN range(1, 5)]) FOR d IN {_lit(_DCT)}]), 4) AS v FROM {_LOG}")
def lfcc(spark, sf_dir):
    rows = [signal.total(F.zip_with("e", F.array(*map(F.lit, r)), lambda a, b: a * b)) for r in _DCT]
    return _log_bands(spark, sf_dir).select("vec_id", "k", F.posexplode(F.array(*rows)).alias("c", "v")).select("vec_id", "k", "c", F.round("v", 4).alias("v"))


@query(f"SELECT vec_id, round(avg(e), 6) AS energy_mean, round(stddev_pop(e), 6) AS energy_std FROM (SELECT vec_id, list_sum([v * v FOR v IN f]) / 16 AS e FROM {_FR}) GROUP BY 1")
def mean_std_pool(spark, sf_dir):
    e = _frames(spark, sf_dir).select("vec_id", signal.mean_square(F.col("f")).alias("e"))
    return e.groupBy("vec_id").agg(F.round(F.avg("e"), 6).alias("energy_mean"), F.round(F.stddev_pop("e"), 6).alias("energy_std"))


@query(f"SELECT vec_id, i, round((v - avg(v) OVER w) / (CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END), 5) + 0.0 AS z FROM (SELECT vec_id, (unnest(range(len(x))))::INTEGER AS i, unnest(x) AS v FROM {_X}) WINDOW w AS (PARTITION BY i)")
def standard_scale(spark, sf_dir):
    """All components, each by its own mean and deviation."""
    rows, columns = _labelled_vectors(spark, sf_dir)
    scaled = models.Scaler.fit(rows, columns).transform(rows)
    return scaled.select("vec_id", F.posexplode(F.array(*columns)).alias("i", "z")).select("vec_id", "i", F.round("z", 5).alias("z"))


# Signals of 6000 samples with silence of different lengths before and behind.
_LONG = f"(SELECT vec_id, [CASE WHEN i > 400 * (vec_id % 6) AND i <= 6000 - 500 * (vec_id % 5) THEN x[(i - 1) % len(x) + 1] ELSE 0 END FOR i IN range(1, 6001)] AS x FROM {_X})"


def _long_signals(spark, sf_dir) -> DataFrame:
    v = F.col("vec_id")
    return _signals(spark, sf_dir).select("vec_id", F.transform(signal.fix_length(F.col("x"), 6000), lambda s, i: F.when((i >= 400 * (v % 6)) & (i < 6000 - 500 * (v % 5)), s).otherwise(0.0)).alias("x"))


def _by_signal(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn of each signal, a tuple for schema's columns after vec_id."""

    def rows(parts):
        import pandas as pd

        for p in parts:
            done = [fn(np.asarray(x, np.float64)) for x in p["x"]]
            yield pd.DataFrame([(i, *d) for i, d in zip(p["vec_id"], done, strict=True)], columns=["vec_id", *(c.split()[0] for c in schema.split(", "))])

    return df.mapInPandas(rows, "vec_id long, " + schema)


_LEVEL = f"(SELECT vec_id, k, sqrt(list_sum([u * u FOR u IN p[512 * k + 1 : 512 * k + 2048]]) / 2048) AS r FROM (SELECT vec_id, unnest(range(12)) AS k, list_concat(list_concat([0.0::DOUBLE FOR i IN range(1024)], x), [0.0::DOUBLE FOR i IN range(1024)]) AS p FROM {_LONG}))"


@query(f"SELECT vec_id, round(1 - (least(6000, 512 * (max(k) + 1)) - 512 * min(k)) / 6000.0, 6) AS silence_ratio, (512 * min(k))::BIGINT AS first, least(6000, 512 * (max(k) + 1))::BIGINT AS last FROM (SELECT vec_id, k, 20 * log10(greatest(r, 1e-5) / greatest(max(r) OVER (PARTITION BY vec_id), 1e-5)) > -30 AS loud FROM {_LEVEL}) WHERE loud GROUP BY 1")
def trimmed_silence(spark, sf_dir):
    """The kernel's own frames: 2048 samples, 512 apart, 30 dB."""
    from vocalis.functions import kernels

    return _by_signal(_long_signals(spark, sf_dir), lambda x: (round(kernels.silence_ratio(x), 6), *kernels.trim_bounds(x)), "silence_ratio double, first long, last long")


@query(f"SELECT vec_id, round(list_sum([abs(u) FOR u IN y]), 2) AS total, round(y[700], 4) + 0.0 AS a, round(y[1601], 4) + 0.0 AS b, round(y[6100], 4) + 0.0 AS c, len(y)::BIGINT AS n FROM (SELECT vec_id, [e[(i - 1) % 6000 + 1] FOR i IN range(1, 7001)] AS y FROM (SELECT vec_id, [(CASE WHEN i = 1 THEN x[1] / top ELSE x[i] / top - 0.97 * (x[i - 1] / top) END)::FLOAT::DOUBLE FOR i IN range(1, 6001)] AS e FROM (SELECT vec_id, x, list_max([abs(u) FOR u IN x]) AS top FROM {_LONG})))")
def preprocess_signal(spark, sf_dir):
    """Peak normalisation, pre-emphasis and tiling to a fixed length by the kernel."""
    from vocalis.functions import kernels

    def measures(x):
        y = kernels.preprocess(x, 7000, peak=True).astype(np.float64)
        return float(np.abs(y).sum()), float(y[699]), float(y[1600]), float(y[6099]), len(y)

    got = _by_signal(_long_signals(spark, sf_dir), measures, "total double, a double, b double, c double, n long")
    # The kernel's samples are single precision, as those of the SQL.
    return got.withColumns({"total": F.round("total", 2), "a": F.round("a", 4), "b": F.round("b", 4), "c": F.round("c", 4)})


@query("SELECT doc_id, coalesce(sha1(text), '') AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", leakage.content_hash(F.col("text").cast("binary")).alias("hash"))


@query("SELECT regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS utt_id, url AS path FROM pages")
def file_stems(spark, sf_dir):
    return protocol.stems(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query(f"SELECT source_corpus, split, count(*) AS n FROM (SELECT source_corpus, split FROM {_M} UNION ALL SELECT 'again', split FROM {_M} WHERE split = 'val') GROUP BY ALL")
def concatenated_manifests(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    parts = [m, m.where("split = 'none'"), manifest.finalize(m.where("split = 'val'"), "again", "val")]
    return manifest.concat(parts).groupBy("source_corpus", "split").agg(F.count("*").alias("n"))


@query(f"SELECT vec_id, round(1 - (max(k) FILTER (loud) - min(k) FILTER (loud) + 1) / 7.0, 5) AS silence_ratio FROM (SELECT vec_id, k, 20 * log10(greatest(r, 1e-5) / greatest(max(r) OVER (PARTITION BY vec_id), 1e-5)) > -3 AS loud FROM (SELECT vec_id, k, sqrt(list_sum([v * v FOR v IN f]) / 16) AS r FROM {_FR})) GROUP BY 1")
def silence_ratio(spark, sf_dir):
    from pyspark.sql import Window

    r = _frames(spark, sf_dir).select("vec_id", "k", F.greatest(F.sqrt(signal.mean_square(F.col("f"))), F.lit(1e-5)).alias("r"))
    loud = r.withColumn("loud", 20 * F.log10(F.col("r") / F.max("r").over(Window.partitionBy("vec_id"))) > -3).where("loud")
    return loud.groupBy("vec_id").agg(F.round(1 - (F.max("k") - F.min("k") + 1) / 7.0, 5).alias("silence_ratio"))


_Q = "(SELECT vec_id, label, 20 * log10(sqrt(list_sum([v * v FOR v IN x]) / len(x))) AS db, list_max([abs(v) FOR v IN x]) AS peak, list_sum(x) / len(x) AS dc, list_sum([CASE WHEN abs(v) >= 0.3 THEN 1 ELSE 0 END FOR v IN x]) / len(x)::DOUBLE AS clip FROM " + _X + ")"


def _measures(spark, sf_dir) -> DataFrame:
    x = F.col("x")
    return _signals(spark, sf_dir).select("vec_id", "label", signal.rms_dbfs(x).alias("db"), signal.peak(x).alias("peak"), (signal.total(x) / F.size(x)).alias("dc"), (F.size(F.filter(x, lambda v: F.abs(v) >= 0.3)) / F.size(x)).alias("clip"))


@query(f"SELECT vec_id, round(db, 4) AS rms_dbfs, round(peak, 5) AS peak, round(dc, 5) AS dc_offset, clip AS clipping_rate FROM {_Q}")
def qc_signal_measures(spark, sf_dir):
    return _measures(spark, sf_dir).select("vec_id", F.round("db", 4).alias("rms_dbfs"), F.round("peak", 5).alias("peak"), F.round("dc", 5).alias("dc_offset"), F.col("clip").alias("clipping_rate"))


_QC = f"(SELECT CASE WHEN vec_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN label >= 5 THEN 'spoof' ELSE 'bonafide' END AS label, vec_id % 17 <> 0 AND NOT (label = 7) AS ok, CASE WHEN vec_id % 4 = 0 THEN 8000 ELSE 16000 END AS rate, (vec_id % 50 + 1) / 8.0 AS dur, db, peak, dc, clip, (vec_id % 9) / 10.0 AS silence FROM {_Q})"


@query(f"SELECT split, label, count(*) AS n_files, count(*) FILTER (NOT ok) AS n_corrupt, coalesce(string_agg(DISTINCT rate::VARCHAR, ',' ORDER BY rate::VARCHAR) FILTER (ok), '-') AS sample_rates, round(avg(dur) FILTER (ok), 3) AS dur_mean_s, round(median(dur) FILTER (ok), 3) AS dur_median_s, round(min(dur) FILTER (ok), 3) AS dur_min_s, round(max(dur) FILTER (ok), 3) AS dur_max_s, round(avg(db) FILTER (ok), 2) AS rms_dbfs_mean, round(avg(peak) FILTER (ok), 4) AS peak_mean, round(avg(dc) FILTER (ok), 8) AS dc_offset_mean, round(max(abs(dc)) FILTER (ok), 8) AS dc_offset_absmax, round(avg(clip) FILTER (ok), 8) AS clipping_rate_mean, round(avg(silence) FILTER (ok), 4) AS silence_ratio_mean FROM {_QC} GROUP BY 1, 2")
def qc_summary(spark, sf_dir):
    v = F.col("vec_id")
    rows = _measures(spark, sf_dir).select(F.when(v % 3 == 0, "val").otherwise("train").alias("split"), F.when(F.col("label") >= 5, "spoof").otherwise("bonafide").alias("label"), ((v % 17 != 0) & (F.col("label") != 7)).alias("ok"), F.when(v % 4 == 0, 8000).otherwise(16000).alias("sample_rate"), ((v % 50 + 1) / 8.0).alias("duration_s"), F.col("db").alias("rms_dbfs"), "peak", F.col("dc").alias("dc_offset"), F.col("clip").alias("clipping_rate"), ((v % 9) / 10.0).alias("silence_ratio"))
    # These three are not rounded by the operator; sums in another order differ in their last bits.
    return qc.summarize(rows).withColumns({c: F.round(c, 8) for c in ("dc_offset_mean", "dc_offset_absmax", "clipping_rate_mean")})


@query("SELECT lang AS label, least(floor((n_chars - lo) * 40.0 / (hi - lo)), 39)::BIGINT AS bin, count(*) AS n FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) GROUP BY 1, 2")
def hist_duration(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.col("n_chars").cast("double").alias("v"))
    return qc.histogram(d, "v", 40)


@query("SELECT l_returnflag AS label, least(floor(l_discount * 35 / 0.1), 34)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2")
def hist_level(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_discount").alias("v"))
    return qc.histogram(li, "v", 35, 0.0, 0.1)


@query("SELECT l_returnflag, l_linestatus, n, (sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) - n)::BIGINT AS bottom FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def class_balance_stacked(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.withColumn("bottom", (F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("l_linestatus")) - F.col("n")).cast("long"))


# ---- metrics and models ----------------------------------------------------------------------------------

_S = "(SELECT l_orderkey, l_shipdate, (CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS y, l_quantity + 40 * l_discount + (CASE WHEN l_linestatus = 'O' THEN 5 ELSE 0 END) AS score FROM lineitem)"


def _scores(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return li.select(F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("y"), (F.col("l_quantity") + 40 * F.col("l_discount") + F.when(F.col("l_linestatus") == "O", 5).otherwise(0)).alias("score"))


_C = f"(SELECT count(*) FILTER (y = 1 AND score > 30) AS tp, count(*) FILTER (y = 0 AND score > 30) AS fp, count(*) FILTER (y = 0 AND score <= 30) AS tn, count(*) FILTER (y = 1 AND score <= 30) AS fn FROM {_S})"


@query(f"SELECT * FROM {_C}")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_scores(spark, sf_dir).withColumn("pred", (F.col("score") > 30).cast("int")))


@query(f"SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM {_C}")
def binary_metrics(spark, sf_dir):
    got = metrics.binary_metrics(metrics.confusion(_scores(spark, sf_dir).withColumn("pred", (F.col("score") > 30).cast("int"))))
    return got.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


_RUN = f"(SELECT score, sum(p) OVER w AS tps, sum(n) OVER w AS fps, p, n, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS k FROM (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM {_S} GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"


@query(f"SELECT round(sum(n * (tps - p / 2)) / (sum(p) * sum(n)::DOUBLE), 8) AS roc_auc FROM {_RUN}")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scores(spark, sf_dir)).select(F.round("roc_auc", 8).alias("roc_auc"))


_ROC = f"(SELECT score AS threshold, tps::BIGINT AS tps, fps::BIGINT AS fps, tps / max(tps) OVER () AS tpr, fps / max(fps) OVER () AS fpr FROM (SELECT *, k = 1 OR np IS NULL OR np <> p OR nn <> n AS keep FROM {_RUN}) QUALIFY keep UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0.0, 0.0)"


@query(f"SELECT round(threshold, 6) AS threshold, tps, fps, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr FROM {_ROC}")
def roc_curve_thinned(spark, sf_dir):
    return metrics.roc_points(_scores(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), "tps", "fps", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@query(f"SELECT round((fpr + 1 - tpr) / 2, 8) AS eer, round(threshold, 6) AS eer_threshold FROM {_ROC} ORDER BY abs(fpr - (1 - tpr)), threshold DESC LIMIT 1")
def eer(spark, sf_dir):
    got = metrics.equal_error_rate(_scores(spark, sf_dir))
    return got.select(F.round("eer", 8).alias("eer"), F.round("eer_threshold", 6).alias("eer_threshold"))


_K = "(SELECT l_shipmode_k AS model, l_linestatus AS features, round(avg(l_discount), 6) AS roc_auc, round(avg(l_tax), 6) AS eer FROM (SELECT *, 'm' || (l_suppkey % 5) AS l_shipmode_k FROM lineitem WHERE l_returnflag {op} 'N') GROUP BY 1, 2)"


@query("SELECT model, features, a.roc_auc AS val_roc_auc, a.eer AS val_eer, b.roc_auc AS eval_roc_auc, b.eer AS eval_eer, round(b.roc_auc - a.roc_auc, 6) AS auc_change, round(b.eer - a.eer, 6) AS eer_change FROM " + _K.format(op="=") + " a JOIN " + _K.format(op="<>") + " b USING (model, features)")
def compare_conditions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("model", F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")))

    def results(rows):
        return rows.groupBy("model", F.col("l_linestatus").alias("features")).agg(F.round(F.avg("l_discount"), 6).alias("roc_auc"), F.round(F.avg("l_tax"), 6).alias("eer"))

    got = metrics.compare(results(li.where("l_returnflag = 'N'")), results(li.where("l_returnflag <> 'N'")), "val", "eval")
    return got.withColumns({c: F.round(c, 6) for c in ("auc_change", "eer_change")})


@query("SELECT model, features, a.roc_auc AS val_roc_auc, a.eer AS val_eer, b.roc_auc AS eval_roc_auc, b.eer AS eval_eer, round(a.roc_auc - b.roc_auc, 6) AS roc_auc_drop, round(b.eer - a.eer, 6) AS eer_increase FROM " + _K.format(op="=") + " a JOIN " + _K.format(op="<>") + " b USING (model, features)")
def validation_against_evaluation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("model", F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")))

    def results(rows):
        return rows.groupBy("model", F.col("l_linestatus").alias("features")).agg(F.round(F.avg("l_discount"), 6).alias("roc_auc"), F.round(F.avg("l_tax"), 6).alias("eer"))

    got = metrics.changes(results(li.where("l_returnflag = 'N'")), results(li.where("l_returnflag <> 'N'")), "val", "eval", drop=True)
    return got.withColumns({c: F.round(c, 6) for c in ("roc_auc_drop", "eer_increase")})


def _feature_sql() -> str:
    """All 92 features by definition: the transform as dot products with sines and cosines, banks and DCT from their formulas."""
    hz = "b * 8000.0 / 256"
    triangle = "greatest(0, least(({f} - lo) / (mid - lo), (hi - {f}) / (hi - mid)))".format(f=hz)
    dct = "sqrt(2.0 / {n}) * (CASE WHEN c = 0 THEN 1 / sqrt(2.0) ELSE 1 END) * cos(pi() * c * (2 * j + 1) / (2 * {n}))"
    names = [*(f"mfcc_{i:02d}" for i in range(1, 21)), *(f"lfcc_{i:02d}" for i in range(1, 21)), "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flux", "short_time_energy", "zero_crossing_rate"]
    columns = ", ".join(f"round(max({s}) FILTER (name = '{n}'), 4) + 0.0 AS {n}_{t}" for s, t in (("a", "mean"), ("d", "std")) for n in names)
    return f"""
WITH s AS (SELECT vec_id, [x[(i - 1) % len(x) + 1] FOR i IN range(1, 1601)] AS x FROM {_X}),
w AS (SELECT list(CASE WHEN i BETWEEN 56 AND 455 THEN 0.5 - 0.5 * cos(2 * pi() * (i - 56) / 400) ELSE 0 END ORDER BY i) AS w FROM range(512) t(i)),
f AS (SELECT vec_id, k, [u[1] * u[2] FOR u IN list_zip(p[160 * k + 1 : 160 * k + 512], w)] AS f FROM (SELECT vec_id, unnest(range(11)) AS k, list_concat(list_concat([0.0::DOUBLE FOR i IN range(256)], x), [0.0::DOUBLE FOR i IN range(256)]) AS p FROM s), w),
basis AS (SELECT b, list(cos(2 * pi() * b * t / 512) ORDER BY t) AS c, list(sin(2 * pi() * b * t / 512) ORDER BY t) AS s FROM range(257) x(b), range(512) y(t) GROUP BY b),
m AS MATERIALIZED (SELECT vec_id, k, b, sqrt(pow(list_dot_product(f, c), 2) + pow(list_dot_product(f, s), 2)) AS m FROM f, basis),
mels AS (SELECT i, CASE WHEN q < 15 THEN q * 200 / 3 ELSE 1000 * exp((q - 15) * ln(6.4) / 27) END AS e FROM (SELECT i, i * (15 + 27 * ln(8.0) / ln(6.4)) / 129 AS q FROM range(130) t(i))),
mel AS (SELECT j, b, {triangle} * 2 / (hi - lo) AS v FROM (SELECT i AS j, e AS lo, lead(e) OVER (ORDER BY i) AS mid, lead(e, 2) OVER (ORDER BY i) AS hi FROM mels), range(257) t(b) WHERE j < 128),
lin AS (SELECT j, b, {triangle} AS v FROM (SELECT j, j * 8000.0 / 41 AS lo, (j + 1) * 8000.0 / 41 AS mid, (j + 2) * 8000.0 / 41 AS hi FROM range(40) t(j)), range(257) u(b)),
me AS (SELECT vec_id, k, j, 10 * log10(greatest(sum(v * m * m), 1e-10)) AS e FROM mel JOIN m USING (b) GROUP BY ALL),
md AS (SELECT vec_id, k, list(e ORDER BY j) AS e FROM (SELECT vec_id, k, j, greatest(e, max(e) OVER (PARTITION BY vec_id) - 80) AS e FROM me) GROUP BY ALL),
ld AS (SELECT vec_id, k, list(e ORDER BY j) AS e FROM (SELECT vec_id, k, j, ln(greatest(sum(v * m * m), 1e-10)) AS e FROM lin JOIN m USING (b) GROUP BY ALL) GROUP BY ALL),
d128 AS (SELECT c, list({dct.format(n=128)} ORDER BY j) AS d FROM range(20) t(c), range(128) u(j) GROUP BY c),
d40 AS (SELECT c, list({dct.format(n=40)} ORDER BY j) AS d FROM range(20) t(c), range(40) u(j) GROUP BY c),
tot AS (SELECT vec_id, k, sum(m) AS s FROM m GROUP BY ALL),
cen AS (SELECT vec_id, k, any_value(s) AS s, sum(CASE WHEN s > 0 THEN m / s ELSE 0 END * {hz}) AS c FROM m JOIN tot USING (vec_id, k) GROUP BY ALL),
ban AS (SELECT vec_id, k, sqrt(sum(CASE WHEN s > 0 THEN m / s ELSE 0 END * pow({hz} - c, 2))) AS v FROM m JOIN cen USING (vec_id, k) GROUP BY ALL),
rol AS (SELECT vec_id, k, coalesce(min({hz}) FILTER (run >= 0.85 * s), 0) AS v FROM (SELECT vec_id, k, b, sum(m) OVER (PARTITION BY vec_id, k ORDER BY b) AS run FROM m) JOIN tot USING (vec_id, k) GROUP BY ALL),
flu AS (SELECT vec_id, k, sqrt(sum(pow(q - before, 2))) AS v FROM (SELECT vec_id, k, q, lag(q, 1, q) OVER (PARTITION BY vec_id, b ORDER BY k) AS before FROM (SELECT vec_id, k, b, m / (s + 1e-10) AS q FROM m JOIN tot USING (vec_id, k))) GROUP BY ALL),
ene AS (SELECT vec_id, k, list_sum([u * u FOR u IN p[160 * k + 1 : 160 * k + 400]]) / 400 AS v FROM (SELECT vec_id, unnest(range(11)) AS k, list_concat(list_concat([0.0::DOUBLE FOR i IN range(200)], x), [0.0::DOUBLE FOR i IN range(200)]) AS p FROM s)),
zer AS (SELECT vec_id, k, list_sum([CASE WHEN u[1] <> u[2] THEN 1 ELSE 0 END FOR u IN list_zip(g[160 * k + 1 : 160 * k + 399], g[160 * k + 2 : 160 * k + 400])]) / 400.0 AS v FROM (SELECT vec_id, unnest(range(11)) AS k, [abs(u) > 1e-10 AND u < 0 FOR u IN p] AS g FROM (SELECT vec_id, list_concat(list_concat([x[1] FOR i IN range(200)], x), [x[1600] FOR i IN range(200)]) AS p FROM s))),
v AS (SELECT vec_id, k, printf('mfcc_%02d', c + 1) AS name, list_dot_product(e, d) AS v FROM md, d128 UNION ALL SELECT vec_id, k, printf('lfcc_%02d', c + 1), list_dot_product(e, d) FROM ld, d40
 UNION ALL SELECT vec_id, k, 'spectral_centroid', c FROM cen UNION ALL SELECT vec_id, k, 'spectral_bandwidth', v FROM ban UNION ALL SELECT vec_id, k, 'spectral_rolloff', v FROM rol UNION ALL SELECT vec_id, k, 'spectral_flux', v FROM flu
 UNION ALL SELECT vec_id, k, 'short_time_energy', v FROM ene UNION ALL SELECT vec_id, k, 'zero_crossing_rate', v FROM zer)
SELECT vec_id, {columns} FROM (SELECT vec_id, name, avg(v) AS a, stddev_pop(v) AS d FROM v GROUP BY ALL) GROUP BY vec_id"""


@query(_feature_sql())
def feature_vector_92(spark, sf_dir):
    """Tiled embeddings as signals of 1600 samples; rounded, as sums in another order differ in their last bits."""
    x = _signals(spark, sf_dir).select("vec_id", signal.fix_length(F.col("x"), 1600).alias("x"))
    got = features.from_samples(x, "vec_id", "x")
    return got.select("vec_id", *(F.round(c, 4).alias(c) for c in got.columns[1:]))


def _labelled_vectors(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Rows with a column for each component, as many as the longest embedding has, and those columns."""
    v = table(spark, sf_dir, "embeddings")
    columns = [f"e{i}" for i in range(v.agg(F.max(F.size("embedding"))).first()[0])]
    rows = v.select("vec_id", (F.col("label") >= 5).cast("int").alias("label_id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)))
    # As they are, but new columns to the optimizer: with 64 aliases under a score the driver ran out of memory (presumably constraint inference).
    return rows.mapInArrow(lambda batches: batches, rows.schema), columns


@query()
def linear_svm(spark, sf_dir):
    rows, columns = _labelled_vectors(spark, sf_dir)
    test = rows.where("vec_id % 4 = 0")
    return models.evaluate(models.linear_svm(rows.where("vec_id % 4 <> 0"), columns).score(test), "SVM", f"e{len(columns)}")


@query()
def random_forest(spark, sf_dir):
    rows, columns = _labelled_vectors(spark, sf_dir)
    fitted = models.random_forest(rows.where("vec_id % 4 <> 0"), columns)
    return models.evaluate(models.forest_score(fitted, rows.where("vec_id % 4 = 0")), "Random Forest", f"e{len(columns)}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_balance_pivot(spark, sf_dir)



