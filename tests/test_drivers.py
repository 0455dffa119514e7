from __future__ import annotations

import os
import shutil
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis import config
from vocalis.operators import experiments, features, leakage, manifest, metrics, models, qc, sampling
from vocalis.schemas import FEATURE_META, FEATURES, MANIFEST
from vocalis.sources import audio, corpora, protocol, synthetic


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    """A configuration, and the generated corpus written to its folder."""
    root = tmp_path_factory.mktemp("project")
    paths = {"asvspoof2019_la": "data/LA", "asvspoof2021_df": "data/DF", "wavefake": "data/WF", "synthetic": "data/demo", "reports": "reports"}
    (root / "config.json").write_text(__import__("json").dumps({"seed": 7, "paths": paths, "synthetic": {"n_speakers": 4}}))
    cfg = config.load_config(str(root / "config.json"))
    made = synthetic.demo_corpus(spark, cfg.synthetic.n_speakers, 4, 0.6, cfg.seed, jitter=0.2)
    written = synthetic.write_demo(made, cfg.path("synthetic"))
    assert written.count() == 16
    return cfg


def files_of(spark, m, root):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("full"), "content")
    return m.select("path", manifest.resolved_path(F.col("path"), root).alias("full")).join(found, "full").select("path", "content")


def test_configuration(project, tmp_path):
    assert project.seed == 7 and project.synthetic.n_speakers == 4 and project["audio"]["sample_rate"] == 16000 and "qc" in project and project.get("none", 1) == 1
    assert project.path("reports", "a.csv") == os.path.join(project.project_root, "reports", "a.csv") and os.path.isdir(project.ensure_dir("reports", "x"))
    project.paths.far = "s3://bucket/x"
    assert project.path("far", "y") == "s3://bucket/x/y" and project.to_dict()["paths"]["far"] == "s3://bucket/x" and set(iter(project)) >= {"paths", "seed"}
    assert config.frame_params(project) == (400, 160, 512)
    with pytest.raises(AttributeError, match="none"):
        _ = project.none
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "no.json"))
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        config.load_config(str(tmp_path / "list.json"))
    config.set_seed(3)
    first = np.random.rand()
    config.set_seed(3)
    assert np.random.rand() == first and config.new_rng(3).random() == config.new_rng(3).random()


def test_voices_follow_the_model():
    f = np.array([0.0, 700.0, 745.0])
    shape = synthetic.formant_envelope(f, (700.0,), (90.0,))
    raw = np.array([1 / (1 + (700 / 45) ** 2) / (1 + 1 / 100), 1 / (1 + 7), 0.5 / (1 + 7.45)])
    assert np.allclose(shape, raw / raw.max())
    assert synthetic.speaker_profile(3)["f0"] == 159.0 and synthetic.speaker_profile(0)["formants"][0] == 700 * (1 - 0.175)
    env = synthetic.syllables(32000, np.random.default_rng(1))
    assert env[:1000].max() == 0 and env[-1000:].max() == 0 and 0.9 < env.max() <= 1 and env[8000:24000].min() >= 0.1 - 1e-9
    assert synthetic.spoof_places(15) == [0, 2, 4, 6, 8, 10, 12, 14] and synthetic.spoof_places(4, 0) == []
    for fake in (False, True):
        x = synthetic.synthesize(fake, synthetic.speaker_profile(2), 1.5, np.random.default_rng(2))
        level = np.abs(np.fft.rfft(x.astype(np.float64))) ** 2
        assert x.shape == (24000,) and 0.25 <= np.abs(x).max() <= 0.65 + 1e-6
        assert (level[11700:].mean() / level[9000:10000].mean() < 0.02) == fake
    assert len(synthetic.synthesize(True, synthetic.speaker_profile(0), 0.0, np.random.default_rng(0))) == 0


def test_demo_corpus_becomes_a_manifest(spark, project):
    m = corpora.demo(spark, project)
    rows = m.orderBy("utt_id").collect()
    assert m.columns == MANIFEST.names and len(rows) == 16 and rows[0].path == "data/demo/flac/LA_T_0000001.flac" and {r.split for r in rows} == {"train"}
    assert {r.speaker for r in rows} == {f"LA_{i:04d}" for i in range(4)} and {r.attack for r in rows} == {"A01", "A02", "bonafide"}
    spoof = [r.attack for r in rows if r.label == "spoof"]
    assert spoof == ["A01", "A02"] * 4
    with open(os.path.join(project.path("synthetic"), "flac", "LA_T_0000002.flac"), "rb") as f:
        x, rate = audio.decode(f.read())
    made = synthetic.demo_corpus(spark, 4, 4, 0.6, 7, jitter=0.2).where("utt_id = 'LA_T_0000002'").first()
    assert rate == 16000 and np.abs(x[0] - np.array(made.samples)).max() < 1e-4


def test_corpora_by_layout(spark, project):
    la, demo = project.path("asvspoof2019_la"), project.path("synthetic")
    with pytest.warns(UserWarning, match="no 2019 corpus"):
        assert corpora.logical_access_2019(spark, project).count() == 0
    os.makedirs(f"{la}/{corpora.PROTOCOLS_2019}")
    shutil.copytree(f"{demo}/flac", f"{la}/ASVspoof2019_LA_train/deep/flac")
    shutil.copytree(f"{demo}/flac", f"{la}/ASVspoof2019_LA_train/also")
    with open(f"{demo}/protocol.txt") as f:
        lines = f.read().splitlines()
    with open(f"{la}/{corpora.PROTOCOLS_2019}/{corpora.PROTOCOL_2019['train']}", "w") as f:
        f.write("\n".join([*lines, "LA_0099 LA_T_9999999 - - bonafide", "junk", "LA_T_0000001x - -"]) + "\n")
    assert corpora.find_audio_dir(spark, f"{la}/ASVspoof2019_LA_train") == f"{la}/ASVspoof2019_LA_train/deep/flac"
    assert corpora.find_audio_dir(spark, f"{demo}/flac") == f"{demo}/flac"
    with pytest.raises(FileNotFoundError):
        corpora.find_audio_dir(spark, demo, ".mp3")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        m = corpora.logical_access_2019(spark, project, ("train", "dev"))
        assert m.count() == 16 and {r.source_corpus for r in m.select("source_corpus").distinct().collect()} == {"asvspoof2019_la"}
    texts = " ".join(str(w.message) for w in said)
    assert "skipped 2 of 19" in texts and "1 files of the protocol" in texts and "'dev' is incomplete" in texts
    kept = corpora.from_protocol_file(spark, f"{la}/{corpora.PROTOCOLS_2019}/{corpora.PROTOCOL_2019['train']}", "/nowhere", "c", "s", require_audio=False)
    assert kept.count() == 17 and kept.where("path = '/nowhere/LA_T_9999999.flac'").count() == 1
    df = project.path("asvspoof2021_df")
    os.makedirs(f"{df}/keys")
    shutil.copytree(f"{demo}/flac", f"{df}/audio")
    with pytest.warns(UserWarning, match="no trial_metadata.txt"):
        assert corpora.deepfake_2021(spark, project).count() == 0
    with open(f"{df}/keys/trial_metadata.txt", "w") as f:
        f.write("LA_0023 LA_T_0000003 nocodec c A07 spoof notrim eval\nLA_T_0000004 nocodec c - bonafide notrim eval\n")
    with pytest.warns(UserWarning, match="without a speaker"):
        got = {r.utt_id: r for r in corpora.deepfake_2021(spark, project).collect()}
    assert set(got) == {"LA_T_0000003", "LA_T_0000004"} and got["LA_T_0000003"].split == "eval2021df" and got["LA_T_0000004"].speaker == "unknown"
    wf = project.path("wavefake")
    for name in ("LJSpeech-1.1/wavs", "ljspeech_hifiGAN", "odd"):
        os.makedirs(f"{wf}/{name}")
        with open(f"{wf}/{name}/a.b.wav", "wb") as f:
            f.write(audio.encode_wav(np.zeros(10), 16000))
    with pytest.warns(UserWarning, match="'odd'"):
        got = {r.utt_id: (r.label, r.attack, r.speaker, r.path) for r in corpora.wavefake(spark, project).collect()}
    assert got == {"LJSpeech-1.1/a.b": ("bonafide", "bonafide", "ljspeech", "data/WF/LJSpeech-1.1/wavs/a.b.wav"), "ljspeech_hifiGAN/a.b": ("spoof", "hifigan", "ljspeech", "data/WF/ljspeech_hifiGAN/a.b.wav"), "odd/a.b": ("spoof", "odd", "odd", "data/WF/odd/a.b.wav")}


def test_protocol_ignores_comments_behind_white_space(spark):
    lines = spark.createDataFrame([(x,) for x in ("\t# LA_T_1 spoof", " ", "LA_T_1 -\tSpoof", "x", None)], "value string")
    assert tuple(protocol.line_counts(lines).first()) == (1, 1, 3, 1)
    assert [(r.utt_id, r.label) for r in protocol.parsed(lines).collect()] == [("LA_T_1", "spoof")]


def test_manifest_sinks_are_gated(spark, project, tmp_path):
    m = sampling.speaker_disjoint_split(corpora.demo(spark, project), 0.25)
    out = str(tmp_path / "m")
    manifest.write(m, out)
    assert manifest.load(spark, f"{out}/all", "parquet").count() == spark.read.parquet(f"{out}/by_split").count() == 16
    assert "16 utterances" in "\n".join(r[0] for r in spark.read.text(f"{out}/summary").collect())
    bad = m.withColumn("split", F.when(F.col("utt_id") == "LA_T_0000001", "eval").otherwise(F.col("split")))
    with pytest.raises(leakage.LeakageError):
        manifest.write(bad, str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad")
    assert {c for c in manifest.attack_by_split(bad).columns} == {"attack", "train", "val", "eval"}


def test_features_experiments_and_models(spark, project, tmp_path):
    m = sampling.speaker_disjoint_split(corpora.demo(spark, project), 0.25)
    files = files_of(spark, m, project.project_root)
    table = features.extract(m, files, 8000).cache()
    assert tuple(features.progress(table).first()) == (16, 16)
    cropped = [features.extract(m.repartition(n), files, 4000, crop_seed=5).select("utt_id", "mfcc_01_mean").orderBy("utt_id").collect() for n in (1, 3)]
    assert cropped[0] == cropped[1] != features.extract(m, files, 4000).select("utt_id", "mfcc_01_mean").orderBy("utt_id").collect()
    good = features.good(table)
    experiments.write_table(good, str(tmp_path / "f"))
    back = experiments.read_features(spark, str(tmp_path / "f"))
    assert back.columns == [*FEATURE_META, *FEATURES] and back.count() == 16
    assert experiments.feature_columns(good) == list(FEATURES)
    with pytest.raises(ValueError, match="92 feature columns"):
        experiments.feature_columns(good.drop("mfcc_01_mean"))
    train, val, test = good.where("split = 'train' AND speaker <> 'LA_0000'"), good.where("split = 'val'"), good.where("speaker = 'LA_0000'")
    row, table_of, fitted = experiments.final_evaluation(train, val, test, family="MFCC")
    r = row.first()
    assert row.columns == list(experiments.RESULT_COLUMNS) and (r.training_samples, r.evaluation_samples) == (train.count() + val.count(), test.count()) and fitted.converged
    p = table_of.collect()
    assert table_of.columns == ["utt_id", "true_label", "true_label_id", "predicted_label_id", "predicted_label", "svm_score"] and all((x.predicted_label == "spoof") == (x.predicted_label_id == 1) == (x.svm_score > 0) for x in p)
    experiments.save_model(fitted, str(tmp_path / "svm"), spark)
    again, columns = experiments.load_model(spark, str(tmp_path / "svm"))
    assert again.weights == fitted.weights and columns == [f"mfcc_{i:02d}_{s}" for s in ("mean", "std") for i in range(1, 21)]
    one = experiments.predict_file(spark, os.path.join(project.path("synthetic"), "flac", "LA_T_0000001.flac"), again, columns, 8000)
    same = next(x for x in p if x.utt_id == "LA_T_0000001")
    assert abs(one["score"] - same.svm_score) < 1e-6 and one["label"] == same.predicted_label and (one["leans_to"] == "spoof") == (one["score"] >= 0)
    results = experiments.evaluate_all(train, test, str(tmp_path / "r"), ("MFCC", "LFCC"), trees=3, depth=3)
    assert [(x.model, x.features) for x in results.collect()] == [("SVM", "MFCC"), ("Random Forest", "MFCC"), ("SVM", "LFCC"), ("Random Forest", "LFCC")]
    assert experiments.evaluate_all(train, test, str(tmp_path / "r"), ("MFCC", "LFCC"), trees=3, depth=3).count() == 4
    forest = experiments.fit(train, columns, experiments.FOREST, trees=3, depth=3)
    experiments.save_model(forest, str(tmp_path / "rf"), spark, columns)
    loaded, named = experiments.load_model(spark, str(tmp_path / "rf"))
    assert named == columns and [x.score for x in experiments.score(loaded, test).orderBy("utt_id").collect()] == [x.score for x in experiments.score(forest, test).orderBy("utt_id").collect()]
    crossed = experiments.cross_corpus(train, val, test, str(tmp_path / "x"), trees=3, depth=3)
    assert crossed.count() == 8
    q = qc.run(m, files)
    qc.write(q, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q" / "per_file")).count() == 16 and qc.class_colour("spoof") != qc.class_colour("x")


def test_signs_of_comparisons(spark):
    a = spark.createDataFrame([("m", "f", 0.9, 0.8, 0.7, 0.6, 0.9, 0.1)], "model string, features string, accuracy double, precision double, recall double, f1 double, roc_auc double, eer double")
    b = a.withColumns({"roc_auc": F.lit(0.7), "eer": F.lit(0.3)})
    r = experiments.validation_against_evaluation(a, b).first()
    assert abs(r.roc_auc_drop - 0.2) < 1e-12 and abs(r.eer_increase - 0.2) < 1e-12 and r.val_f1 == 0.6
    r = experiments.corpus_against_corpus(a, b).first()
    assert abs(r.auc_change + 0.2) < 1e-12 and abs(r.eer_change - 0.2) < 1e-12 and r.la_eer == 0.1


def test_first_in_hash_order(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("utt_id"))
    want = [r.utt_id for r in df.orderBy(sampling.hash_order("utt_id", 3), "utt_id").collect()]
    for n in (0, 1, 7, 1500, 2999, 3000, 5000):
        assert sorted(r.utt_id for r in sampling.first_in_order(df, n, 3, "utt_id").collect()) == sorted(want[:n])


def test_thinned_curve_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.4), float(s)) for s in rng.integers(0, 400, 4000)]
    got = [(r.threshold, r.tps, r.fps) for r in metrics.roc_points(spark.createDataFrame(rows, "y int, score double")).orderBy(F.desc("threshold")).collect()]
    scores = sorted({s for _, s in rows}, reverse=True)
    step = [(sum(y for y, s in rows if s == v), sum(1 - y for y, s in rows if s == v)) for v in scores]
    want, tps, fps = [(float("inf"), 0, 0)], 0, 0
    for i, v in enumerate(scores):
        tps, fps = tps + step[i][0], fps + step[i][1]
        if i in (0, len(scores) - 1) or step[i + 1] != step[i]:
            want.append((v, tps, fps))
    assert got == want


def test_linear_machine_reaches_its_minimum(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.6).astype(int)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "label_id int, a double, b double, c double")
    m = models.linear_svm(df, ["a", "b", "c"])
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((300, 1))])
    s, u = 2 * y - 1, np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))

    def loss(w):
        return w @ w / 2 + (u * np.maximum(0, 1 - s * (z @ w)) ** 2).sum()

    w = np.array([*m.weights, m.intercept])
    assert m.converged and all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(size=(200, 4)) * 0.01)


def test_new_files_are_measured_as_a_stream(spark, tmp_path):
    from vocalis.streaming import audio as stream

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.wav").write_bytes(audio.encode_wav(np.full(1600, 0.1 * i), 16000))
    (tmp_path / "in" / "bad.wav").write_bytes(b"junk")
    measured = stream.measured(stream.watch(spark, str(tmp_path / "in"), "*.wav"))
    query = measured.writeStream.format("memory").queryName("measured").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.sql("SELECT * FROM measured").collect()
    assert len(got) == 4 and sum(r.ok for r in got) == 3 and {round(r.peak, 2) for r in got if r.ok} == {0.0, 0.1, 0.2}
