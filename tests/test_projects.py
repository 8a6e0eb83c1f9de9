"""Sinks and flows of whole projects, and texts that once broke a reader."""

import json

import pytest
from pyspark.sql import functions as F

from vanika.functions import text, tokens
from vanika.operators import evaluate, manifest, quality
from vanika.plans import flows, project
from vanika.sources import files, media, reports, settings, srt


def test_long_index_line_fails_no_file(spark):
    bad = "99999999999\n00:00:01,000 --> 00:00:02,000\na\n\n" + "9" * 60 + "\n00:00:01,000 --> 00:00:02,000\nb"
    rows = srt.parse(spark.createDataFrame([("x", bad), ("y", "1\n00:00:01,000 --> 00:00:02,000\nc")], "path string, value string")).collect()
    assert {(r["path"], r["text"]) for r in rows} == {("x", "a"), ("x", "b"), ("y", "c")} and {r["index"] for r in rows if r["text"] == "a"} == {99999999999}


@pytest.mark.parametrize("given,want", [("a<sp> b", ["a", "<sp>", "b"]), ("a <sp>\t<sp>b", ["a", "<sp>", "b"]), ("<sp>", ["<sp>"]), ("a <p_long> b", ["a", "<sp>", "<p_long>", "<sp>", "b"])])
def test_blanks_written_out_are_one_token(spark, given, want):
    assert spark.range(1).select(tokens.split_tokens(F.lit(given))).first()[0] == want


def test_dictionary_words_in_text(spark):
    known = F.create_map(F.lit("the"), F.lit("द"))
    assert spark.range(1).select(text.transliterate(F.lit("The sheXz, the-b"), known)).first()[0] == "द शएक्सज़, द-ब"


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([("a", "x", 0.03125, None, None, 2.0, 0.5), ("b", "y", None, None, None, 4.0, None)], "item_id string, category string, cer double, wer double, utmos double, duration_sec double, rtf double")
    reports.write_report(items, str(tmp_path))
    lines = sorted({r["value"] for r in spark.read.text(f"{tmp_path}/report_csv").collect()})
    assert lines == ["a,x,0.0312,,,2.000,0.500", "b,y,,,,4.000,", "item_id,category,cer,wer,utmos,duration_sec,rtf"]
    got = json.loads(spark.read.text(f"{tmp_path}/report_json").first()["value"])
    assert got == {"per_category": {"x": {"n": 1, "cer_mean": 0.03125, "duration_sec_mean": 2.0, "rtf_mean": 0.5}, "y": {"n": 1, "duration_sec_mean": 4.0}}, "n_items": 2, "overall": {"cer_mean": 0.03125, "duration_sec_mean": 3.0, "rtf_mean": 0.5}}


def test_settings_engine_dictionary_and_sounds(spark, tmp_path):
    paths = settings.create(str(tmp_path), "p")
    assert settings.create(str(tmp_path), "p") == paths and settings.read(paths.config)["name"] == "p"
    settings.write({"name": "p", "qc": {"min_snr_db": 10.0}, "own": {"a": [1, 2], "b": "x: y # z"}}, paths.config)
    got = settings.read(paths.config)
    assert got["name"] == "p" and got["qc"] == {"min_snr_db": 10.0, "max_cer_vs_whisper": 0.05, "max_silence_ratio": 0.25} and got["clip_min_seconds"] == 1.5 and got["own"] == {"a": [1, 2], "b": "x: y # z"}
    with pytest.raises(FileNotFoundError):
        settings.read(str(tmp_path / "none.yaml"))
    reports.write_engine(spark, {"project_name": "p"}, str(tmp_path / "e"))
    assert reports.read_engine(spark, str(tmp_path / "e"))["project_name"] == "p"
    reports.write_engine(spark, {"model_type": "other"}, str(tmp_path / "e"))
    with pytest.raises(ValueError, match="model_type"):
        reports.read_engine(spark, str(tmp_path / "e"))
    reports.write_dictionary(spark, {"B": "2", "a": "1"}, str(tmp_path / "d"))
    assert files.read_dictionary(spark, str(tmp_path / "d")) == {"a": "1", "b": "2"}
    media.write_sounds(spark.createDataFrame([("s.wav", 8000, [0.0, 0.5, -0.5, 2.0]), ("n.wav", 8000, None)], "path string, rate int, samples array<float>"), str(tmp_path / "wav"))
    (back,) = files.read_wav(spark, str(tmp_path / "wav")).collect()
    assert back["rate"] == 8000 and back["samples"] == pytest.approx([0.0, 0.5, -0.5, 1.0], abs=1e-3)


def test_24_bit_sounds(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 3, 16000, 0, "NONE", ""))
        w.writeframes(b"\x00\x00\x40" + b"\x00\x00\xc0" + b"\x01\x00\x00")
    assert files.read_wav(spark, str(tmp_path / "a.wav")).first()["samples"] == pytest.approx([0.5, -0.5, 0.0], abs=1e-6)


def test_ready_and_loader_refuse_nothing(spark):
    none = spark.createDataFrame([], "processed_text string, duration double")
    with pytest.raises(Exception, match="no records"):
        flows.prepare(none, none).collect()
    with pytest.raises(Exception, match="no row"):
        quality.loadable(none).collect()


def test_a_project_from_sources_to_training_rows(spark):
    sources = spark.createDataFrame([("s", True), ("t", None)], "id string, aligned boolean")
    cues = spark.createDataFrame([(x, k, k * 3.0, k * 3.0 + 2.0, f"आज {k}") for x in "st" for k in range(4)], "source_id string, index long, start_sec double, end_sec double, text string")
    words = spark.createDataFrame([("s", k, k * 3.0 + 0.1, k * 3.0 + 1.9) for k in range(4)], "source_id string, ord long, start double, end double")
    wave = [((k * 7919) % 200 - 100) / 100 if 1 < k // 4096 % 3 else 0.001 for k in range(12 * 4096)]
    sounds = spark.createDataFrame([(x, 4096, wave) for x in "st"], "source_id string, rate int, samples array<float>")
    rows = flows.training_set(sources, cues, words, sounds, skip_qc=True).collect()
    assert {r["source_id"] for r in rows} <= {"s"} and all(r["audio_path"].startswith("s/s_c00000") for r in rows)
    clips = flows.segment(cues, sounds, least=0.5)
    assert manifest.outcomes(clips, ["created", "skipped", "rejected"]).first()["total"] == 8


def test_ranks_of_strings_use_several_ranges(spark):
    rows = spark.range(3000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    got = dict(manifest.rank(rows, "k").collect())
    assert [got[k] for k in sorted(got)] == list(range(3000))


def test_fixed_decimals_are_exact(spark):
    values = [0.00625, 38.3125, 1 / 160, 0.5, 0.0005, 0.0015, 2.5, -0.00625, 1234.56785, *(k / 7e3 for k in range(200)), *(k / 16000 for k in range(300))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", files.fixed("v", 4).alias("a"), files.fixed("v", 3).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(f"{r['v']:.4f}", f"{r['v']:.3f}") for r in rows]


@pytest.mark.parametrize(
    "given,want",
    [
        ("name: p\nlanguage: hi # Hindi\n\nqc:\n  min_snr_db: 10.5\n  deep:\n      a: ~\n      b: 1_000\n  on: true\ntail: 'it''s'\n", {"name": "p", "language": "hi", "qc": {"min_snr_db": 10.5, "deep": {"a": None, "b": 1000}, "on": True}, "tail": "it's"}),
        ("---\na:\nb:\n- 1\n- x y\nc:\n  - 2e-4\n  - \"q\"\n", {"a": None, "b": [1, "x y"], "c": [2e-4, "q"]}),
        ('{"a": {"b": 1}}', {"a": {"b": 1}}),
        ("", {}),
    ],
)
def test_settings_need_no_other_package(given, want):
    assert settings.loads(given) == want and settings.loads(settings.dumps(want)) == want


def test_settings_that_are_none():
    with pytest.raises(ValueError, match="line 2"):
        settings.loads("a: 1\n? b\n")


def test_formatters_are_asked_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", "raw", "said", 1.0, "s", "train"), ("b.wav", "raw | x", "", 1.0, "s", "train"), ("", "raw", "x", 1.0, "s", "train"), ("c.wav", "r", "v", 1.0, "s", "val")], files.SPLIT + ", split string")
    files.write_splits(rows, f"{tmp_path}/training_set")
    assert sorted(tuple(x)[1] for x in flows.samples(spark, str(tmp_path), "train").collect()) == ["raw | x", "said"]
    flows.register_formatter("hindi_csv", flows.FORMATTERS["hindi_csv"])
    with pytest.raises(ValueError, match="another"):
        flows.register_formatter("hindi_csv", lambda *a: rows)
    flows.register_formatter("all", lambda spark, root, split: rows)
    assert flows.samples(spark, "x", "train", "all").count() == 4
    with pytest.raises(ValueError, match="no formatter"):
        flows.samples(spark, "x", "train", "none")


def test_by_category(spark):
    items = spark.createDataFrame([("a", "narration"), ("b", "long")], "id string, category string")
    assert [x["id"] for x in evaluate.by_category(items, "long").collect()] == ["b"]
    with pytest.raises(ValueError, match="category"):
        evaluate.by_category(items, "other")


@pytest.fixture
def inputs(spark):
    """Three sources: two with sound, one of which has a transcript that can't be read."""
    wave = [((k * 7919) % 200 - 100) / 100 if 1 < k // 64 % 3 else 0.001 for k in range(12 * 64)]
    sounds = spark.createDataFrame([(f"src_{k:05d}", 64, wave if k < 2 else []) for k in range(3)], "source_id string, rate int, samples array<float>")
    cues = "\n\n".join(f"{k + 1}\n00:00:0{2 * k},000 --> 00:00:0{2 * k + 2},000\nआज {k}" for k in range(4))
    scripts = spark.createDataFrame([("0.srt", cues), ("1.srt", "1\n00:00:01,000 --> 00:00:02,000 --> x\nt")], "path string, value string")
    urls = spark.createDataFrame([(k, f"u{k}") for k in range(3)], "ord long, url string")
    return urls, spark.createDataFrame([(k, f"{k}.srt") for k in range(3)], "ord long, path string"), sounds, scripts


def test_a_second_run_does_what_is_missing(spark, tmp_path, inputs):
    urls, listing, sounds, scripts = inputs
    own = project.Project(spark, str(tmp_path / "p"), {"clip_min_seconds": 1.0, "qc": {"min_snr_db": 0.0, "max_silence_ratio": 1.0}}, frame=8, threshold_db=-200.0)
    with pytest.raises(ValueError, match="register"):
        own.run(sounds, scripts)
    with pytest.raises(Exception, match="counts differ"):
        own.register(urls, listing.limit(1))
    assert own.register(urls, listing) == 3 and own.register(urls, listing) == 0
    first = own.run(sounds, scripts)
    assert first["download"] == {"downloaded": 2, "skipped": 0, "failed": 1, "total": 3} and first["align"] == {"aligned": 1, "skipped": 0, "fallback_used": 1, "failed": 1}
    assert first["segment"]["clips_created"] == 4 and first["qc"]["passed"] == 4 and first["dataset"]["total"] == 4
    rows = {x["id"]: x for x in own.sources().collect()}
    assert rows["src_00001"]["error"] == "alignment failed: two arrows" and rows["src_00002"]["error"] == "no sound" and rows["src_00000"]["qc_passed"] and not rows["src_00001"]["aligned"]
    good = scripts.withColumn("value", F.replace("value", F.lit(" --> x"), F.lit("")))
    second = own.run(sounds, good)
    assert second["align"] == {"aligned": 1, "skipped": 1, "fallback_used": 1, "failed": 0}
    assert second["segment"] == {"clips_created": 1, "clips_skipped_existing": 4, "clips_rejected": 0, "sources_processed": 2} and second["dataset"]["total"] == 5
    stricter = project.Project(spark, str(tmp_path / "p"), {"clip_min_seconds": 1.0, "clip_max_seconds": 1.5, "qc": {"min_snr_db": 0.0, "max_silence_ratio": 1.0}}, frame=8, threshold_db=-200.0)
    third = stricter.run(sounds, good)
    assert third["qc"]["failed_duration"] == 4 and third["qc"]["passed"] == 1 and third["dataset"]["total"] == 1
    assert own.run(sounds, good)["dataset"]["total"] == 5


def test_a_broken_run_goes_on(spark, tmp_path, inputs, monkeypatch):
    urls, listing, sounds, scripts = inputs
    own = project.Project(spark, str(tmp_path / "p"), {"clip_min_seconds": 1.0, "qc": {"min_snr_db": 0.0, "max_silence_ratio": 1.0}}, frame=8, threshold_db=-200.0)
    own.register(urls, listing)
    own.download(sounds)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(project.Project, "_update", broken)
        with pytest.raises(RuntimeError):
            own.align(scripts, None)
    (tmp_path / "p" / "clips" / "part_of=1").mkdir(parents=True)  # begun, never committed
    (tmp_path / "p" / "clips" / "part_of=1" / "junk.parquet").write_bytes(b"x")
    found = own.run(sounds, scripts)
    assert found["align"] == {"aligned": 0, "skipped": 1, "fallback_used": 0, "failed": 1} and found["segment"]["clips_created"] == 4
    assert own.sources().filter("aligned").count() == 1 and own.training().count() == 4


def test_steps_from_the_shell(spark, tmp_path, inputs, capsys):
    from vanika.__main__ import main

    _, _, sounds, scripts = inputs

    def step(*given):
        code = main([str(x) for x in given])
        said = capsys.readouterr()
        return (code, json.loads(said.out) if said.out else said.err)

    assert step("status", tmp_path / "none")[0] == 1
    code, found = step("new", tmp_path, "voice")
    root = found["root"]
    settings.write(settings.read(f"{root}/config.yaml") | {"clip_min_seconds": 1.0, "qc": {"min_snr_db": -100.0, "max_silence_ratio": 1.0}}, f"{root}/config.yaml")
    (tmp_path / "urls.txt").write_text("# list\nu0\n\n u1 \nu2\n")
    (tmp_path / "srt").mkdir()
    for x in scripts.collect():
        (tmp_path / "srt" / x["path"]).write_text(x["value"])
    with pytest.raises(Exception, match="counts differ"):
        step("add-sources", root, tmp_path / "urls.txt", tmp_path / "srt")
    (tmp_path / "srt" / "2.srt").write_text("")
    media.write_sounds(sounds.withColumn("path", F.concat("source_id", F.lit(".wav"))), str(tmp_path / "wav"))
    assert step("add-sources", root, tmp_path / "urls.txt", tmp_path / "srt") == (0, {"added": 3})
    code, found = step("prepare", root, tmp_path / "wav", tmp_path / "srt", "--skip-qc")
    assert code == 0 and found["align"]["aligned"] == 1 and found["dataset"]["total"] == 4
    assert step("status", root)[1] == {"sources": 3, "downloaded": 2, "aligned": 1, "segmented": 1, "qc_passed": 1, "errors": {"alignment failed: two arrows": 1, "no sound": 1}}
    assert step("prepare", root, tmp_path / "wav", tmp_path / "srt", "--skip-qc")[1]["segment"]["clips_skipped_existing"] == 4
    assert flows.samples(spark, root, "train").count() == step("ready", root)[1]["train_records"]


def test_a_run_parses_transcripts_once(spark, tmp_path):
    from vanika.plans import project

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    cue = "1\n00:00:00,000 --> 00:00:02,000\nhello\n"
    files = spark.createDataFrame([("a.srt", cue), ("b.srt", "1\n00:00:00,000 --> 00:00:01,000 --> 2\nx\n")], "path string, value string")
    own = project.Project(spark, str(tmp_path / "once"), frame=8)
    urls = spark.createDataFrame([(0, "u/0"), (1, "u/1"), (2, "u/2")], "ord long, url string")
    own.register(urls, spark.createDataFrame([(0, "a.srt"), (1, "b.srt"), (2, "c.srt")], "ord long, path string"))
    own.download(spark.createDataFrame([(f"src_0000{k}", 8, [0.5] * 32) for k in range(3)], "source_id string, rate int, samples array<float>"))
    words = spark.createDataFrame([("src_00000", 0, 0.25, 1.75)], "source_id string, ord long, start double, end double")
    assert own.align(files.mapInPandas(counted, files.schema), words) == {"aligned": 1, "skipped": 0, "fallback_used": 0, "failed": 2}
    # Once for the cues and their errors, once for the paths.
    assert seen.value <= 4
    assert [(x["start_sec"], x["end_sec"], x["text"]) for x in own.cues().collect()] == [(0.25, 1.75, "hello")]
    assert {x["id"]: x["error"] for x in own.sources().collect()} == {"src_00000": None, "src_00001": "alignment failed: two arrows", "src_00002": "transcript missing"}
