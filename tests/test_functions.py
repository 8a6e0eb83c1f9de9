"""Functions with values worked out by hand, and round trips through files."""

import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from vanika.functions import audio, similarity, text, tokens
from vanika.operators import evaluate, manifest, quality, timeline
from vanika.sources import files, srt
from vanika.streaming import subtitles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_null_and_idempotent(spark):
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""
    once = one(spark, text.normalize(F.lit("  क​  ख ")))
    assert once == "क ख" == one(spark, text.normalize(F.lit(once)))


def test_frontend_leaves_no_digits(spark):
    for t in ("वर्ष 1947, 15 अगस्त को 3 बजे।", "₹2,500 और 50%", "10:30 पर 3.14"):
        assert not any(c.isdigit() for c in one(spark, text.frontend(F.lit(t))))


def test_long_numbers(spark):
    assert one(spark, text.spell_digits(F.lit("1" + "0" * 9))) == "एक अरब"
    nines = one(spark, text.spell_digits(F.lit("9" * 9)))
    assert one(spark, text.spell_digits(F.lit("9" * 40))) == " ".join([one(spark, text.spell_digits(F.lit("9999"))), *[f"अरब {nines}"] * 4])


@pytest.mark.parametrize("a,b,want", [("abc", "abd", 1 / 3), ("", "", 0.0), ("", "x", 1.0), ("हेलो दुनिया", "हेलोदुनिया", 0.0), ("extra", "", 1.0), ("ab", "abcdef", 2.0)])
def test_cer(spark, a, b, want):
    assert one(spark, similarity.cer(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("a,b,want", [("a b c", "a b c", 0.0), ("a b c", "a x c", 1 / 3), ("a", "", 1.0), ("", "a", 1.0), ("", "", 0.0), ("abc def", "def abc", 1.0)])
def test_wer(spark, a, b, want):
    assert one(spark, similarity.wer(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_tokenizer(spark):
    seed = tokens.seed_vocabulary()
    assert seed[:5] == tokens.RESERVED and len(seed) == len(set(seed))
    t = F.lit("क   ख <p_short> ग")
    assert one(spark, tokens.split_tokens(t)) == ["क", "<sp>", "ख", "<sp>", "<p_short>", "<sp>", "ग"]
    ids = tokens.encode(t, tokens.literal_map(seed), bos=True, eos=True)
    assert one(spark, tokens.decode(ids, tokens.literal_array(seed))) == "क ख <p_short> ग"
    a = tokens.fit(spark.createDataFrame([("ab",), ("ca",)], "text string")).orderBy("id").collect()
    b = tokens.fit(spark.createDataFrame([("ca",), ("ab",)], "text string")).orderBy("id").collect()
    assert a == b and [r["token"] for r in a[-3:]] == ["a", "b", "c"]


def test_audio(spark):
    loud, silent = [0.5, -0.5] * 8, [0.0] * 16
    wav = F.array(*(F.lit(float(x)) for x in silent + loud + silent))
    assert one(spark, audio.silence_ratio(wav, frame=16)) == pytest.approx(2 / 3)
    assert one(spark, audio.snr_db(wav, frame=16)) == pytest.approx(113.979, abs=1e-2)
    assert one(spark, audio.snr_db(wav, frame=32)) == 0.0
    assert len(one(spark, audio.trim_silence(wav, rate=1600, pad_ms=0))) == 16
    quiet = F.array(*(F.lit(0.0) for _ in range(40)))
    assert len(one(spark, audio.trim_silence(quiet, rate=1600))) == 40
    assert one(spark, audio.stretch(F.array(*(F.lit(float(i)) for i in range(8))), F.lit(2.0))) == [0.0, 2.0, 4.0, 7.0]


def test_waterfall_order_and_bounds(spark):
    rows = [("a", 1.5, 20.0, 0.4, "x", "x"), ("b", 1.4, 0.0, 0.9, "x", "y"), ("c", 2.0, 19.9, 0.9, "x", "y"), ("d", 2.0, 30.0, 0.41, "x", "x"), ("e", 2.0, 30.0, 0.1, "x", "y"), ("f", 2.0, 30.0, 0.1, "x", None)]
    clips = spark.createDataFrame(rows, "clip_id string, duration double, snr_db double, silence_ratio double, reference string, hypothesis string")
    got = {r["clip_id"]: (r["passed"], r["reason"].split()[0]) for r in quality.waterfall(clips, min_snr=20.0, max_silence=0.4, max_cer=0.25).collect()}
    assert got == {"a": (True, "ok"), "b": (False, "duration"), "c": (False, "snr"), "d": (False, "silence"), "e": (False, "cer"), "f": (True, "ok")}


def test_split_shares(spark):
    rows = spark.range(10000).select(quality.split_of(F.concat(F.lit("clip_"), "id")).alias("split")).groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in rows}
    assert 9300 <= n["train"] <= 9700 and 200 <= n["val"] <= 600 and n["test"] <= 300
    assert one(spark, quality.split_of(F.lit("clip_1"), 0, 0)) == "train"


def test_timeline_padding_is_never_negative(spark):
    cues = spark.createDataFrame([("f", 0, 0.0, 1.0, 1000), ("f", 1, 1.0, 2.0, 5000), ("f", 2, 2.0, 3.0, 10)], "file string, ord long, start_sec double, end_sec double, gen_samples long")
    got = timeline.fit_to_cue(cues, rate=1000).orderBy("ord").collect()
    assert [(r["start_sample"], r["samples"], r["mode"]) for r in got] == [(0, 1000, "padded"), (1000, 5000, "whole"), (6000, 100, "padded")]


def test_checks_raise(spark):
    with pytest.raises(Exception, match="category"):
        spark.range(1).select(evaluate.check_category(F.lit("song"))).collect()
    with pytest.raises(Exception, match="counts differ"):
        manifest.assert_equal_counts(spark.range(2), spark.range(3)).collect()


def test_peeled_ids_and_report(spark):
    items = evaluate.test_items(spark.createDataFrame([("narration", ["  ", "real", ""])], "category string, texts array<string>")).collect()
    assert [(r["text"], r["id"][:14]) for r in items] == [("real", "narration_0001")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"id": "a", "url": "u", "extra": 1, "status": {"aligned": True}}, {"id": "b"}]}))
    rows = files.read_manifest(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [(r["id"], r["status"]["aligned"], r["status"]["qc_passed"]) for r in rows] == [("a", True, None), ("b", False, None)]
    data = spark.createDataFrame([("a.wav", 'say "hi" | now', "x", 1.23456, "s", "train"), ("b.wav", "line\nbreak", "y", 2.0, "s", "val")], "audio_path string, raw_text string, processed_text string, duration double, source_id string, split string")
    files.write_splits(data, str(tmp_path / "splits"))
    back = files.read_split(spark, str(tmp_path / "splits" / "split=train")).collect()
    assert [(r["raw_text"], r["duration"]) for r in back] == [('say "hi" | now', 1.235)]
    qc = spark.createDataFrame([("c", "s", 1.0, 2.0, 0.5, None, True, "ok"), ("d", "s", 1.0, 2.0, 0.5, 0.5, False, 'cer "x", y')], "clip_id string, source_id string, duration double, snr_db double, silence_ratio double, whisper_cer double, passed boolean, reason string")
    files.write_qc_report(qc, str(tmp_path / "qc"))
    assert [(r["clip_id"], r["whisper_cer"]) for r in files.read_qc_report(spark, str(tmp_path / "qc")).collect()] == [("c", None)]
    (tmp_path / "urls.txt").write_text(" a \n\n# no\nb\r\n")
    assert [r["url"] for r in files.read_urls(spark, str(tmp_path / "urls.txt")).orderBy("ord").collect()] == ["a", "b"]


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(struct.pack("<4h", 16384, 0, -16384, -16384))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    got = {r["path"][-5:]: r["samples"] for r in files.read_wav(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": [0.25, -0.5], "b.wav": None}
    seconds = spark.read.format("binaryFile").load(str(tmp_path)).select("path", audio.wav_seconds(F.col("content")).alias("s")).collect()
    assert {r["path"][-5:]: r["s"] for r in seconds} == {"a.wav": pytest.approx(0.02), "b.wav": 0.0}


def test_subtitle_stream_reads_each_file_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nA\n")
        subtitles.ingest(spark, folder, out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1


def test_stamps_carry(spark):
    assert one(spark, srt.stamp(F.lit(3599.9996))) == "01:00:00,000"


def test_numbers_within_texts_are_not_interpreted(spark):
    import random

    own = random.Random(5)
    runs = ["".join(own.choice("0०123९") for _ in range(own.randrange(1, 40))) for _ in range(300)] + ["0", "000", "०", "1000000000", "9" * 18]
    rows = spark.createDataFrame([(r,) for r in runs], "r string")
    said = rows.select(text.spell_digits(F.col("r")), text.expand_integers(F.col("r")), text.expand_numbers(F.concat(F.lit("("), "r", F.lit(")"))))
    assert all(b == a and c == f"({a})" for a, b, c in said.collect())
    spaced = [("5　%", f"पाँच {text.PERCENT}"), ("5\x1c%", "पाँच\x1c%"), ("Rs.\x855", f"पाँच {text.RUPEES}"), ("24:00", "चौबीस:शून्य"), (None, None), ("", "")]
    got = spark.createDataFrame(spaced, "t string, want string").select(text.expand_numbers(F.col("t")), "want").collect()
    assert all(a == b for a, b in got)
    for change in (text.expand_numbers, text.expand_integers):
        assert "lambdafunction" not in rows.select(change(F.col("r")))._jdf.queryExecution().optimizedPlan().toString()


def test_fitting_takes_the_tokens_of_each_text_once(spark):
    import random

    own = random.Random(6)
    pieces = ["<", ">", "<sp>", "<a_b>", "<<b>c>", "sp", "_", "A", "<A>", " ", "\n", "\x1c", "\x85", "　", "​", "क", "\U0001f600", "<p_short>", "<>"]
    for k in range(4):
        texts = ["".join(own.choice(pieces) for _ in range(own.randrange(6))) for _ in range(50)] + [None, ""]
        rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        want = {t for x in rows.select(tokens.split_tokens(F.col("text"))).collect() for t in x[0] or ()}
        made = tokens.fit(rows, vocabulary=["<pad>"])
        assert [x["token"] for x in made.orderBy("id").collect()] == ["<pad>", *sorted(want)]
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
