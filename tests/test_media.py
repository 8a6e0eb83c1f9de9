"""Sound, subtitle and log sources; folds, spectrograms, dictionaries and numbers of any size."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vanika.functions import mel, text
from vanika.operators import lookup, timeline
from vanika.sources import media, srt


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_sounds_round_trip_and_odd_rows(spark, tmp_path):
    rows = [("s.wav", 8000, [0.0, 0.5, -0.5, 2.0]), ("n.wav", 8000, None), ("r.wav", None, [0.1]), (None, 8000, [0.1]), ("e.wav", 8000, [])]
    sounds = spark.createDataFrame(rows, "path string, rate int, samples array<float>")
    media.write_sounds(sounds, str(tmp_path / "a"))
    assert names(tmp_path / "a") == ["e.wav", "s.wav"]
    got = {x["path"].rsplit("/", 1)[1]: x for x in media.read_sounds(spark, str(tmp_path / "a")).collect()}
    assert got["s.wav"]["rate"] == 8000 and got["s.wav"]["samples"] == pytest.approx([0.0, 0.5, -0.5, 1.0], abs=1e-3) and got["e.wav"]["samples"] == []
    (tmp_path / "a" / "bad.wav").write_bytes(b"RIFFxxxx")
    assert {x["path"].rsplit("/", 1)[1]: x["samples"] for x in media.read_sounds(spark, f"file://{tmp_path}/a").collect()}["bad.wav"] is None
    media.write_sounds(sounds.filter("path = 's.wav'").withColumn("path", F.lit("t.wav")), str(tmp_path / "a"), overwrite=True)
    assert names(tmp_path / "a") == ["t.wav"]


def test_failed_and_doubled_files_leave_nothing(spark, tmp_path):
    ids = spark.range(0, 40, 1, 8)
    bad = ids.select(F.concat("id", F.when(F.col("id") == 37, "/x").otherwise(""), F.lit(".wav")).alias("path"), F.lit(8000).alias("rate"), F.array(F.lit(0.5)).alias("samples"))
    with pytest.raises(Exception, match="not a file's name"):
        media.write_sounds(bad, str(tmp_path / "a"))
    assert names(tmp_path) == []
    with pytest.raises(Exception, match="several files of one name"):
        media.write_sounds(bad.filter("path NOT LIKE '%/%'").withColumn("path", F.lit("one.wav")), str(tmp_path / "a"))
    assert names(tmp_path) == []
    good = bad.filter("path NOT LIKE '%/%'")
    for _ in range(2):
        media.write_sounds(good, str(tmp_path / "a"))
    assert len(names(tmp_path / "a")) == 39


def test_a_task_that_ran_twice_counts_once(tmp_path):
    writer = media._SoundsWriter({"path": str(tmp_path)}, False)
    batch = pa.record_batch({"path": ["a.wav"], "rate": pa.array([8000], pa.int32()), "samples": pa.array([[0.5]], pa.list_(pa.float32()))})
    writer.write(iter([batch]))  # an attempt whose message is lost
    kept = writer.write(iter([batch]))
    assert media._files(str(tmp_path), ".wav") == []
    writer.commit([kept, None])
    assert names(tmp_path) == ["a.wav"]


SUBTITLES = "﻿1\r\n00:00:01,000 --> 00:00:03,500\r\nfirst\r\n\r\n\r\n00:00:04,000 --> 00:00:06,250\r\n second line \r\nthird\r\n\r\n\n7\n00:00:07.100 --> 00:00:09,000\nlast"


def test_subtitles_are_read_as_they_are_parsed(spark, tmp_path, monkeypatch):
    (tmp_path / "a.srt").write_bytes(SUBTITLES.encode())
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000 --> 3\nx")
    (tmp_path / "c.srt").write_text("")
    (tmp_path / "_d.srt").write_text(SUBTITLES)
    plain = srt.parse(spark.createDataFrame([(f"{tmp_path}/{n}.srt", (tmp_path / f"{n}.srt").read_bytes().decode()) for n in "abc"], "path string, value string"))
    keep = ("path", "index", "start_sec", "end_sec", "text", "error")
    assert sorted(map(tuple, media.read_subtitles(spark, str(tmp_path)).select(*keep).collect()), key=repr) == sorted(map(tuple, plain.select(*keep).collect()), key=repr)


def test_subtitle_files_of_many_cues(spark, tmp_path):
    cues = spark.range(60_000).select(F.when(F.col("id") < 50_000, "long.srt").otherwise("short.srt").alias("path"), F.col("id").alias("ord"), (F.col("id") * 2.0005).alias("start_sec"), (F.col("id") * 2.0005 + 1.2345).alias("end_sec"), F.concat(F.lit("é "), "id").alias("text"))
    media.write_subtitles(cues.orderBy(F.rand(3)), str(tmp_path))
    assert names(tmp_path) == ["long.srt", "short.srt"]
    got = media.read_subtitles(spark, str(tmp_path)).select("index", "text", "start_sec", F.col("path").endswith("long.srt").alias("long"))
    assert got.filter("long").agg(F.count("*"), F.max("index"), F.count_if(F.col("text") == F.concat(F.lit("é "), F.col("index") - 1))).first()[:] == (50_000, 50_000, 50_000)
    texts = srt.format_files(cues.filter("path = 'short.srt'")).first()["value"]
    assert (tmp_path / "short.srt").read_text() == texts


def follow(spark, folder, state, tail=-1):
    query = media.follow(spark, str(folder), tail=tail, ending=".log").writeStream.format("parquet").option("path", f"{state}/out").option("checkpointLocation", f"{state}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(x["line"] for x in spark.read.schema("path string, at long, line string").parquet(f"{state}/out").collect())


def test_lines_come_once_also_after_a_restart(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("a1\na2\nhalf")
    (logs / "other.txt").write_text("no\n")
    assert follow(spark, logs, tmp_path / "s") == ["a1", "a2"]
    with (logs / "a.log").open("a") as f:
        f.write(" done\r\n\n")
    (logs / "b.log").write_text("b1\n")
    assert follow(spark, logs, tmp_path / "s") == ["", "a1", "a2", "b1", "half done"]
    assert follow(spark, logs, tmp_path / "s") == ["", "a1", "a2", "b1", "half done"]
    (logs / "b.log").write_text("")
    assert len(follow(spark, logs, tmp_path / "s")) == 5
    (logs / "b.log").write_text("b\n")
    assert follow(spark, logs, tmp_path / "s") == ["", "a1", "a2", "b", "b1", "half done"]


@pytest.mark.parametrize("tail,want", [(0, []), (1, ["é3", "z1"]), (2, ["2", "é3", "z1"]), (9, ["1", "2", "z1", "é3"])])
def test_tail_of_what_is_there(spark, tmp_path, tail, want):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("1\n2\né3\nnot yet")
    (logs / "z.log").write_text("z1\n")
    assert follow(spark, logs, tmp_path / "s", tail) == sorted(want)
    with (logs / "a.log").open("a") as f:
        f.write("\nnew\n")
    assert follow(spark, logs, tmp_path / "s", tail) == sorted([*want, "not yet", "new"])


@pytest.mark.parametrize("task,chunk", [(7, 3), (1, 1), (64, 5)])
def test_spans_of_a_file_share_its_lines(tmp_path, monkeypatch, task, chunk):
    monkeypatch.setattr(media, "TASK_BYTES", task)
    monkeypatch.setattr(media, "CHUNK", chunk)
    own = random.Random(task)
    lines = ["x" * own.randrange(12) for _ in range(60)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nrest")
    reader = media._LogReader({"path": str(tmp_path)})
    got = [(at, line) for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for at, line in zip(b["at"].to_pylist(), b["line"].to_pylist(), strict=True)]
    assert [line for _, line in sorted(got)] == lines
    for n in (0, 1, 5, 60, 99):
        end = media._LogReader({"path": str(tmp_path), "tail": str(n)}).initialOffset()["files"][f"{tmp_path}/a.log"]
        assert (tmp_path / "a.log").read_text()[end:] == "".join(x + "\n" for x in lines[60 - min(n, 60) :]) + "rest"


def plain_fit(cues, rate, most=1.3):
    cursor, out = 0.0, []
    for start, end, made in cues:
        at = max(start, cursor)
        slot = max(0.1, end - at)
        ratio = made / rate / slot
        n = made if ratio > most else int(made / min(2, max(0.5, ratio))) if ratio > 1.001 else made + max(0, int((slot - made / rate) * rate))
        out.append((int(at * rate), n))
        cursor = (int(at * rate) + n) / rate
    return out


def test_one_long_file_is_folded_in_order(spark):
    own = random.Random(7)
    n = 120_000
    cues = [(k * 1.5, k * 1.5 + own.uniform(0.2, 2.5), own.randrange(100, 1500)) for k in range(n)]
    df = spark.createDataFrame([("f", k, *c) for k, c in enumerate(cues)] + [("g", 0, 0.0, 1.0, 5), ("g", 1, None, 1.0, 5)], "file string, ord long, start_sec double, end_sec double, gen_samples long")
    got = timeline.fit_to_cue(df.orderBy(F.rand(1)), 400)
    rows = got.filter("file = 'f'").orderBy("ord").collect()
    assert [(x["start_sample"], x["samples"]) for x in rows] == plain_fit(cues, 400)
    assert {x["total_samples"] for x in rows} == {max(int((max(c[1] for c in cues) + 0.5) * 400), max(x["start_sample"] + x["samples"] for x in rows))}
    assert got.filter("file = 'g'").count() == 1
    assert "collect_list" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("m", [mel.Mel(rate=1600, n_fft=16, hop=4, window=16, n_mels=5, high=800.0), mel.Mel(rate=8000, n_fft=64, hop=16, window=32, n_mels=10, low=50.0, high=3900.0)])
@pytest.mark.parametrize("n", [1, 3, 40, 500])
def test_spectrogram_is_the_direct_transform(monkeypatch, m, n):
    monkeypatch.setattr(mel, "BLOCK", 5 * m.n_fft)  # several blocks
    x = np.random.default_rng(n).normal(size=n)
    got = np.concatenate(list(mel.log_mel_blocks(x, m)))
    mirrored = lambda i: 0 if n == 1 else (i % (2 * n - 2) if i % (2 * n - 2) < n else 2 * n - 2 - i % (2 * n - 2))
    offset = (m.n_fft - m.window) // 2
    assert got.shape == (1 + n // m.hop, m.n_mels)
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)
    low, high = to_mel(m.low), to_mel(m.high)
    hz = [200 * v / 3 if v < 15 else 1000 * 6.4 ** ((v - 15) / 27) for v in (low + (high - low) * k / (m.n_mels + 1) for k in range(m.n_mels + 2))]
    for t in (0, len(got) // 2, len(got) - 1):
        frame = [x[mirrored(t * m.hop + j - m.n_fft // 2)] * (0.5 - 0.5 * np.cos(2 * np.pi * (j - offset) / m.window) if 0 <= j - offset < m.window else 0) for j in range(m.n_fft)]
        size = [abs(sum(v * np.exp(-2j * np.pi * k * j / m.n_fft) for j, v in enumerate(frame))) for k in range(m.n_fft // 2 + 1)]
        for b in range(m.n_mels):
            weights = [max(0, min((f - hz[b]) / (hz[b + 1] - hz[b]), (hz[b + 2] - f) / (hz[b + 2] - hz[b + 1]))) * 2 / (hz[b + 2] - hz[b]) for f in np.linspace(0, m.rate // 2, m.n_fft // 2 + 1)]
            assert got[t, b] == pytest.approx(np.log(max(1e-5, sum(w * s for w, s in zip(weights, size, strict=True)))), abs=1e-8)


def test_spectrogram_rows(spark):
    sounds = spark.createDataFrame([("a", [0.1] * 600), ("b", None), ("c", [])], "id string, samples array<float>")
    rows = mel.log_mel(sounds, "id").collect()
    assert [(x["id"], x["frame"], len(x["mel"])) for x in rows] == [("a", k, 80) for k in range(3)]


def test_a_dictionary_of_a_million_words(spark):
    words = spark.range(1_000_000).select(F.concat(F.lit("W"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), F.concat(F.lit("<"), "id", F.lit(">")).alias("spoken"))
    rows = spark.createDataFrame([(1, "wa, Wbc! the"), (1, "wb"), (None, "WB wzz"), (2, None), (3, "123"), (4, "wjajaj " * 1000)], "id long, t string")
    got = sorted((tuple(x) for x in lookup.transliterate_with(rows, "id", "t", words).collect()), key=repr)
    rule = lambda w: spark.range(1).select(text.transliterate(F.lit(w))).first()[0]
    assert got == sorted([(1, f"<0>, <12>! {rule('the')}"), (1, "<1>"), (None, f"<1> {rule('wzz')}"), (2, None), (3, "123"), (4, "<90909> " * 1000)], key=repr)
    more = lookup.add_word(words.limit(3), "WA", "x")
    assert lookup.dictionary(more).filter("word = 'wa'").first()["spoken"] == "x" and more.count() == 3


def plain_cardinal(n):
    """By recursion over a thousand million."""
    if n < 100:
        return text.CARDINALS[n]
    for size, unit in ((10**9, text.ARAB), (10**7, text.CRORE), (10**5, text.LAKH), (1000, text.THOUSAND), (100, text.HUNDRED)):
        if n >= size:
            return f"{plain_cardinal(n // size)} {unit}" + (f" {plain_cardinal(n % size)}" if n % size else "")
    raise AssertionError


def test_numbers_of_any_length(spark):
    own = random.Random(6)
    numbers = [str(own.randrange(10**k)) for k in (1, 5, 9, 10, 18, 19, 36, 37, 38, 40, 80, 100, 300)] + ["1" + "0" * k for k in (8, 9, 17, 18, 27, 36, 99)] + ["0" * 50, "0" * 40 + "7"]
    rows = spark.createDataFrame([(x,) for x in numbers], "n string").select("n", text.spell_digits(F.col("n")).alias("w"), text.expand_numbers(F.concat(F.lit("x "), "n")).alias("t")).collect()
    assert all(x["w"] == plain_cardinal(int(x["n"])) and x["t"] == "x " + x["w"] for x in rows)


def test_dictionary_words_are_put_in_without_interpreted_arrays(spark):
    words = spark.createDataFrame([("The", "X"), ("mute", ""), ("zoo", "<zoo>"), (None, "y")], "word string, spoken string")
    given = [(1, "the THE mute other"), (2, "Kthe zoo9zoo"), (2, "mute"), (None, "the"), (None, "zoo"), (3, None), (4, ""), (5, "9 क")]
    rows = spark.createDataFrame(given, "id long, t string")
    made = lookup.transliterate_with(rows, "id", "t", words)
    by_rule = {t: spark.range(1).select(text.transliterate(F.lit(t))).first()[0] for t in ("other",)}
    want = [(1, f"X X  {by_rule['other']}"), (2, "KX <zoo>9<zoo>"), (2, ""), (None, "X"), (None, "<zoo>"), (3, None), (4, ""), (5, "9 क")]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    assert "zip_with" not in made._jdf.queryExecution().optimizedPlan().toString()
