"""Edit distances of any length against the plain table, and what is built on them."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanika.functions import distance, similarity
from vanika.operators import evaluate


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("places,block", [(1 << 29, 1 << 14), (0, 1), (0, 5), (0, 7)])
def test_every_way_gives_the_same(monkeypatch, places, block):
    monkeypatch.setattr(distance, "PLACES", places)
    monkeypatch.setattr(distance, "BLOCK", block)
    own = random.Random(block)
    for k in range(1200):
        letters = own.choice([2, 3, 20])
        a = [own.randrange(letters) for _ in range(own.randrange(30))]
        b = [own.randrange(letters) for _ in range(own.randrange(30))] if k % 2 else [x if own.random() < 0.8 else own.randrange(letters) for x in a if own.random() < 0.9]
        x, y, want = np.array(a, np.int64), np.array(b, np.int64), plain(a, b)
        assert distance.by_rows(x, y) == distance.banded(x, y) == distance.edit_distance(x, y) == want


def test_long_texts_with_few_edits_take_seconds():
    own = np.random.default_rng(1)
    a = own.integers(97, 123, 1_000_000).astype(np.uint32)
    b = a.copy()
    b[own.choice(len(a), 12, replace=False)] = 65
    b = np.insert(np.delete(b, own.choice(len(b), 4, replace=False)), own.choice(len(b) - 4, 4, replace=False), 66)
    began = time.time()
    assert distance.edit_distance(a, b) == 20 and time.time() - began < 10


def test_unlike_texts():
    own = np.random.default_rng(2)
    for m, n in ((130, 900), (700, 700), (2000, 300)):
        a, b = own.integers(97, 123, m), own.integers(97, 123, n)
        assert distance.edit_distance(a, b) == distance.by_rows(a, b) == plain(a.tolist(), b.tolist()) if m * n < 200_000 else distance.banded(a, b) == distance.by_rows(a, b)


def test_words_past_every_alphabet(spark):
    words = [f"w{k}" for k in range(1_150_000)]
    assert distance.edit_distance(*distance.word_ids(words, [*words[:5], "other", *words[6:]])) == 1
    rows = spark.createDataFrame([("a b c", "a x c"), ("", "a"), ("", ""), (None, "a b"), ("a", None), ("a\x1cb", "a b")], "r string, h string")
    assert [x[0] for x in rows.select(similarity.wer(F.col("r"), F.col("h"))).collect()] == pytest.approx([1 / 3, 1, 0, 1, 1, 0])


def test_character_rates(spark):
    rows = spark.createDataFrame([("Abc ", "abc"), ("é", "é"), ("", " x"), (None, None), ("\U0001f600a", "a"), ("ab\nc", "a bc")], "r string, h string")
    got = [tuple(x) for x in rows.select(similarity.cer(F.col("r"), F.col("h"), cased=False), similarity.cer(F.col("r"), F.col("h")), similarity.edits(F.col("r"), F.col("h"))).collect()]
    assert got == [(0, pytest.approx(1 / 3), 2), (0, 0, 2), (1, 1, 2), (0, 0, 0), (0.5, 0.5, 1), (0, 0, 2)]


def test_no_single_partition_sorts_the_listing(spark):
    names = spark.range(5000).select(F.format_string("ckpt_step_%08d.pt", F.col("id")).alias("name")).repartition(8)
    kept = evaluate.keep_checkpoints(names, 3)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and {x["step"] for x in kept.filter("kept").collect()} == {0, 4997, 4998, 4999} and kept.count() == 5000
    assert {x["step"] for x in evaluate.keep_checkpoints(names, 0).filter("kept").collect()} == {0}
    assert evaluate.keep_checkpoints(names.filter("false"), 3).collect() == []


def test_steps_are_as_many_as_the_shorter_has_values(monkeypatch):
    steps, block = [], distance._block
    monkeypatch.setattr(distance, "_block", lambda a, values, given: steps.append(len(values)) or block(a, values, given))
    own = np.random.default_rng(3)
    for alphabet in (20, 300):
        a, b = own.integers(0, alphabet, 150), own.integers(0, alphabet, 4000)
        assert distance.edit_distance(a, b) == distance.edit_distance(b, a) == plain(a.tolist(), b.tolist())
    assert len(steps) == 4 and max(steps) <= 150
