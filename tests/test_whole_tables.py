"""Queries over whole tables, held against plain versions on small ones."""

import unicodedata

import pytest

import __spark_entry__


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


#: Ids over 400, more than 600 characters, more than 94 distinct words, other scripts.
DOCS = [(0, "the cat sat"), (399, "über die Brücke gehen"), (401, " ".join(f"word{k}" for k in range(150))), (90_001, "यह एक वाक्य है " * 60), (90_002, ""), (90_003, None), (90_004, "x the\ncat"), (7, "\U0001f600 the cat")]
ITEMS = [(3, "the cat sat on the mat"), (50, "यह एक वाक्य है"), (51, "über Brücken gehen")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.range(0, 700).toDF("o_orderkey").write.parquet(f"{path}/orders.parquet")
    return path


def pairs():
    return [(*ITEMS[d % len(ITEMS)], d, t or "") for d, t in DOCS]


def test_cer_documents(spark, folder):
    def bare(t):
        return unicodedata.normalize("NFC", t).lower().strip().replace(" ", "").replace("\n", "")

    got = {(x["item_id"], x["doc_id"]): x["cer"] for x in __spark_entry__.queries()["cer_documents"](spark, folder).collect()}
    assert got == {(i, d): pytest.approx(edits(bare(r), bare(h)) / len(bare(r)), abs=1e-8) for i, r, d, h in pairs()}


def test_wer_documents(spark, folder):
    got = {(x["item_id"], x["doc_id"]): x["wer"] for x in __spark_entry__.queries()["wer_documents"](spark, folder).collect()}
    assert got == {(i, d): pytest.approx(edits(r.split(), h.split()) / len(r.split()), abs=1e-8) for i, r, d, h in pairs()}


def test_many_distinct_words(spark):
    from vanika.operators import evaluate

    words = [f"w{k}" for k in range(40_000)]
    rows = spark.createDataFrame([(1, "w39998 w1 w39999", " ".join(words))], "k int, r string, h string")
    assert evaluate.word_error_rates(rows, "r", "h").first()["wer"] == pytest.approx((len(words) - 2) / 3)


def test_checkpoint_retention_orders(spark, folder):
    rows = __spark_entry__.queries()["checkpoint_retention_orders"](spark, folder).collect()
    assert {x["step"] for x in rows} == set(range(700))
    assert {x["step"] for x in rows if x["kept"]} == {0, 695, 696, 697, 698, 699}
