"""The pipeline's stages on planted documents."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from vanika.llm import queries
from vanika.llm.common import cut

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = cut(stage(spark, docs, DATA), name)
        assert kept.columns == columns
        if name == "toxicity":
            gone = {r[0] for r in docs.join(kept, "doc_id", "left_anti").select("doc_id").collect()}
            clean = [d for d in gone if labels.get(d) == 0]
            assert len(clean) <= 0.03 * before
        docs = kept
    assert 0 < docs.count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_planted(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    w = random.Random(6).choices([f"w{k}" for k in range(500)], k=400)
    near = [*w[:200], "changed", *w[201:]]
    rows = [(10**6, " ".join(w)), (10**6 + 1, " ".join(near)), (10**6 + 2, " ".join(w)), (10**6 + 3, "before this " + item + " after this")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], base.schema).unionByName(base)
    deduped = {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).select("doc_id").collect()}
    assert 10**6 in deduped and not {10**6 + 1, 10**6 + 2} & deduped
    clean = {r[0] for r in corpus_pipeline.decontamination(spark, docs, DATA).select("doc_id").collect()}
    assert 10**6 + 3 not in clean and 10**6 in clean


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "no id"), (None, None), (5, "word " * 30_000), (6, "Größe İ 世界 <|endoftext|>")]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_none(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, fp string, component_id int, shard int, found string"
    docs = spark.createDataFrame([(d, t, None, "s", len(t or ""), 1, "k", 2, 3, None) for d, t in ODD], schema)
    kept = stage(spark, docs, DATA)
    rows = kept.collect()
    if name == "packing":
        assert sum(x["length"] for x in rows if x["doc_id"] == 5) > 30_000 and {x["doc_id"] for x in rows} == {d for d, _ in ODD}
    else:
        assert kept.columns == docs.columns
        gone = {1, 2, 3} - {1} if name == "near_duplicates" else set()  # blank texts are copies of each other
        assert sorted((x["doc_id"] for x in rows), key=repr) == sorted((d for d, _ in ODD if d not in gone), key=repr)
    none = stage(spark, docs.limit(0), DATA)
    assert none.columns == kept.columns and none.collect() == []


def test_toxic_documents_go(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, folder)
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    clean = labels.filter("toxic = 0").select("doc_id").distinct()
    left = kept.select("doc_id").distinct()
    assert toxic.join(left, "doc_id", "left_semi").count() <= 0.2 * toxic.count()
    assert clean.join(left, "doc_id", "left_semi").count() >= 0.97 * clean.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, DATA)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    theirs = sorted(repr([str(dict(zip(columns, r))[c]) for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(repr([str(r[c]) for c in sorted(columns)]) for r in df.collect()) == theirs and sorted(df.columns) == sorted(columns)
