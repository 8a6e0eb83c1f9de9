"""Named queries over what a project writes and reads again: reports, splits, manifests, vocabularies, tokenizers, test sets, URL lists. catalogue lists them with its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.functions import tokens
from vanika.operators import evaluate, quality
from vanika.plans import catalogue as base
from vanika.plans import flows
from vanika.sources import files, reports, store

_query, _table = base._query, base._table


@_query(f"WITH {base._CLIPS} SELECT clip_id::VARCHAR AS clip_id, source_id, duration, snr_db, round(silence_ratio, 3) AS silence_ratio, CASE WHEN quality = 1 THEN 0.0 END::DOUBLE AS whisper_cer, 1 AS passed, 'ok' AS reason FROM qc WHERE reason = 'ok'")
def qc_report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passed rows of a quality report that was written as CSV."""
    path = store.scratch(spark, "qc")
    files.write_qc_report(base._clips(spark, sf_dir), path)
    return files.read_qc_report(spark, path)


@_query(f"""WITH t AS (SELECT doc_id, text, source, {base._SPLIT.format('doc_id')} AS split FROM documents)
SELECT split, '/root/' || CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source || '/' || doc_id || '.wav' END AS audio_file, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source || ' | "' || doc_id || '"' END AS text, 'hindi' AS speaker_name FROM t WHERE doc_id % 10 <> 0""")
def split_samples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each split, read by the formatter that a training run asks for: texts with pipes and quotes, some without processed text, some without a path."""
    root = store.scratch(spark, "splits")
    docs, key = _table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.when(key % 10 == 0, "").otherwise(F.concat("source", F.lit("/"), key, F.lit(".wav")))
    raw = F.concat("source", F.lit(' | "'), key, F.lit('"'))
    rows = docs.select(path.alias("audio_path"), F.when(key % 3 == 0, "x").otherwise(raw).alias("raw_text"), F.when(key % 3 == 0, F.upper("source")).otherwise("").alias("processed_text"), F.lit(1.0).alias("duration"), F.col("source").alias("source_id"), quality.split_of(key).alias("split"))
    files.write_splits(rows, f"{root}/training_set")
    found = [flows.samples(spark, root, split).withColumn("split", F.lit(split)) for split in ("train", "val", "test") if not rows.filter(F.col("split") == split).isEmpty()]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("split", F.replace("audio_file", F.lit(f"{root}/"), F.lit("/root/")).alias("audio_file"), "text", "speaker_name")


@_query("""SELECT page_id AS ord, 's' || page_id AS id, url, 't/' || page_id || '.srt' AS transcript_path, CASE WHEN page_id % 2 = 0 THEN page_id / 4.0::DOUBLE END AS duration_sec, page_id % 2 = 0 AS downloaded, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS qc_passed, CASE WHEN page_id % 5 = 0 THEN 'err "x"' END AS error FROM pages""")
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with stages as one JSON manifest, in order."""
    path, key = store.scratch(spark, "manifest"), F.col("page_id")
    status = F.struct((key % 2 == 0).alias("downloaded"), F.lit(False).alias("aligned"), F.lit(False).alias("segmented"), F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("qc_passed"))
    rows = _table(spark, sf_dir, "pages").select(key.alias("ord"), F.concat(F.lit("s"), key).alias("id"), "url", F.concat(F.lit("t/"), key, F.lit(".srt")).alias("transcript_path"), F.lit(None).cast("string").alias("audio_path"), F.when(key % 2 == 0, key / 4.0).alias("duration_sec"), status.alias("status"), F.when(key % 5 == 0, 'err "x"').alias("error"))
    files.write_manifest(rows, path)
    got = files.read_manifest(spark, path)
    return got.select(F.substring("id", 2, 20).cast("long").alias("ord"), "id", "url", "transcript_path", "duration_sec", "status.downloaded", "status.qc_passed", "error")


@_query(r"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS token FROM conversations")
def vocabulary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary as a sorted JSON array."""
    path = store.scratch(spark, "vocabulary")
    files.write_vocabulary(quality.vocabulary(_table(spark, sf_dir, "conversations"), "text"), path)
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.trim("value"), "array<string>")).alias("token"))


@_query(base._SQL["tokenizer_fit"])
def tokenizer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted tokenizer as JSON, with its ids."""
    path = store.scratch(spark, "tokenizer")
    fitted = base.tokenizer_fit(spark, sf_dir)
    files.write_tokenizer(fitted, tokens.RESERVED, path)
    return files.read_tokenizer(spark, path).select(*(F.col(c).cast(dict(fitted.dtypes)[c]).alias(c) for c in fitted.columns))


@_query("""WITH t AS (SELECT CASE turn % 5 WHEN 0 THEN 'narration' WHEN 1 THEN 'dialogue' WHEN 2 THEN 'numeric' WHEN 3 THEN 'pronunciation' ELSE 'long' END AS category, conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN ' ' ELSE ' ' || conv_id || ' said "' || role || '" ' END AS raw FROM conversations),
n AS (SELECT category, trim(raw) AS text, row_number() OVER (PARTITION BY category ORDER BY conv_id, turn) - 1 AS i FROM t)
SELECT category || '_' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0') || '_' || substr(sha1(category || ':' || text), 1, 8) AS id, category, text FROM n WHERE text <> ''""")
def test_set_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by category as a test set, written as JSON; blank texts count in the numbers and are left out."""
    path, kinds = store.scratch(spark, "test-set"), evaluate.CATEGORIES
    turns = _table(spark, sf_dir, "conversations")
    category = F.element_at(F.array(*map(F.lit, kinds)), (F.col("turn") % 5 + 1).cast("int"))
    raw = F.when(F.col("conv_id") % 4 == 0, " ").otherwise(F.concat(F.lit(" "), "conv_id", F.lit(' said "'), "role", F.lit('" ')))
    texts = turns.groupBy(category.alias("category")).agg(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", raw.alias("raw")))), lambda x: x["raw"]).alias("texts"))  # a test set is small
    items = evaluate.test_items(texts).filter(evaluate.check_category(F.col("category")).isNull())
    reports.write_test_set(items.withColumn("ord", F.monotonically_increasing_id()), path)
    return files.read_test_set(spark, path).select("id", "category", "text")


@_query("SELECT row_number() OVER (ORDER BY page_id) * 3 - 1 AS ord, url FROM pages")
def url_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of URLs with comments, blanks and white space, one file in order; places count all lines."""
    path = store.scratch(spark, "urls")
    lines = _table(spark, sf_dir, "pages").repartition(1).sortWithinPartitions("page_id").select(F.explode(F.array(F.lit("# next"), F.lit(" "), F.concat(F.lit("  "), "url", F.lit("\t")))).alias("value"))
    lines.write.text(path)
    return files.read_urls(spark, path).select(F.col("ord").cast("long").alias("ord"), "url")


@_query("SELECT lpad(conv_id::VARCHAR, 8, '0') || '.srt' AS name, row_number() OVER (ORDER BY conv_id) AS place, (sum(length(turn::VARCHAR)) > 0) AS has_bytes FROM conversations GROUP BY conv_id")
def transcript_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitle files of a folder by name, whose contents aren't read."""
    from pyspark.sql.window import Window

    from vanika.sources import media

    folder = store.scratch(spark, "listing")
    cues = _table(spark, sf_dir, "conversations").select(F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit(".srt")).alias("path"), F.col("turn").alias("ord"), F.col("turn").alias("start_sec"), (F.col("turn") + 1).alias("end_sec"), F.lit("x").alias("text"))
    media.write_subtitles(cues, folder)
    listed = files.list_files(spark, folder, "*.srt").select(F.substring_index("path", "/", -1).alias("name"), "length")
    return listed.select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("place"), (F.col("length") > 0).alias("has_bytes"))  # a listing
