"""More named queries, over projects as wholes: registration, stages, clips, reports. catalogue lists them with its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanika.functions import similarity, text, tokens
from vanika.operators import evaluate, manifest, quality
from vanika.plans import catalogue as base
from vanika.plans import flows, project
from vanika.sources import reports, srt, store

_query, _table = base._query, base._table

_KNOWN = "known AS (SELECT DISTINCT p.url, 'src_' || lpad(p.page_id::VARCHAR, greatest(5, length(p.page_id::VARCHAR))::INT, '0') AS id FROM pages p JOIN labels l ON l.doc_id = p.page_id AND l.quality = 1)"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose label is good stand for the registered sources."""
    labels = _table(spark, sf_dir, "labels").filter("quality = 1")
    return _table(spark, sf_dir, "pages").join(labels, F.col("doc_id") == F.col("page_id")).select("url", F.concat(F.lit("src_"), F.format_string("%05d", "page_id")).alias("id")).distinct()


@_query(f"WITH {_KNOWN} SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM known)")
def new_source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.new_sources(_table(spark, sf_dir, "pages").select("page_id", "url"), _known(spark, sf_dir))


@_query(f"""WITH {_KNOWN}, u AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS ord, url FROM pages), t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id FROM documents),
z AS (SELECT ord, url, 'transcripts/' || doc_id || '.srt' AS transcript_path, {base._STABLE} AS b FROM u JOIN t USING (ord) WHERE url NOT IN (SELECT url FROM known))
SELECT ord, url, transcript_path, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY ord) > 1 OR b IN (SELECT id FROM known) THEN b || '_' || lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') ELSE b END AS id FROM z""")
def register_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = manifest.rank(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id").select("ord", "url")
    scripts = manifest.rank(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("ord", F.concat(F.lit("transcripts/"), "doc_id", F.lit(".srt")).alias("path"))
    return manifest.register(urls, scripts, _known(spark, sf_dir))


@_query("SELECT url, row_number() OVER (ORDER BY url) - 1 AS ord FROM pages")
def rank_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.rank(_table(spark, sf_dir, "pages").select("url"), "url")


@_query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("aligned"))
    return manifest.at_stage(_table(spark, sf_dir, "documents").join(labels.groupBy("doc_id").agg(F.bool_or("aligned").alias("aligned")), "doc_id", "left"), "aligned").select("doc_id", "source")


@_query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def clips_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("aligned"))
    return manifest.of_sources(_table(spark, sf_dir, "conversations").withColumn("source_id", F.col("conv_id")), sources, "aligned").select("conv_id", "turn")


_FILES = "f AS (SELECT d.doc_id AS id, coalesce(bool_or(l.toxic > 0), false) AS there, bool_or(l.toxic IS NOT NULL) AS known FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)"


@_query(f"WITH {_FILES} SELECT id, there FROM f")
def files_that_are_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("length"))
    return manifest.fetched(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).distinct(), files)


@_query(f"WITH {_FILES} SELECT count_if(NOT there AND known) AS downloaded, count_if(there) AS skipped, count_if(NOT coalesce(known, false)) AS failed, count(*) AS total FROM f")
def download_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    rows = manifest.fetched(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).distinct(), labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("length")))
    rows = rows.join(labels.filter("toxic IS NOT NULL").select(F.col("doc_id").alias("id")).distinct().withColumn("known", F.lit(True)), "id", "left")
    return manifest.outcomes(rows.withColumn("outcome", F.when(F.col("there"), "skipped").when(F.col("known"), "downloaded").otherwise("failed")), ["downloaded", "skipped", "failed"])


@_query("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def source_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.by_id(_table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "text")


@_query("SELECT count(*) AS sources, true AS engine_exported, count_if(quality = 1) AS aligned FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return manifest.stage_rollup(rows.select((F.col("quality") == 1).alias("aligned")), ["aligned"], exported=True)


@_query(f"WITH {base._CLIPS}, j AS (SELECT *, quality IS NULL AS bad FROM qc) SELECT count(*) AS total, count_if(bad) AS unreadable, count_if(NOT bad AND reason = 'ok') AS passed, count_if(NOT bad AND reason = 'duration') AS failed_duration, count_if(NOT bad AND reason = 'snr') AS failed_snr, count_if(NOT bad AND reason = 'silence') AS failed_silence, count_if(NOT bad AND reason = 'cer') AS failed_cer FROM j")
def qc_summary_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("hypothesis").isNull()  # documents without a label stand for clips that can't be read
    clips = base._clips(spark, sf_dir)
    return quality.summary(clips.withColumns({"duration": F.when(~bad, F.col("duration")), "passed": ~bad & F.col("passed"), "reason": F.when(~bad, F.col("reason"))}), count_unreadable=True)


@_query(f"""WITH t AS (SELECT n_chars / 100.0 AS d, text, {base._SPLIT.format('doc_id')} AS split FROM documents), w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS token FROM documents)
SELECT count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test, count(*) AS total, round(sum(d) / 3600, 2) AS hours, (SELECT count(*) FROM w) AS vocab_size FROM t""")
def training_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.training_totals(docs.select(quality.split_of(F.col("doc_id")).alias("split"), (F.col("n_chars") / 100.0).alias("duration")), quality.vocabulary(docs, "text"))


@_query(f"""WITH t AS (SELECT n_chars / 100.0 AS d, text, {base._SPLIT.format('doc_id')} AS split FROM documents), s AS (SELECT unnest({base._SEED_SQL}) AS token),
c AS (SELECT DISTINCT unnest({base._TOKENS_SQL}) AS token FROM t WHERE split <> 'test')
SELECT count_if(split = 'train') AS train_records, count_if(split = 'val') AS val_records, round(sum(CASE WHEN split = 'train' THEN d ELSE 0 END) / 3600, 3) AS train_hours, round(sum(CASE WHEN split = 'val' THEN d ELSE 0 END) / 3600, 3) AS val_hours,
(SELECT count(*) FROM (SELECT token FROM s UNION SELECT token FROM c)) AS vocab_size FROM t""")
def ready_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(quality.split_of(F.col("doc_id")).alias("split"), (F.col("n_chars") / 100.0).alias("duration"), F.col("text").alias("processed_text"))
    return flows.prepare(rows.filter("split = 'train'"), rows.filter("split = 'val'"))


@_query(f"""WITH m AS (SELECT token FROM {base._MISSING} WHERE token <> '' AND NOT list_contains({base._ALLOWED_SQL}, token)),
l AS (SELECT count(*) AS n, list_sort(list(token)) AS a FROM m),
p AS (SELECT n, list_transform(a[1:20], lambda c: CASE WHEN c = chr(39) THEN '"' || chr(39) || '"' WHEN c = chr(92) THEN chr(39) || chr(92) || chr(92) || chr(39) WHEN c = chr(9) THEN chr(39) || chr(92) || 't' || chr(39) WHEN c = chr(13) THEN chr(39) || chr(92) || 'r' || chr(39) ELSE chr(39) || c || chr(39) END || printf('(U+%04X)', unicode(c))) AS x FROM l)
SELECT n, array_to_string(x, ', ') || CASE WHEN n > 20 THEN ' (+' || (n - 20) || ' more)' ELSE '' END AS report FROM p""")
def missing_chars_with_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.missing_report(tokens.missing_characters(_table(spark, sf_dir, "documents"), base._ALLOWED), codes=True)


_CUES = """cues AS (SELECT conv_id AS source_id, turn AS index, turn * 0.5::DOUBLE AS s, turn * 0.5::DOUBLE + 0.25 * (length(text) % 24) AS e, text FROM conversations),
x AS (SELECT c.*, e - s AS d, v.embedding[greatest(0, floor(s * 8))::INT + 1:(greatest(0, floor(s * 8)) + floor((e - s) * 8))::INT] AS w FROM cues c JOIN embeddings v ON v.vec_id = c.source_id),
v AS (SELECT *, list_transform(w, lambda y: 20 * log10(sqrt(y::DOUBLE * y::DOUBLE + 1e-12) + 1e-12) > -20) AS v FROM x),
k AS (SELECT *, CASE WHEN list_contains(v, true) THEN w[list_position(v, true):len(v) - list_position(list_reverse(v), true) + 1] ELSE w END AS t FROM v),
o AS (SELECT source_id::VARCHAR || '_c' || lpad(index::VARCHAR, greatest(6, length(index::VARCHAR))::INT, '0') AS clip_id, source_id, round(d, 3) AS duration, CASE WHEN d < 1.5 OR d > 4 THEN 'rejected' WHEN len(t) >= 12 THEN 'created' ELSE 'rejected' END AS outcome, t FROM k)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 0.5
    cues = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("index"), start.alias("start_sec"), (start + 0.25 * (F.length("text") % 24)).alias("end_sec"), "text")
    sounds = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.lit(8).alias("rate"), F.col("embedding").alias("samples"))
    return flows.segment(cues, sounds, most=4.0, threshold_db=-20.0)


@_query(f"WITH {_CUES} SELECT clip_id, source_id, duration, outcome, CASE WHEN outcome = 'created' THEN array_to_string(list_transform(t, lambda y: round(y * 1000)::INT), ' ') END AS samples FROM o")
def segment_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = base._thousandths(F.col("samples"))
    return _segments(spark, sf_dir).select("clip_id", "source_id", F.round("duration", 3).alias("duration"), "outcome", F.when(F.col("samples").isNotNull(), samples).alias("samples"))


@_query(f"WITH {_CUES} SELECT count_if(outcome = 'created') AS created, count_if(outcome = 'skipped') AS skipped, count_if(outcome = 'rejected') AS rejected, count(*) AS total FROM o")
def segment_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.outcomes(_segments(spark, sf_dir), ["created", "skipped", "rejected"])


_PLAIN = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"
_EVAL = f"""i AS (SELECT doc_id, source AS category, {_PLAIN} AS r, n_chars FROM documents), j AS (SELECT *, length(replace(r, ' ', '')) AS n, len(list_filter(string_split(r, ' '), lambda w: w <> '')) AS m FROM i),
e AS (SELECT doc_id::VARCHAR AS item_id, category, CASE WHEN m = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN doc_id % 2 = 0 THEN 5.0 ELSE 0.0 END / n END::DOUBLE AS cer, CASE WHEN m = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END / m END::DOUBLE AS wer,
NULL::DOUBLE AS utmos, n_chars / 16.0::DOUBLE AS duration_sec, CASE WHEN n_chars > 0 THEN 0.25 + n_chars % 8 END::DOUBLE AS rtf FROM j)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an item; of every second one a word more is heard than is said."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +", " "))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("category"), plain.alias("reference"), (F.col("n_chars") / 16.0).alias("duration_sec"), (F.col("doc_id") % 2 == 0).alias("odd"), "n_chars")
    heard = F.when(F.col("odd"), F.concat("reference", F.lit(" xxxxx"))).otherwise(F.col("reference"))
    rows = rows.select("*", heard.alias("hypothesis"), ((0.25 + F.col("n_chars") % 8) * F.col("duration_sec")).alias("generation_sec"))
    return evaluate.metrics(rows).withColumn("utmos", F.lit(None).cast("double")).select("item_id", "category", "cer", "wer", "utmos", "duration_sec", "rtf")


@_query(f"WITH {_EVAL} SELECT item_id, category, printf('%.4f', cer) AS cer, printf('%.4f', wer) AS wer, '' AS utmos, printf('%.3f', duration_sec) AS duration_sec, CASE WHEN rtf IS NULL THEN '' ELSE printf('%.3f', rtf) END AS rtf FROM e")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_lines(_evaluated(spark, sf_dir))


@_query(f"WITH {_EVAL} SELECT category, count(*) AS n, round(avg(cer), 6) AS cer_mean, round(avg(wer), 6) AS wer_mean, avg(utmos) AS utmos_mean, round(avg(duration_sec), 6) AS duration_sec_mean, round(avg(rtf), 6) AS rtf_mean FROM e GROUP BY ROLLUP (category)")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluate.report(_evaluated(spark, sf_dir))
    return means.select("category", "n", *(F.round(f"{c}_mean", 6).alias(f"{c}_mean") for c in evaluate.METRICS))


@_query("SELECT conv_id, turn, CASE WHEN text IS NULL OR turn % 2 = 0 THEN true ELSE length(replace(replace(text, ' ', ''), chr(10), '')) >= 50 END AS passed FROM conversations")
def roundtrip_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.when(F.col("turn") % 2 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("x")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.round_trip(F.col("text"), heard, 0.02).alias("t")).select("conv_id", "turn", "t.passed")


@_query("SELECT conv_id, turn, CASE WHEN turn > 0 THEN conv_id / turn::DOUBLE END AS rtf, CASE WHEN conv_id IS NOT NULL THEN conv_id || ' ' || (conv_id + 1) || ' ' || (conv_id + 2) END AS seeds FROM conversations")
def speed_and_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = F.array_join(evaluate.seeds(F.col("conv_id"), 2).cast("array<string>"), " ")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", similarity.rtf(F.col("conv_id").cast("double"), F.col("turn").cast("double")).alias("rtf"), F.when(F.col("conv_id").isNotNull(), seeds).alias("seeds"))


@_query("SELECT max(o_orderkey) AS step, 'ckpt_step_' || lpad(max(o_orderkey)::VARCHAR, greatest(8, length(max(o_orderkey)::VARCHAR))::INT, '0') || '.pt' AS name FROM orders")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latest_checkpoint(_table(spark, sf_dir, "orders").select(F.concat(F.lit("ckpt_step_"), F.format_string("%08d", "o_orderkey"), F.lit(".pt")).alias("name")))


@_query("SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'engine version 2' WHEN 2 THEN 'model type tts' ELSE 'language en' END AS error FROM embeddings")
def engine_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(k: int, bad: str | int, good: str | int) -> Column:
        return F.when(F.col("vec_id") % 4 == k, F.lit(bad)).otherwise(F.lit(good))

    return _table(spark, sf_dir, "embeddings").select("vec_id", reports.engine_error(pick(1, 2, 1), pick(2, "tts", "vits"), pick(3, "en", "hi")).alias("error"))


_STAMP = base._sql_stamp


@_query(f"""SELECT doc_id::VARCHAR AS path, (doc_id + 1)::BIGINT AS index, (doc_id % 5000) / 8.0::DOUBLE AS start_sec, (doc_id % 5000) / 8.0::DOUBLE + 1.5 AS end_sec, regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '^ +| +$', '', 'g') AS text, NULL::VARCHAR AS error
FROM documents WHERE regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '^ +| +$', '', 'g') <> ''""")
def srt_parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a subtitle file of one cue, written and read again."""
    start = (F.col("doc_id") % 5000) / 8.0
    body = F.concat((F.col("doc_id") + 1).cast("string"), F.lit("\r\n"), srt.stamp(start), F.lit(" --> "), srt.stamp(start + 1.5), F.lit("\r\n"), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit("\r\n"))
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), body.alias("value"))
    return srt.parse(files).select("path", "index", "start_sec", "end_sec", "text", "error")


@_query("""WITH r AS (SELECT vec_id, vec_id // 4 AS batch, embedding[1:1 + (vec_id % 5)::INT] AS mel, embedding[1:2 + (vec_id % 9)::INT] AS audio FROM embeddings), m AS (SELECT *, max(len(mel)) OVER (PARTITION BY batch) AS a, max(len(audio)) OVER (PARTITION BY batch) AS b FROM r)
SELECT vec_id, batch::BIGINT AS batch, len(mel)::INT AS n_mel, len(audio)::INT AS n_audio, array_to_string(list_transform(list_concat(mel, list_transform(range(a - len(mel)), lambda i: 0::FLOAT)), lambda x: round(x * 1000)::INT), ' ') AS mel, array_to_string(list_transform(list_concat(audio, list_transform(range(b - len(audio)), lambda i: 0::FLOAT)), lambda x: round(x * 1000)::INT), ' ') AS audio FROM m""")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def head(n: Column) -> Column:
        return F.slice("embedding", F.lit(1), n.cast("int"))

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", head(F.col("vec_id") % 5 + 1).alias("mel"), head(F.col("vec_id") % 9 + 2).alias("audio"))
    rows = quality.collate(rows, 4, "vec_id", {"mel": 0.0, "audio": 0.0})
    return rows.select("vec_id", "batch", "n_mel", "n_audio", *(base._thousandths(F.col(c)).alias(c) for c in ("mel", "audio")))


@_query("SELECT vec_id, array_to_string(list_transform(embedding[(vec_id % 5) * 8 + 1:(vec_id % 5) * 8 + 16], lambda x: round(x * 1000)::INT), ' ') AS samples FROM embeddings")
def interval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.functions import audio

    clip = audio.interval(F.col("embedding"), 8, (F.col("vec_id") % 5).cast("double"), F.lit(2.0))
    return _table(spark, sf_dir, "embeddings").select("vec_id", base._thousandths(clip).alias("samples"))


_TWO_RUNS = f"""s AS (SELECT page_id AS p, url, 'src_' || lpad(page_id::VARCHAR, greatest(5, length(page_id::VARCHAR))::INT, '0') AS id, page_id % 3 <> 0 AS early, page_id % 5 <> 4 AND page_id IN (SELECT vec_id FROM embeddings) AS media FROM pages),
c AS (SELECT conv_id AS p, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, turn * 0.5::DOUBLE AS st, turn * 0.5::DOUBLE + 0.25 * (length(text) % 24) AS en, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE trim(text, E' \\n\\t') <> ''),
w AS (SELECT conv_id AS p, turn AS word, turn * 0.5::DOUBLE + 0.125 AS ws, turn * 0.5::DOUBLE + 1.75 AS we FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 <> 1),
a AS (SELECT c.p, c.index, arg_min(ws, (abs(ws - st), word)) AS ns FROM c JOIN w USING (p) WHERE ws BETWEEN st - 1 AND en + 1 GROUP BY 1, 2),
b AS (SELECT c.p, c.index, arg_min(we, (abs(we - en), word)) AS ne FROM c JOIN w USING (p) WHERE we BETWEEN st - 1 AND en + 1 GROUP BY 1, 2),
j AS (SELECT c.p, c.index, c.text, coalesce(ns, st) AS x, coalesce(ne, en) AS y, en - st AS d FROM c LEFT JOIN a USING (p, index) LEFT JOIN b USING (p, index)),
n AS (SELECT p, index, text, x, CASE WHEN y <= x THEN x + greatest(0.3, d) ELSE y END AS y FROM j),
q AS (SELECT s.p, s.id, s.early, s.id || '_c' || lpad(index::VARCHAR, 6, '0') AS clip_id, n.text, index, y - x AS d, v.embedding[greatest(0, floor(x * 8))::INT + 1:(greatest(0, floor(x * 8)) + floor((y - x) * 8))::INT] AS w FROM n JOIN s USING (p) JOIN embeddings v ON v.vec_id = n.p WHERE s.media),
v AS (SELECT *, list_transform(w, lambda z: 20 * log10(sqrt(z::DOUBLE * z::DOUBLE + 1e-12) + 1e-12) > -20) AS v FROM q),
k AS (SELECT *, CASE WHEN list_contains(v, true) THEN w[list_position(v, true):len(v) - list_position(list_reverse(v), true) + 1] ELSE w END AS t FROM v),
o AS (SELECT *, d BETWEEN 1.0 AND 4.0 AND len(t) >= 8 AS created FROM k),
r AS (SELECT *, len(t) / 8.0::DOUBLE AS sec, list_sort(list_transform(range(len(t) // 8), lambda i: sqrt(list_sum(list_transform(t[i * 8 + 1:i * 8 + 8], lambda z: z::DOUBLE * z::DOUBLE)) / 8 + 1e-12))) AS rms FROM o WHERE created),
m AS (SELECT *, CASE WHEN len(t) < 16 THEN 0.0 ELSE 20 * log10(list_avg(rms[-greatest(1, len(rms) // 10):]) / list_avg(rms[1:greatest(1, len(rms) // 10)])) END AS snr, len(list_filter(rms, lambda z: 20 * log10(z + 1e-12) < -40)) / len(rms)::DOUBLE AS quiet,
  CASE WHEN p % 2 = 0 THEN 15.0::DOUBLE ELSE 0 END / length(replace(text, ' ', '')) AS cer FROM r),
z AS (SELECT *, CASE WHEN sec < 1.0 OR sec > 4.0 THEN 'duration' WHEN snr < 0.75 THEN 'snr' WHEN quiet > 0.25 THEN 'silence' WHEN cer > 0.05 THEN 'cer' ELSE 'ok' END AS reason, {base._SPLIT.format('clip_id')} AS split FROM m)"""


def _two_runs_sql() -> str:
    """Every counter of both runs as a row: the second run skips what the first has done."""
    has, said = "p IN (SELECT p FROM c)", "p IN (SELECT p FROM w)"
    rows = []
    for run, seen, new, old in ((1, "early", "early", "false"), (2, "true", "NOT early", "early")):
        count = {
            ("register", "added"): ("s", new), ("download", "downloaded"): ("s", f"media AND {new}"), ("download", "skipped"): ("s", f"media AND {old}"), ("download", "failed"): ("s", f"NOT media AND {seen}"), ("download", "total"): ("s", seen),
            ("align", "aligned"): ("s", f"media AND {has} AND {new}"), ("align", "skipped"): ("s", f"media AND {has} AND {old}"), ("align", "failed"): ("s", f"media AND NOT {has} AND {seen}"), ("align", "fallback_used"): ("s", f"media AND {has} AND NOT {said} AND {new}"),
            ("segment", "clips_created"): ("o", f"created AND {new}"), ("segment", "clips_skipped_existing"): ("o", f"created AND {old}"), ("segment", "clips_rejected"): ("o", f"NOT created AND {seen}"), ("segment", "sources_processed"): ("s", f"media AND {has} AND {seen}"),
            ("qc", "total"): ("z", seen), ("qc", "passed"): ("z", f"reason = 'ok' AND {seen}"), **{("qc", f"failed_{x}"): ("z", f"reason = '{x}' AND {seen}") for x in ("duration", "snr", "silence", "cer")},
            **{("dataset", x): ("z", f"reason = 'ok' AND split = '{x}' AND {seen}") for x in ("train", "val", "test")}, ("dataset", "total"): ("z", f"reason = 'ok' AND {seen}"),
        }
        rows += [f"SELECT {run} AS run, '{stage}' AS stage, '{outcome}' AS outcome, (SELECT count(*) FROM {where} WHERE {which})::DOUBLE AS n" for (stage, outcome), (where, which) in count.items()]
        kept = f"FROM z WHERE reason = 'ok' AND {seen}"
        rows.append(f"SELECT {run}, 'dataset', 'hours', coalesce((SELECT round(sum(sec) / 3600, 2) {kept}), 0)")
        rows.append(f"SELECT {run}, 'dataset', 'vocab_size', (SELECT count(DISTINCT x) FROM (SELECT unnest(regexp_split_to_array(nfc_normalize(text), '\\s+')) AS x {kept}))")
    return f"WITH {_TWO_RUNS} " + " UNION ALL ".join(rows)


@_query(_two_runs_sql())
def project_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project in two runs, with sources added between: conversations as transcripts of pages, embeddings as their sounds."""
    def source(c: str) -> Column:
        return F.concat(F.lit("src_"), F.format_string("%05d", c))

    pages, turns = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "conversations")
    start = F.col("turn") * 0.5
    path = F.concat(F.lit("t/"), "conv_id", F.lit(".srt"))
    cues = turns.filter(F.trim("text", F.lit(" \n\t")) != "").select(path.alias("path"), F.col("turn").alias("ord"), start.alias("start_sec"), (start + 0.25 * (F.length("text") % 24)).alias("end_sec"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    words = turns.filter("turn % 2 = 0 AND conv_id % 3 <> 1").select(source("conv_id").alias("source_id"), F.col("turn").alias("ord"), (start + 0.125).alias("start"), (start + 1.75).alias("end"))
    sounds = _table(spark, sf_dir, "embeddings").filter("vec_id % 5 <> 4").select(source("vec_id").alias("source_id"), F.lit(8).alias("rate"), F.col("embedding").alias("samples"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    heard = cues.select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("conv"), place.alias("index"), "text")
    heard = heard.select(manifest.clip_id(source("conv"), F.col("index")).alias("clip_id"), F.when(F.col("conv") % 2 == 0, F.concat("text", F.lit(" xxxxxxxxxxxxxxx"))).otherwise(F.col("text")).alias("hypothesis"))
    settings = {"clip_min_seconds": 1.0, "clip_max_seconds": 4.0, "qc": {"min_snr_db": 0.75}}
    own, runs = project.Project(spark, store.scratch(spark, "project"), settings, frame=8, threshold_db=-20.0), []
    for chosen in (pages.filter("page_id % 3 <> 0"), pages):
        urls = chosen.select(F.col("page_id").alias("ord"), "url")
        added = own.register(urls, chosen.select(F.col("page_id").alias("ord"), F.concat(F.lit("t/"), "page_id", F.lit(".srt")).alias("path")))
        runs.append({"register": {"added": added}} | own.run(sounds, srt.format_files(cues), words, heard, frontend=text.normalize))
    return project.counted(spark, runs)
