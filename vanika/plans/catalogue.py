"""The named queries over the driver's tables, each with the same rows in DuckDB's SQL where SQL can express them.

The tables stand in for a speech project's: documents and conversations for transcripts, events for words and attempts, embeddings for
short waveforms. Texts that the tables don't have (Devanagari, subtitles) are inline values on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanika.functions import audio, similarity, text, tokens
from vanika.operators import align, evaluate, manifest, quality, timeline
from vanika.plans import fixtures as fx
from vanika.sources import srt

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_WHOLE: dict[str, Query] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _whole(f: Query) -> Query:
    """A query that DuckDB can't follow; tests hold it against plain versions."""
    _WHOLE[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _thousandths(samples: Column) -> Column:
    """Samples in whole thousandths, as one text. A float times an integer is a double to Spark but a float to SQL, and halves only come up in the latter."""
    return F.array_join(F.transform(samples, lambda x: F.round(x * F.lit(1000).cast("float")).cast("int").cast("string")), " ")


# --- identifiers and splits

_SHARE = "('0x' || substr(sha1({0}::VARCHAR), 1, 8))::UBIGINT / 4294967295.0"
_SPLIT = "CASE WHEN " + _SHARE + " < 0.01 THEN 'test' WHEN " + _SHARE + " < 0.05 THEN 'val' ELSE 'train' END"


@_query(f"SELECT {_SPLIT.format('doc_id')} AS split, count(*) AS n, round(sum(n_chars) / 3600.0, 2) AS hours FROM documents GROUP BY 1")
def hash_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(quality.split_of(F.col("doc_id")).alias("split"), "n_chars")
    return quality.split_summary(rows, "n_chars")


@_query(f"SELECT l_orderkey, l_linenumber, {_SPLIT.format('l_orderkey')} AS split FROM lineitem")
def hash_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quality.split_of(F.col("l_orderkey")).alias("split"))


_STABLE = r"'src_' || CASE WHEN regexp_extract(url, '(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{6,})', 1) <> '' THEN regexp_extract(url, '(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{6,})', 1) ELSE lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') END"
_URL_ROWS = f"(SELECT page_id AS ord, url FROM pages UNION ALL SELECT * FROM (VALUES {fx.values(fx.URLS)}) v(ord, url))"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url")
    return pages.unionByName(_rows(spark, fx.URLS, "ord long, url string"))


@_query(f"SELECT ord, url, {_STABLE} AS id FROM {_URL_ROWS}")
def stable_ids_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).withColumn("id", manifest.stable_id(F.col("url"), F.col("ord")))


@_query(f"""WITH b AS (SELECT ord, url, {_STABLE} AS base FROM {_URL_ROWS})
SELECT ord, url, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY ord, url) > 1 THEN base || '_' || lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') ELSE base END AS id FROM b""")
def dedupe_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.assign_ids(_urls(spark, sf_dir)).select("ord", "url", "id")


@_query("""WITH u AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS ord, url FROM pages),
t AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, text AS transcript_path FROM benchmark)
SELECT ord, url, transcript_path FROM u JOIN t USING (ord)""")
def zip_join_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = manifest.rank(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    items = manifest.rank(_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("path")), "item_id")
    return manifest.zip_sources(urls.select("ord", "url"), items.select("ord", "path"))


@_query("SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(DISTINCT doc_id) FROM documents) AS b")
def count_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return manifest.assert_equal_counts(docs, docs.select("doc_id").distinct()).filter("ok IS NULL").select("a", "b")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_sources_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.pending(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def existing_clips_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("clip_id"), "quality")
    files = labels.withColumn("kind", F.lit("wav")).unionByName(labels.filter("quality = 1").withColumn("kind", F.lit("txt")))
    return manifest.existing_clips(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), "source"), files).select(F.col("clip_id").alias("doc_id"), "source")


@_query("""SELECT c.conv_id, c.turn, c.role || '_' || lpad(c.turn::VARCHAR, 4, '0') || '_' || substr(sha1(c.role || ':' || trim(c.text, E' \\n\\t')), 1, 8) AS id FROM conversations c""")
def test_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.item_id(F.col("role"), F.col("turn"), clean).alias("id"))


@_query(r"""SELECT doc_id, lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') || '_' || regexp_replace(source || ' ' || lang || '/x.SRT', '[^\p{L}\p{N}._-]', '_', 'g') AS staged,
source || '_c' || lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INT, '0') AS clip_id, regexp_matches(source, '^[\p{L}\p{N}_-]+$') AS safe, true AS is_srt FROM documents""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit(" "), "lang", F.lit("/x.SRT"))
    return _table(spark, sf_dir, "documents").select("doc_id", manifest.staged_name(F.col("doc_id"), name).alias("staged"), manifest.clip_id(F.col("source"), F.col("doc_id")).alias("clip_id"), manifest.is_safe_project(F.col("source")).alias("safe"), manifest.is_srt(name).alias("is_srt"))


# --- text frontend


def _sql_prosody(x: str) -> str:
    for sign, token in text.PROSODY:
        x = f"replace({x}, '{sign}', '{token}')"
    x = f"""regexp_replace({x}, '["''`~@#$%^&*=+\\[\\]{{}}|\\\\/]', ' ', 'g')"""
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@_query(f"SELECT doc_id, {_sql_prosody('text')} AS spoken FROM documents")
def prosody_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.inject_prosody(F.col("text")).alias("spoken"))


_LATIN_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LATIN.items()) + "}"
_UNITS = "|".join([*(k for k in text.LATIN if len(k) > 1), "[a-z]"])


def _sql_transliterate(x: str, dictionary: str | None = None) -> str:
    ruled = f"list_aggregate(list_transform(regexp_extract_all(lower(w), '{_UNITS}'), lambda u: m[u]), 'string_agg', '')"
    known = f"coalesce(d[lower(w)], {ruled})" if dictionary else ruled
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]') THEN {known} ELSE w END), '')"


@_query(f"WITH t AS (SELECT doc_id, text, {_LATIN_MAP} AS m FROM documents) SELECT doc_id, {_sql_transliterate('text')} AS devanagari FROM t")
def transliterate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.transliterate(F.col("text")).alias("devanagari"))


_DICTIONARY = {"the": "द", "and": "एंड", "of": "ऑफ़", "core": "कोर"}


@_query("WITH t AS (SELECT item_id, text, " + _LATIN_MAP + " AS m, MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _DICTIONARY.items()) + "} AS d FROM benchmark) SELECT item_id, " + _sql_transliterate("text", "d") + " AS devanagari FROM t")
def transliterate_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*(F.lit(x) for pair in _DICTIONARY.items() for x in pair))
    return _table(spark, sf_dir, "benchmark").select("item_id", text.transliterate(F.col("text"), known).alias("devanagari"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in text.CARDINALS) + "]"


def _sql_cardinal(n: str) -> str:
    parts = ", ".join(f"CASE WHEN {n} // {size} % 100 > 0 THEN w[{n} // {size} % 100 + 1] || ' {unit}' END" for size, unit in ((10_000_000, text.CRORE), (100_000, text.LAKH), (1000, text.THOUSAND)))
    small = f"CASE WHEN {n} // 100 % 10 > 0 THEN w[{n} // 100 % 10 + 1] || ' {text.HUNDRED}' END, CASE WHEN {n} % 100 > 0 THEN w[{n} % 100 + 1] END"
    return f"CASE WHEN {n} = 0 THEN w[1] ELSE concat_ws(' ', {parts}, {small}) END"


@_query(f"WITH t AS (SELECT o_orderkey AS n, {_WORDS} AS w FROM orders) SELECT n, {_sql_cardinal('n')} AS words FROM t")
def hindi_cardinal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), text.cardinal(F.col("o_orderkey")).alias("words"))


@_query(f"SELECT * FROM (VALUES {fx.values(fx.CARDINALS)}) v(n, words)")
def hindi_cardinal_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, fx.CARDINALS, "n long, expected string").select("n", text.cardinal(F.col("n")).alias("words"))


@_query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS toks, {_WORDS} AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(toks, lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{1,18}}$') THEN
  CASE WHEN x::BIGINT >= 1000000000 THEN ({_sql_cardinal('(x::BIGINT // 1000000000)')}) || ' {text.ARAB}' || CASE WHEN x::BIGINT % 1000000000 > 0 THEN ' ' || ({_sql_cardinal('(x::BIGINT % 1000000000)')}) ELSE '' END
  ELSE {_sql_cardinal('(x::BIGINT)')} END ELSE x END), '') AS spoken FROM t""")
def expand_integers_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.expand_integers(F.col("text")).alias("spoken"))


def _fixture(name: str, rows: list[tuple[str, str]], change: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(spark, rows, "input string, expected string").select("input", change(F.col("input")).alias("output"))

    run.__name__ = name
    _query(f"SELECT * FROM (VALUES {fx.values(rows)}) v(input, output)")(run)


_fixture("expand_numbers_fixture", fx.NUMBERS, text.expand_numbers)
_fixture("schwa_fixture", fx.SCHWA, text.delete_schwa)
_fixture("normalize_fixture", fx.NORMALIZE, text.normalize)
_fixture("prosody_fixture", fx.PROSODY, text.inject_prosody)
_fixture("frontend_full_fixture", fx.FRONTEND, text.frontend)


@_query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '\s+', ' ', 'g')) AS normal FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


# --- subtitles


@_query(f"SELECT * FROM (VALUES {fx.values(fx.CUES)}) v(path, index, start_sec, end_sec, text, error)")
def srt_parse_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.parse(_rows(spark, fx.SUBTITLES, "path string, value string")).select("path", "index", "start_sec", "end_sec", "text", "error")


def _sql_stamp(ms: str) -> str:
    return f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


@_query(f"""WITH c AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text, turn * 5000 AS a, turn * 5000 + 250 * (length(text) % 16) + 500 AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id::VARCHAR AS path, string_agg(n || chr(10) || {_sql_stamp('a')} || ' --> ' || {_sql_stamp('b')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS value FROM c GROUP BY 1""")
def srt_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    start = F.col("turn") * 5.0
    cues = turns.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("ord"), start.alias("start_sec"), (start + 0.25 * (F.length("text") % 16) + 0.5).alias("end_sec"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return srt.format_files(cues)


@_query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_type FROM events),
c AS (SELECT user_id, event_id, t AS s, t + 600 AS e FROM e WHERE event_type = 'purchase'), w AS (SELECT user_id, event_id AS word, t AS ws, t + 60 AS we FROM e WHERE event_type <> 'purchase'),
a AS (SELECT c.event_id, arg_min(ws, (abs(ws - s), word)) AS ns FROM c JOIN w USING (user_id) WHERE ws BETWEEN s - 3600 AND e + 3600 GROUP BY 1),
b AS (SELECT c.event_id, arg_min(we, (abs(we - e), word)) AS ne FROM c JOIN w USING (user_id) WHERE we BETWEEN s - 3600 AND e + 3600 GROUP BY 1),
j AS (SELECT c.user_id, c.event_id, coalesce(ns, s) AS a, coalesce(ne, e) AS b, e - s AS d FROM c LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id))
SELECT user_id AS source_id, event_id AS ord, round(a, 3) AS start_sec, round(CASE WHEN b <= a THEN a + greatest(0.3, d) ELSE b END, 3) AS end_sec FROM j""")
def snap_cues_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1000000.0
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("ord"), at.alias("t"), "event_type")
    cues = e.filter("event_type = 'purchase'").select("source_id", "ord", F.col("t").alias("start_sec"), (F.col("t") + 600).alias("end_sec"))
    words = e.filter("event_type <> 'purchase'").select("source_id", "ord", F.col("t").alias("start"), (F.col("t") + 60).alias("end"))
    return align.snap(cues, words, margin=3600.0).select("source_id", "ord", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


# --- quality

_CLIPS = """clips AS (SELECT d.doc_id AS clip_id, source AS source_id, (n_chars % 2000) / 100.0 AS duration, (n_chars % 700) / 10.0 AS snr_db, (n_chars % 97) / 97.0 AS silence_ratio, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
qc AS (SELECT *, CASE WHEN duration < 1.5 OR duration > 15.0 THEN 'duration' WHEN snr_db < 20.0 THEN 'snr' WHEN silence_ratio > 0.4 THEN 'silence' WHEN quality = 0 THEN 'cer' ELSE 'ok' END AS reason FROM clips)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("n_chars")
    clips = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("clip_id"), F.col("source").alias("source_id"), ((n % 2000) / 100.0).alias("duration"), ((n % 700) / 10.0).alias("snr_db"), ((n % 97) / 97.0).alias("silence_ratio"), F.lit("abcd").alias("reference"), F.when(F.col("quality") == 0, "wxyz").when(F.col("quality") == 1, "abcd").alias("hypothesis"))
    return quality.waterfall(clips, min_snr=20.0, max_silence=0.4, max_cer=0.25)


@_query(f"WITH {_CLIPS} SELECT clip_id, reason = 'ok' AS passed, reason, CASE WHEN reason IN ('ok', 'cer') THEN CASE quality WHEN 1 THEN 0.0 WHEN 0 THEN 1.0 END END AS whisper_cer FROM qc")
def qc_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("clip_id", "passed", F.split_part("reason", F.lit(" "), F.lit(1)).alias("reason"), "whisper_cer")


@_query(f"WITH {_CLIPS} SELECT count(*) AS total, count_if(reason = 'ok') AS passed, count_if(reason = 'duration') AS failed_duration, count_if(reason = 'snr') AS failed_snr, count_if(reason = 'silence') AS failed_silence, count_if(reason = 'cer') AS failed_cer FROM qc")
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(_clips(spark, sf_dir))


@_query("SELECT doc_id, 0.0::DOUBLE AS snr_db, true AS passed, 'qc_skipped' AS reason FROM documents")
def qc_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bypass(_table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "snr_db", "passed", "reason")


@_query("SELECT doc_id, n_chars FROM documents WHERE n_chars / 100.0 BETWEEN 1.0 AND 10.0")
def loader_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") / 100.0).alias("duration"))
    return quality.within_seconds(rows, 1.0, 10.0).select("doc_id", "n_chars")


@_query("SELECT count(*) AS sources, count_if(quality = 1) AS aligned, count_if(toxic = 1) AS qc_passed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return manifest.stage_rollup(rows.select((F.col("quality") == 1).alias("aligned"), (F.col("toxic") == 1).alias("qc_passed")), ["aligned", "qc_passed"])


@_query(f"""WITH {_CLIPS}, t AS (SELECT q.clip_id, q.source_id, q.duration, {_SPLIT.format('q.clip_id')} AS split FROM qc q WHERE reason = 'ok')
SELECT split, count(*) AS n, round(sum(duration) / 3600, 2) AS hours FROM t GROUP BY 1""")
def training_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.build_training_set(_clips(spark, sf_dir), text.frontend(F.col("reference"), prosody=False), F.concat_ws("/", "source_id", "clip_id"))
    return quality.split_summary(rows)


# --- vocabulary and tokenizer


@_query(r"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS token FROM documents")
def vocabulary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.vocabulary(_table(spark, sf_dir, "documents"), "text")


_ALLOWED = [*"abcdefghijklmnopqrstuvwxyz", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ", " ", "\n", ".", ","]
_ALLOWED_SQL = "[" + ", ".join(f"'{c}'" for c in _ALLOWED if c != "\n") + ", chr(10)]"
_MISSING = f"(SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents)"


@_query(f"SELECT token FROM {_MISSING} WHERE token <> '' AND NOT list_contains({_ALLOWED_SQL}, token)")
def distinct_chars_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.missing_characters(_table(spark, sf_dir, "documents"), _ALLOWED)


@_query(f"""WITH m AS (SELECT token FROM {_MISSING} WHERE token <> '' AND NOT list_contains({_ALLOWED_SQL}, token)), l AS (SELECT count(*) AS n, list_sort(list(token)) AS a FROM m)
SELECT n, array_to_string(a[1:20], ' ') || CASE WHEN n > 20 THEN ' (+' || (n - 20) || ' more)' ELSE '' END AS report FROM l""")
def missing_chars_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.missing_report(tokens.missing_characters(_table(spark, sf_dir, "documents"), _ALLOWED))


_SEED = tokens.seed_vocabulary()
_SEED_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in _SEED) + "]"
_TOKENS_SQL = r"list_transform(regexp_extract_all(text, '(?s)<[a-z_]+>|\s+|.'), lambda t: CASE WHEN regexp_matches(t, '^\s') THEN '<sp>' ELSE t END)"


@_query(f"""WITH s AS (SELECT unnest({_SEED_SQL}) AS token, unnest(range({len(_SEED)})) AS id), c AS (SELECT DISTINCT unnest({_TOKENS_SQL}) AS token FROM conversations)
SELECT id, token FROM s UNION ALL SELECT {len(_SEED) - 1} + row_number() OVER (ORDER BY token) AS id, token FROM c WHERE token NOT IN (SELECT token FROM s)""")
def tokenizer_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.fit(_table(spark, sf_dir, "conversations"))


@_query(f"""WITH m AS (SELECT conv_id, turn, {_TOKENS_SQL} AS toks, {_SEED_SQL} AS v FROM conversations)
SELECT conv_id, turn, array_to_string(list_concat([1], list_transform(toks, lambda t: coalesce(list_position(v, t) - 1, 3)), [2]), ' ') AS ids FROM m""")
def tokenizer_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encode(F.col("text"), tokens.literal_map(_SEED), bos=True, eos=True)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@_query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^ !?,.\-:;''\"0-9]', '<unk>', 'g') AS text FROM conversations".replace('\\"', '"'))
def tokenizer_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encode(F.col("text"), tokens.literal_map(_SEED), bos=True, eos=True)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.decode(ids, tokens.literal_array(_SEED)).alias("text"))


@_query("""WITH r AS (SELECT vec_id, vec_id // 8 AS batch, list_transform(embedding[1:1 + (vec_id % 7)::INT], lambda x: floor(x * 100)::INT) AS ids FROM embeddings), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM r)
SELECT vec_id, batch::BIGINT AS batch, len(ids)::INT AS n_ids, array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda i: 0)), ' ') AS ids FROM m""")
def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.slice("embedding", F.lit(1), (F.col("vec_id") % 7 + 1).cast("int")), lambda x: F.floor(x * 100).cast("int"))
    rows = quality.batches(_table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids")), 8, "vec_id", "ids", 0)
    return rows.select("vec_id", "batch", "n_ids", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# --- error rates and reports

_ASCII = "regexp_replace(lower({0}), '[^a-z \n]', '', 'g')"
_PAIRS = f"p AS (SELECT b.item_id, {_ASCII.format('b.text')} AS r, {_ASCII.format('d.text')} AS h FROM benchmark b JOIN (SELECT doc_id, text FROM documents WHERE n_chars < 600) d ON d.doc_id % 40 = b.item_id % 40 WHERE d.doc_id < 400)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def plain(c: str) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z \n]", "")

    docs = _table(spark, sf_dir, "documents").filter("n_chars < 600 AND doc_id < 400").select("doc_id", F.col("text").alias("h"), (F.col("doc_id") % 40).alias("k"))
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("r"), (F.col("item_id") % 40).alias("k"))
    return items.join(docs, "k").select("item_id", "doc_id", plain("r").alias("r"), plain("h").alias("h"))


_STRIPPED = "replace(replace({0}, ' ', ''), chr(10), '')"


@_query(f"WITH {_PAIRS.replace('b.item_id,', 'b.item_id, d.doc_id,')} SELECT item_id, doc_id, round(levenshtein({_STRIPPED.format('r')}, {_STRIPPED.format('h')}) / length({_STRIPPED.format('r')})::DOUBLE, 9) AS cer FROM p")
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("item_id", "doc_id", F.round(similarity.cer(F.col("r"), F.col("h")), 9).alias("cer"))


_WORD_LIST = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


@_query(f"""WITH {_PAIRS.replace('b.item_id,', 'b.item_id, d.doc_id,')}, w AS (SELECT item_id, doc_id, {_WORD_LIST.format('r')} AS a, {_WORD_LIST.format('h')} AS b FROM p),
k AS (SELECT item_id, doc_id, a, b, list_distinct(list_concat(a, b)) AS v FROM w WHERE len(list_distinct(list_concat(a, b))) <= 94)
SELECT item_id, doc_id, round(levenshtein(array_to_string(list_transform(a, lambda x: chr((32 + list_position(v, x))::INT)), ''), array_to_string(list_transform(b, lambda x: chr((32 + list_position(v, x))::INT)), '')) / len(a)::DOUBLE, 9) AS wer FROM k""")
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", "r", "h"), r"\s+"), lambda w: w != ""))
    # The SQL side compares bytes and has 94 of them.
    return rows.filter(F.size(words) <= 94).select("item_id", "doc_id", F.round(similarity.wer(F.col("r"), F.col("h")), 9).alias("wer"))


def _all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one benchmark item, dealt in turn; both texts whole."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("r"))
    n = max(1, items.count())
    items = items.withColumn("k", F.row_number().over(Window.orderBy("item_id", "r")) - 1)  # the benchmark is small
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("h"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(n)).alias("k"))
    return similarity.spread(docs).join(F.broadcast(items), "k").select("item_id", "doc_id", "r", "h")


# DuckDB's distance is one of bytes, so the letters that the tables have beside ASCII become capitals, which lower-case texts don't have.
_LETTERS = "äçèéêíñóöüß"
_DEALT = "k AS (SELECT item_id, text AS r, row_number() OVER (ORDER BY item_id, text) - 1 AS k, count(*) OVER () AS n FROM benchmark), p AS (SELECT item_id, doc_id, r, coalesce(text, '') AS h FROM documents JOIN k ON ((coalesce(doc_id, 0) % n) + n) % n = k)"
_CODED = f"translate(replace(replace(lower({{0}}), ' ', ''), chr(10), ''), '{_LETTERS}', 'ABCDEFGHIJK')"


@_query(f"WITH {_DEALT}, b AS (SELECT item_id, doc_id, {_CODED.format('r')} AS r, {_CODED.format('h')} AS h FROM p) SELECT item_id, doc_id, round(levenshtein(r, h) / length(r)::DOUBLE, 9) AS cer FROM b")
def cer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pairs(spark, sf_dir).select("item_id", "doc_id", F.round(similarity.cer(F.col("r"), F.col("h"), cased=False), 9).alias("cer"))


# A row of distances over all words of a document, for each word of its item in turn: what comes from the left is a running minimum. y: the places (bits) at which the item has the word.
@_query(f"""WITH RECURSIVE {_DEALT}, w AS (SELECT row_number() OVER () AS p, item_id, doc_id, {_WORD_LIST.format('r')} AS a, {_WORD_LIST.format('h')} AS b FROM p),
u AS (SELECT p, a, b[j] AS y, j FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM w)),
e AS (SELECT p, 0::BIGINT AS j, len(a)::INT AS m, 0::HUGEINT AS y FROM w UNION ALL SELECT p, j, len(a), coalesce(list_sum(list_transform(range(len(a)), lambda i: CASE WHEN a[i + 1] = y THEN 1::HUGEINT << i::INT ELSE 0 END)), 0)::HUGEINT FROM u),
f AS (SELECT p, 0 AS i, j, m, y, j AS d FROM e UNION ALL
SELECT p, i + 1, j, m, y, (j + min(t - j) OVER (PARTITION BY p ORDER BY j ROWS UNBOUNDED PRECEDING))::BIGINT FROM
(SELECT *, least(d + 1, coalesce(lag(d) OVER (PARTITION BY p ORDER BY j) + CASE WHEN (y >> i) % 2 = 1 THEN 0 ELSE 1 END, d + 1)) AS t FROM f WHERE i < m) g),
l AS (SELECT p, arg_max(d, j) AS d, max(m) AS m FROM f WHERE i = m GROUP BY p)
SELECT item_id, doc_id, round(d / m::DOUBLE, 9) AS wer FROM l JOIN w USING (p)""")
def wer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.word_error_rates(_all_pairs(spark, sf_dir), "r", "h").select("item_id", "doc_id", F.round("wer", 9).alias("wer"))


@_query("""SELECT role AS category, count(*) AS n, round(avg(CASE WHEN turn % 3 > 0 THEN length(text) / 100.0 END), 6) AS cer_mean, round(avg(CASE WHEN turn % 2 = 0 THEN turn::DOUBLE END), 6) AS wer_mean
FROM conversations GROUP BY ROLLUP (role)""")
def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("role").alias("category"), F.when(F.col("turn") % 3 > 0, F.length("text") / 100.0).alias("cer"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("double")).alias("wer"))
    return evaluate.report(rows, "category", ["cer", "wer"]).select("category", "n", F.round("cer_mean", 6).alias("cer_mean"), F.round("wer_mean", 6).alias("wer_mean"))


@_query("SELECT c.ord::INT AS ord, c.category, count(v.role) AS n FROM (VALUES (0, 'user'), (1, 'assistant'), (2, 'system'), (3, 'tool')) c(ord, category) LEFT JOIN conversations v ON v.role = c.category GROUP BY 1, 2")
def count_by_category_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("role").alias("category"))
    return evaluate.count_by_category(rows, ["user", "assistant", "system", "tool"])


@_query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt, event_type = 'purchase' AS passed FROM events), r AS (SELECT * FROM a WHERE attempt <= 2)
SELECT user_id, coalesce(min(CASE WHEN passed THEN attempt END), max(attempt))::INT AS attempt, bool_or(passed) AS passed, coalesce(min(CASE WHEN passed THEN attempt END), count(*)) AS retries FROM r GROUP BY 1""")
def roundtrip_select_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = _table(spark, sf_dir, "events").select("user_id", place.alias("attempt"), (F.col("event_type") == "purchase").alias("passed"))
    return evaluate.select_attempt(rows, "user_id")


# --- timelines


@_query("SELECT conv_id AS file, turn AS ord, length(text) * 10 AS gen_samples, coalesce(sum(length(text) * 10 + 40) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_sample FROM conversations")
def timeline_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), (F.length("text") * 10).cast("long").alias("gen_samples"))
    return timeline.natural(cues, rate=400, gap_ms=100)


@_query("""WITH RECURSIVE c AS (SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn AS ord, turn * 2.0::DOUBLE AS s, turn * 2.0::DOUBLE + 2 AS e, length(text) * 4 AS g FROM conversations),
f AS (
  SELECT file, 0::BIGINT AS k, 0::BIGINT AS ord, 0::BIGINT AS first, 0::BIGINT AS n, '' AS mode, 0.0::DOUBLE AS cursor FROM c WHERE k = 1
  UNION ALL
  SELECT c.file, c.k, c.ord, trunc(st * 400)::BIGINT,
    CASE WHEN ratio > 1.3 THEN g WHEN ratio > 1.001 THEN floor(g / least(2.0, greatest(0.5, ratio)))::BIGINT ELSE g + greatest(0, trunc((allot - g / 400.0::DOUBLE) * 400)::BIGINT) END,
    CASE WHEN ratio > 1.3 THEN 'whole' WHEN ratio > 1.001 THEN 'stretched' ELSE 'padded' END,
    (trunc(st * 400)::BIGINT + CASE WHEN ratio > 1.3 THEN g WHEN ratio > 1.001 THEN floor(g / least(2.0, greatest(0.5, ratio)))::BIGINT ELSE g + greatest(0, trunc((allot - g / 400.0::DOUBLE) * 400)::BIGINT) END) / 400.0::DOUBLE
  FROM (SELECT c.*, greatest(c.s, f.cursor) AS st, greatest(0.1::DOUBLE, c.e - greatest(c.s, f.cursor)) AS allot, (c.g / 400.0::DOUBLE) / greatest(0.1::DOUBLE, c.e - greatest(c.s, f.cursor)) AS ratio FROM c JOIN f ON c.file = f.file AND c.k = f.k + 1) c
), t AS (SELECT file, greatest(trunc((max(e) + 0.5) * 400)::BIGINT, (SELECT max(first + n) FROM f WHERE f.file = c.file)) AS total FROM c GROUP BY file)
SELECT f.file, f.ord, f.first AS start_sample, f.n AS samples, f.mode, t.total AS total_samples FROM f JOIN t USING (file) WHERE f.k > 0""")
def timeline_fit_to_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 2.0
    cues = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), start.alias("start_sec"), (start + 2).alias("end_sec"), (F.length("text") * 4).cast("long").alias("gen_samples"))
    return timeline.fit_to_cue(cues, rate=400).select("file", "ord", "start_sample", "samples", "mode", "total_samples")


@_query(f"SELECT * FROM (VALUES {fx.values(fx.ATEMPO)}) v(ratio, steps)")
def atempo_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(timeline.atempo_steps(F.col("ratio")), lambda s: F.round(s, 6).cast("string"))
    return _rows(spark, [(float(r), s) for r, s in fx.ATEMPO], "ratio double, expected string").select("ratio", F.array_join(steps, " ").alias("steps"))


# --- waveforms

_RMS = "list_transform(range(len(embedding) // 8), lambda i: sqrt(list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8 + 1e-12))"


@_query(f"WITH r AS (SELECT vec_id, list_sort({_RMS}) AS r FROM embeddings) SELECT vec_id, round(20 * log10(list_avg(r[-greatest(1, len(r) // 10):]) / list_avg(r[1:greatest(1, len(r) // 10)])), 6) AS snr_db FROM r")
def frame_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.snr_db(F.col("embedding"), 8), 6).alias("snr_db"))


@_query(f"WITH r AS (SELECT vec_id, {_RMS} AS r FROM embeddings) SELECT vec_id, round(len(list_filter(r, lambda x: 20 * log10(x + 1e-12) < -20.0)) / len(r)::DOUBLE, 6) AS silence FROM r")
def frame_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.silence_ratio(F.col("embedding"), -20.0, 8), 6).alias("silence"))


@_query(f"""WITH r AS (SELECT vec_id, embedding, list_transform({_RMS}, lambda x: 20 * log10(x + 1e-12) > -18.0) AS v FROM embeddings),
b AS (SELECT vec_id, embedding, v, list_position(v, true) - 1 AS f, len(v) - list_position(list_reverse(v), true) AS l FROM r)
SELECT vec_id, CASE WHEN list_contains(v, true) THEN least(len(embedding), (l + 1) * 8 + 4) - greatest(0, f * 8 - 4) ELSE len(embedding) END::INT AS n,
round(CASE WHEN list_contains(v, true) THEN embedding[greatest(0, f * 8 - 4) + 1] ELSE embedding[1] END, 6) AS head FROM b""")
def frame_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = audio.trim_silence(F.col("embedding"), rate=800, pad_ms=5, threshold_db=-18.0)
    return _table(spark, sf_dir, "embeddings").select("vec_id", kept.alias("k")).select("vec_id", F.size("k").alias("n"), F.round(F.get("k", F.lit(0)), 6).alias("head"))


@_query("SELECT vec_id, len(embedding[(vec_id % 5) * 8 + 1:(vec_id % 5) * 8 + 16])::INT AS n, round(embedding[(vec_id % 5) * 8 + 1], 6) AS head FROM embeddings")
def interval_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = audio.interval(F.col("embedding"), 8, (F.col("vec_id") % 5).cast("double"), F.lit(2.0))
    return _table(spark, sf_dir, "embeddings").select("vec_id", clip.alias("k")).select("vec_id", F.size("k").alias("n"), F.round(F.get("k", F.lit(0)), 6).alias("head"))


# --- listings


@_query("""WITH n AS (SELECT o_orderkey AS step, 'ckpt_step_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.pt' AS name FROM orders WHERE o_orderkey < 300 UNION ALL SELECT 0, 'ckpt_step_00000000.pt')
SELECT DISTINCT step, name, dense_rank() OVER (ORDER BY step DESC) <= 5 OR step = 0 AS kept FROM n""")
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _table(spark, sf_dir, "orders").filter("o_orderkey < 300").select(F.concat(F.lit("ckpt_step_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".pt")).alias("name"))
    others = _rows(spark, [("ckpt_step_00000000.pt",), ("latest.pt",), ("best_model.pth",), ("junk.txt",)], "name string")
    return evaluate.keep_checkpoints(steps.union(others).distinct(), 5)


@_query("""WITH n AS (SELECT o_orderkey AS step, 'ckpt_step_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.pt' AS name FROM orders UNION ALL SELECT 0, 'ckpt_step_00000000.pt')
SELECT DISTINCT step, name, dense_rank() OVER (ORDER BY step DESC) <= 5 OR step = 0 AS kept FROM n""")
def checkpoint_retention_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    steps = _table(spark, sf_dir, "orders").select(F.concat(F.lit("ckpt_step_"), F.lpad(key, 8, "0"), F.lit(".pt")).alias("name"))
    others = _rows(spark, [("ckpt_step_00000000.pt",), ("latest.pt",), ("best_model.pth",), ("junk.txt",)], "name string")
    return evaluate.keep_checkpoints(steps.union(others).distinct(), 5)


@_query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.log_tail(_table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), 200, ["ts", "event_id"]).select("event_id", "event_type")


@_query("WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS ord, count(*) OVER () AS total FROM events) SELECT event_id, ord FROM n WHERE ord % greatest(50, total // 50) = 0 OR ord = total")
def progress_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id")
    ranked = manifest.rank(events, "event_id").withColumn("ord", F.col("ord") + 1)
    return evaluate.progress_rows(ranked, events.count()).select("event_id", "ord")


@_query("SELECT vec_id, greatest(0, floor(length / ratio))::INT AS n FROM (SELECT vec_id, len(embedding) AS length, least(2.0, greatest(0.5, 0.4 + (vec_id % 20) / 10.0)) AS ratio FROM embeddings)")
def stretch_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = 0.4 + (F.col("vec_id") % 20) / 10.0
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(audio.stretch(F.col("embedding"), ratio)).alias("n"))


def queries() -> dict[str, Query]:
    from vanika.plans import media, projects, sinks  # noqa: F401  (they add their own)

    return dict(_QUERIES)


def whole_queries() -> dict[str, Query]:
    """Queries without SQL."""
    return dict(_WHOLE)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
