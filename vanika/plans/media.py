"""Named queries over sounds, subtitle files, logs, dictionaries and long numbers. catalogue lists them with its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.functions import audio, mel, similarity, text
from vanika.operators import lookup
from vanika.plans import catalogue as base
from vanika.sources import media, store

_query, _table = base._query, base._table


# --- sounds


@_query("SELECT vec_id || '.wav' AS name, 8000 AS rate, array_to_string(list_transform(embedding, lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 32767, 0)))::INT), ' ') AS samples FROM embeddings")
def wav_roundtrip_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a sound file, written and read again."""
    folder = store.scratch(spark, "wav")
    media.write_sounds(_table(spark, sf_dir, "embeddings").select(F.concat("vec_id", F.lit(".wav")).alias("path"), F.lit(8000).alias("rate"), F.col("embedding").alias("samples")), folder)
    samples = F.array_join(F.transform("samples", lambda x: F.round(x.cast("double") * 32768).cast("int").cast("string")), " ")
    return media.read_sounds(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "rate", samples.alias("samples"))


@_query(f"""WITH r AS (SELECT vec_id, embedding, list_transform({base._RMS}, lambda x: 20 * log10(x + 1e-12) > -18.0) AS v FROM embeddings),
b AS (SELECT vec_id, embedding, v, list_position(v, true) - 1 AS f, len(v) - list_position(list_reverse(v), true) AS l FROM r),
t AS (SELECT vec_id, CASE WHEN list_contains(v, true) THEN embedding[greatest(0, f * 8 - 4) + 1:least(len(embedding), (l + 1) * 8 + 4)] ELSE embedding END AS k FROM b)
SELECT vec_id, array_to_string(list_transform(k, lambda x: round(x * 1000)::INT), ' ') AS samples FROM t""")
def trimmed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample that trimming leaves."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", base._thousandths(audio.trim_silence(F.col("embedding"), rate=800, pad_ms=5, threshold_db=-18.0)).alias("samples"))


@_query("""WITH s AS (SELECT vec_id, embedding, len(embedding) AS n, floor(len(embedding) / least(2.0, greatest(0.5, 0.4 + (vec_id % 20) / 10.0)))::INT AS m FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(m), lambda i: round(embedding[CASE WHEN m > 1 THEN floor(i * (n - 1) / (m - 1))::INT ELSE 0 END + 1] * 1000)::INT), ' ') AS samples FROM s""")
def stretched_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of the stretched waveforms."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", base._thousandths(audio.stretch(F.col("embedding"), 0.4 + (F.col("vec_id") % 20) / 10.0)).alias("samples"))


_MEL = mel.Mel(rate=1600, n_fft=16, hop=8, window=16, n_mels=6, low=0.0, high=800.0)


def _sql_mel() -> str:
    """A direct transform: each frame's values by the window, cosines and sines."""
    rows = "[" + ", ".join("[" + ", ".join(map(repr, map(float, f))) + "]" for f in mel.filters(_MEL)) + "]"
    n, half, bins = _MEL.n_fft, _MEL.n_fft // 2, _MEL.n_fft // 2 + 1
    part = "list_sum(list_transform(range({n}), lambda j: s[j + 1] * {f}(2 * pi() * k * j / {n})))"
    return f"""WITH p AS (SELECT vec_id, len(embedding) AS n, list_transform(range(len(embedding) + {n}), lambda i: embedding[(CASE WHEN i < {half} THEN {half} - i WHEN i - {half} >= len(embedding) THEN 2 * len(embedding) - 2 - (i - {half}) ELSE i - {half} END) + 1]::DOUBLE) AS x FROM embeddings),
f AS (SELECT vec_id, x, unnest(range(1 + n // {_MEL.hop})) AS frame FROM p),
w AS (SELECT vec_id, frame, list_transform(range({n}), lambda j: x[frame * {_MEL.hop} + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / {n}))) AS s FROM f),
m AS (SELECT vec_id, frame, list_transform(range({bins}), lambda k: sqrt(pow({part.format(n=n, f='cos')}, 2) + pow({part.format(n=n, f='sin')}, 2))) AS a FROM w)
SELECT vec_id, frame, array_to_string(list_transform({rows}, lambda r: round(ln(greatest(1e-5, list_sum(list_transform(range({bins}), lambda k: r[k + 1] * a[k + 1])))) * 10000)::BIGINT), ' ') AS mel FROM m"""


@_query(_sql_mel())
def log_mel_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mel.log_mel(_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples")), "vec_id", _MEL)
    return found.select("vec_id", "frame", F.array_join(F.transform("mel", lambda x: F.round(x * 10000).cast("long").cast("string")), " ").alias("mel"))


# --- subtitle files and logs


@_query("""SELECT conv_id || '.srt' AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, turn * 5.0::DOUBLE AS start_sec, turn * 5.0::DOUBLE + 0.25 * (length(text) % 16) + 0.5 AS end_sec,
regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS text, NULL::VARCHAR AS error FROM conversations WHERE trim(text, E' \\n\\t') <> ''""")
def srt_roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a subtitle file, written and read again."""
    start, folder = F.col("turn") * 5.0, store.scratch(spark, "srt")
    turns = _table(spark, sf_dir, "conversations").filter(F.trim("text", F.lit(" \n\t")) != "")
    media.write_subtitles(turns.select(F.concat("conv_id", F.lit(".srt")).alias("path"), F.col("turn").alias("ord"), start.alias("start_sec"), (start + 0.25 * (F.length("text") % 16) + 0.5).alias("end_sec"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")), folder)
    return media.read_subtitles(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "index", "start_sec", "end_sec", "text", "error")


@_query("SELECT event_type, count(*) AS n, sum(length(event_id || ' ' || event_type || ' ' || coalesce(props, '')))::BIGINT AS chars, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def followed_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of logs, followed as a stream in two goes: half of the logs are there at first, the others come between."""
    logs, out, done = (store.scratch(spark, f"log-{x}") for x in ("lines", "out", "state"))
    line = F.concat_ws(" ", "event_id", "event_type", F.coalesce("props", F.lit("")))
    for half in range(2):
        _table(spark, sf_dir, "events").filter(F.pmod("event_id", F.lit(2)) == half).select(line.alias("value")).write.mode("append").text(logs)
        query = media.follow(spark, logs, ending=".txt").writeStream.format("parquet").option("path", out).option("checkpointLocation", done).trigger(availableNow=True).start()
        query.awaitTermination()
    lines = spark.read.schema("path string, at long, line string").parquet(out)
    return lines.groupBy(F.split_part("line", F.lit(" "), F.lit(2)).alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.sum(F.split_part("line", F.lit(" "), F.lit(1)).cast("long")).alias("ids"))


# --- words and numbers


@_query("WITH k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), d AS (SELECT map_from_entries(list({'k': word, 'v': '<' || reverse(word) || '>'})) AS d FROM k WHERE word <> ''), "
        "t AS (SELECT doc_id, text, " + base._LATIN_MAP + " AS m, d FROM documents, d) SELECT doc_id, " + base._sql_transliterate("text", "d") + " AS devanagari FROM t")  # fmt: skip
def dictionary_join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by a dictionary that is a table: the benchmark's words."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word")).distinct()
    known = words.select("word", F.concat(F.lit("<"), F.reverse(F.lower("word")), F.lit(">")).alias("spoken"))
    return lookup.transliterate_with(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", known).select("doc_id", F.col("text").alias("devanagari"))


_GROUP = "(substr(p, 9 * i::INT + 1, 9)::BIGINT)"
_LONG = f"""WITH t AS (SELECT o_orderkey AS n, ltrim(repeat(o_orderkey::VARCHAR || o_custkey::VARCHAR, 9), '0') AS x, {base._WORDS} AS w FROM orders), l AS (SELECT n, w, x, lpad(x, 9 * ceil(length(x) / 9.0)::INT, '0') AS p FROM t),
g AS (SELECT n, list_transform(range(length(p) // 9), lambda i: CASE WHEN {_GROUP} = 0 THEN '' ELSE {base._sql_cardinal(_GROUP)} END) AS g FROM l)
SELECT n, list_reduce(g, lambda a, b: CASE WHEN a = '' THEN b WHEN b = '' THEN a || ' {text.ARAB}' ELSE a || ' {text.ARAB} ' || b END) AS words FROM g"""


@_query(_LONG)
def long_numbers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of up to a hundred digits and more: each order's keys, nine times over."""
    digits = F.repeat(F.concat(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), 9)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), text.spell_digits(digits).alias("words"))


def _sql_said(n: str) -> str:
    return base._sql_cardinal(f"({n})")


_MONTHS = "[" + ", ".join(f"'{m}'" for m in text.MONTHS) + "]"


@_query(f"""WITH t AS (SELECT o_orderkey, o_orderdate AS d, floor(o_totalprice)::BIGINT AS r, o_orderkey % 100 AS q, {base._WORDS} AS w, {_MONTHS} AS months FROM orders)
SELECT o_orderkey, w[day(d) + 1] || ' ' || months[month(d)] || ' ' || {_sql_said('year(d)')} || ' ' || CASE WHEN o_orderkey % 60 = 0 THEN w[o_orderkey % 24 + 1] || ' {text.HOURS}' ELSE w[o_orderkey % 24 + 1] || ' {text.PAST} ' || w[o_orderkey % 60 + 1] || ' {text.MINUTES}' END
|| ' ' || {_sql_said('r')} || ' {text.RUPEES} ' || {_sql_said('q')} || ' {text.PERCENT} ' || {_sql_said('q')} || ' {text.POINT} ' || w[o_orderkey % 10 + 1] AS spoken FROM t""")
def spoken_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date, a time, its price, a percentage and a decimal as one text, in words."""
    def digits(n: Column, width: int) -> Column:
        return F.lpad(n.cast("string"), width, "0")

    key, part = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(100)).cast("string")
    said = F.concat_ws(" ", F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(digits(key % 24, 2), F.lit(":"), digits(key % 60, 2)), F.concat(F.lit("₹"), F.floor("o_totalprice").cast("string")), F.concat(part, F.lit("%")), F.concat(part, F.lit("."), (key % 10).cast("string")))
    return similarity.spread(_table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))).select("o_orderkey", text.expand_numbers(F.col("said")).alias("spoken"))


@_query("WITH t AS (SELECT item_id, text, " + base._LATIN_MAP + " AS m FROM benchmark), d AS (SELECT item_id, " + base._sql_transliterate("text") + f" AS said FROM t) SELECT item_id, regexp_replace(said, '{text.SCHWA_PATTERN}', '\\1{text.HALANT}\\2\\3', 'g') AS spoken FROM d")
def schwa_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", text.delete_schwa(text.transliterate(F.col("text"))).alias("spoken"))
