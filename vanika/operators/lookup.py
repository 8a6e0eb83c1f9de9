"""Dictionaries as tables: a corpus's words met with a pronunciation dictionary of any size, and put back into the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanika.functions.similarity import spread
from vanika.functions.text import transliterated


def dictionary(words: DataFrame) -> DataFrame:
    """word (lower case), spoken of words (word, spoken), one row a word: of several spoken forms the least. A word without letters can't be in a text and is left out, like nulls."""
    rows = words.select(F.lower("word").alias("word"), "spoken").filter(F.col("word").rlike("^[a-z]+$") & F.col("spoken").isNotNull())
    return rows.groupBy("word").agg(F.min("spoken").alias("spoken"))


def add_word(words: DataFrame, word: str, spoken: str) -> DataFrame:
    """words (word, spoken) with one word more, in place of what it had."""
    new = words.sparkSession.createDataFrame([(word.lower(), spoken)], "word string, spoken string")
    return words.filter(F.lower("word") != word.lower()).select("word", "spoken").unionByName(new)


def transliterate_with(rows: DataFrame, key: str, column: str, words: DataFrame) -> DataFrame:
    """rows with column transliterated, each Latin word by the dictionary words (word, spoken) if it is there, else by rule.

    Each row's distinct words meet the dictionary, and what they have in common goes back to the row, as its own words only. So neither the dictionary nor the
    vocabulary is in a plan or in one task unless Spark itself broadcasts a small table, and a word of very many texts is one key that adaptive execution splits.
    Rows are dealt out first, as what a row costs follows from its text. Rows with the same key share their words; a null key is a key. A null text stays null.
    """
    rows = spread(rows)
    latin = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit("([A-Za-z]+)"), F.lit(1))), F.lower))
    own = rows.select(F.col(key).alias("_key"), F.explode(latin).alias("word"))
    found = own.join(dictionary(words), "word").groupBy("_key").agg(F.collect_set(F.struct("word", "spoken")).alias("_own"))
    met = rows.join(found, rows[key].eqNullSafe(found["_key"]), "left")
    return met.withColumn(column, transliterated(F.col(column), F.col("_own.word"), F.col("_own.spoken"))).drop("_key", "_own")
