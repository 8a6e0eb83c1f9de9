"""The closed-vocabulary character tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanika.functions.text import PROSODY_TOKENS, WHITE_SPACE

# Reserved tokens in the order of their ids, and seed punctuation.
RESERVED = ["<pad>", "<bos>", "<eos>", "<unk>", "<sp>"]
PUNCTUATION = list(" !?,.-:;।'\"")
PAD, BOS, EOS, UNK, SPACE = range(5)
DEVANAGARI = [chr(c) for c in range(0x900, 0x980)]
#: Blanks and written-out blanks in a row are one token.
TOKEN = r"(?Us)((?:<sp>|\s)+|<[a-z_]+>|.)"
_TAG = re.compile("<[a-z_]+>")


def seed_vocabulary() -> list[str]:
    """Reserved and prosody tokens, the Devanagari block, digits, punctuation; each once, by id."""
    return list(dict.fromkeys([*RESERVED, *sorted(PROSODY_TOKENS), *DEVANAGARI, *"0123456789", *PUNCTUATION]))


def split_tokens(text: Column) -> Column:
    """Tokens in angle brackets, runs of white space as <sp>, else single characters."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), lambda t: F.when(t.rlike(r"(?U)^(?:<sp>|\s)"), RESERVED[SPACE]).otherwise(t))


def _distinct_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tokens that split_tokens() gives of a task's texts, each once: a tag begins wherever its sign is, so what lies around tags are single characters."""
    tags, signs = set(), set()
    for batch in batches:
        for t in batch["text"]:
            if t:
                found = _TAG.findall(t) if "<" in t else []
                tags.update(found)
                signs.update(_TAG.sub("", t) if found else t)
    yield pd.DataFrame({"token": sorted(tags | {RESERVED[SPACE] if WHITE_SPACE.match(c) else c for c in signs})}, dtype=object)


def fit(texts: DataFrame, vocabulary: list[str] | None = None, column: str = "text") -> DataFrame:
    """id, token: the vocabulary, then the texts' other tokens in code-point order. The order of rows doesn't matter.

    New tokens are distinct characters and tags, so their number is bounded by the alphabet, not by the rows.
    """
    spark = texts.sparkSession
    base = seed_vocabulary() if vocabulary is None else vocabulary
    known = spark.createDataFrame(list(enumerate(base)), "id long, token string")
    found = texts.select(F.col(column).alias("text")).mapInPandas(_distinct_tokens, "token string").distinct().join(F.broadcast(known.select("token")), "token", "left_anti")
    new = found.select((F.row_number().over(Window.orderBy("token")) + len(base) - 1).cast("long").alias("id"), "token")
    return known.unionByName(new)


def encode(text: Column, ids: Column, bos: bool = False, eos: bool = False) -> Column:
    """Ids by the map of tokens, <unk> for others."""
    found = F.transform(split_tokens(text), lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(UNK)))
    first = [F.array(F.lit(BOS))] if bos else []
    last = [F.array(F.lit(EOS))] if eos else []
    return F.concat(*first, found, *last) if first or last else found


def decode(ids: Column, tokens: Column) -> Column:
    """Text of ids by the array of tokens: <pad>, <bos> and <eos> dropped, <sp> a blank, ids out of range <unk>."""
    kept = F.filter(ids, lambda i: ~i.isin(PAD, BOS, EOS))
    named = F.transform(kept, lambda i: F.when(i == SPACE, " ").when((i < 0) | (i >= F.size(tokens)), RESERVED[UNK]).otherwise(F.get(tokens, i)))
    return F.array_join(named, "")


def literal_map(vocabulary: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, vocabulary)), F.array(*(F.lit(i) for i in range(len(vocabulary)))))


def literal_array(vocabulary: list[str]) -> Column:
    return F.array(*map(F.lit, vocabulary))


def missing_characters(texts: DataFrame, allowed: list[str], column: str = "text") -> DataFrame:
    """token: characters of the texts that are neither allowed nor white space."""
    chars = texts.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), "")).alias("token")).filter("token <> ''").distinct()
    known = texts.sparkSession.createDataFrame([(t,) for t in allowed], "token string")
    return chars.join(F.broadcast(known), "token", "left_anti")


def shown(token: Column) -> Column:
    """A character as 'c'(U+XXXX); a quotation mark or a control sign as Python writes it."""
    code = F.ascii(token)
    plain = F.when(token == "'", F.lit('"\'"')).when(token == "\\", F.lit("'\\\\'")).when(code.isin(9, 10, 13), F.concat(F.lit("'"), F.element_at(F.create_map(*map(F.lit, (9, "\\t", 10, "\\n", 13, "\\r"))), code), F.lit("'")))
    return F.concat(F.coalesce(plain, F.concat(F.lit("'"), token, F.lit("'"))), F.format_string("(U+%04X)", code))


def missing_report(missing: DataFrame, first: int = 20, codes: bool = False) -> DataFrame:
    """One row: the number of missing characters, and the first of them in order with how many more there are; with codes as shown()."""
    found = missing.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("token")).alias("all"))
    more = F.when(F.col("n") > first, F.concat(F.lit(" (+"), F.col("n") - first, F.lit(" more)"))).otherwise("")
    return found.select("n", F.concat((F.array_join(F.transform(F.slice("all", 1, first), shown), ", ") if codes else F.array_join(F.slice("all", 1, first), " ")), more).alias("report"))
