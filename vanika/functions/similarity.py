"""Character and word error rates: exact edit distances over whole texts, in batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DataType, DoubleType, LongType

from vanika.functions.distance import codes, edit_distance, word_ids

def compared(text: str, cased: bool = True) -> str:
    """NFC without blanks and line feeds; caseless and trimmed first unless cased."""
    t = text if text.isascii() else unicodedata.normalize("NFC", text)
    return (t if cased else t.lower().strip()).replace(" ", "").replace("\n", "")


def _rate(edits: int, length: int, other: int) -> float:
    """Edits over the reference's length; for an empty reference 1 if there is a hypothesis, else 0."""
    return edits / length if length else float(other > 0)


def _character_rate(reference: str, hypothesis: str, cased: bool) -> float:
    if reference == hypothesis:
        return 0.0
    r, h = codes(compared(reference, cased)), codes(compared(hypothesis, cased))
    return _rate(edit_distance(r, h), len(r), len(h))


def _word_rate(reference: str, hypothesis: str) -> float:
    if reference == hypothesis:
        return 0.0
    r, h = word_ids(reference.split(), hypothesis.split())
    return _rate(edit_distance(r, h), len(r), len(h))


def _pairwise(of: Callable[[str, str], float], kind: DataType = DoubleType()) -> Callable[[Column, Column], Column]:
    dtype = np.int64 if isinstance(kind, LongType) else np.float64

    @pandas_udf(kind)
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=dtype)

    return each


_CASED = _pairwise(lambda r, h: _character_rate(r, h, True))
_CASELESS = _pairwise(lambda r, h: _character_rate(r, h, False))
_WORDS = _pairwise(_word_rate)
_EDITS = _pairwise(lambda a, b: edit_distance(codes(a), codes(b)), LongType())


def edits(a: Column, b: Column) -> Column:
    """The edit distance of two texts by code points; null is empty."""
    return _EDITS(a, b)


def cer(reference: Column, hypothesis: Column, cased: bool = True) -> Column:
    """Character edits over the reference's length (see compared()), which can be over 1. Null is empty; an empty reference gives 1 if there is a hypothesis, else 0."""
    return (_CASED if cased else _CASELESS)(reference, hypothesis)


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edits over the reference's words, whatever their number. Null and empty as for cer()."""
    return _WORDS(reference, hypothesis)


def spread(pairs: DataFrame) -> DataFrame:
    """The rows dealt out evenly: what a row costs follows from its texts, so the rows of one file should not be one task."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rtf(generation_sec: Column, duration_sec: Column) -> Column:
    """Real-time factor, null without a duration."""
    return F.when(duration_sec > 0, generation_sec / duration_sec)
