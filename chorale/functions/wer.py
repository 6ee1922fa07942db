"""Word error rate: word edits against a reference, by Myers' bit-parallel distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalised_words(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split() if text else []


def word_edits(reference: list[str], hypothesis: list[str]) -> int:
    """Least insertions, deletions and substitutions of words; any length, one bit a reference word."""
    m = len(reference)
    if not m:
        return len(hypothesis)
    where: dict[str, int] = {}
    for i, w in enumerate(reference):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for w in hypothesis:
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


@F.pandas_udf(T.StructType([T.StructField("edits", T.LongType()), T.StructField("reference_words", T.LongType())]))
def _errors(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    words = [(normalised_words(r), normalised_words(h)) for r, h in zip(reference, hypothesis)]
    return pd.DataFrame({"edits": np.array([word_edits(r, h) for r, h in words], np.int64), "reference_words": np.array([len(r) for r, _ in words], np.int64)})


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """STRUCT<edits, reference_words>; a NULL text has no words."""
    return _errors(reference, hypothesis)


def error_rate(edits: Column, reference_words: Column) -> Column:
    """Edits a reference word; NULL without reference words. Sum both sides for a corpus."""
    return F.try_divide(edits.cast("double"), reference_words.cast("double"))
