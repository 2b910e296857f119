"""Word-level alignment on Arrow batches: the one matching step that no built-in function expresses."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

KIND = StructType([StructField("distance", IntegerType()), StructField("words", IntegerType())])


def distance(needle: list[str], hay: list[str]) -> int:
    """Least number of words changed, added or dropped to find the whole needle somewhere in hay."""
    row = np.zeros(len(hay) + 1, np.int64)
    steps = np.arange(len(hay) + 1)
    words = np.array(hay, dtype=object)
    for i, w in enumerate(needle, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1) if len(hay) else []
        row = np.minimum.accumulate(new - steps) + steps  # a word of hay more than the needle has
    return int(row.min())


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text)


@F.pandas_udf(KIND)
def _align(needle: pd.Series, hay: pd.Series) -> pd.DataFrame:
    out = []
    for n, h in zip(needle, hay, strict=True):
        if n is None or h is None:
            out.append((None, None))
            continue
        a = _words(n)
        out.append((0 if n in h else distance(a, _words(h)), len(a)))
    return pd.DataFrame(out, columns=["distance", "words"]).astype("Int32")


def align(needle: str, hay: str) -> Column:
    """(distance, words) of needle in hay; a literal hit is 0 at once; null for nulls."""
    return _align(F.col(needle), F.col(hay))
