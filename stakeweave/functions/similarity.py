"""Name similarity by matching blocks, which no built-in function computes."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stakeweave.functions.names import normalize_proxy_name, normalize_ticker_name

MIN_TICKER_SIMILARITY = 0.55
MIN_PROXY_SIMILARITY = 0.45


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ticker_similarity(a: Column, b: Column) -> Column:
    x, y = normalize_ticker_name(a), normalize_ticker_name(b)
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(match_ratio(x, y))


def proxy_similarity(a: Column, b: Column) -> Column:
    """The ratio, at least 0.75 where one name is the other's leading words."""
    x, y = normalize_proxy_name(a), normalize_proxy_name(b)
    leads = (x == y) | y.startswith(F.concat(x, F.lit(" "))) | x.startswith(F.concat(y, F.lit(" ")))
    ratio = match_ratio(x, y)
    return F.when(leads, F.greatest(ratio, F.lit(0.75))).otherwise(ratio)
