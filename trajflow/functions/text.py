"""The two functions whose exact result Spark SQL cannot express.

Two-decimal text must round the exact binary value, half to even, and a
prediction must be one strict JSON object. Both run on Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def two_decimals(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else f"{x:.2f}")


@F.pandas_udf(T.ArrayType(T.StringType()))
def two_decimals_each(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: None if xs is None else [f"{x:.2f}" for x in xs])


PREDICTION = T.StructType(
    [
        T.StructField("parsed", T.BooleanType()),
        T.StructField("place_name", T.StringType()),
        T.StructField("place_type", T.StringType()),
    ]
)


def _text_or_none(value):
    return value if isinstance(value, str) else None


def _read_prediction(raw):
    try:
        value = json.loads(raw)
    except (TypeError, ValueError):
        value = None
    if not isinstance(value, dict):
        return False, None, None
    return True, _text_or_none(value.get("place_name")), _text_or_none(value.get("place_type"))


@F.pandas_udf(PREDICTION)
def parse_prediction(raw: pd.Series) -> pd.DataFrame:
    rows = [_read_prediction(each) for each in raw]
    return pd.DataFrame(rows, columns=PREDICTION.names)
