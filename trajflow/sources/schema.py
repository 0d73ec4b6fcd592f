"""Table layouts. Identifiers are text, places carry plain doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHECKIN_COLUMNS = [
    ("user_id", T.StringType()),
    ("POI_id", T.StringType()),
    ("POI_catid", T.StringType()),
    ("POI_catid_code", T.IntegerType()),
    ("POI_catname", T.StringType()),
    ("POI_category", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("UTC_time", T.StringType()),
    ("local_time", T.StringType()),
    ("day_of_week", T.IntegerType()),
    ("norm_in_day_time", T.DoubleType()),
    ("trajectory_id", T.StringType()),
]
CHECKIN = T.StructType([T.StructField(name, kind) for name, kind in CHECKIN_COLUMNS])
CHECKIN_POSITIONED = T.StructType([T.StructField("row_pos", T.LongType()), *CHECKIN.fields])

NODE = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("checkin_cnt", T.LongType()),
        T.StructField("POI_catid", T.StringType()),
        T.StructField("POI_catid_code", T.IntegerType()),
        T.StructField("POI_catname", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("POI_category", T.StringType()),
    ]
)
PLACE_ATTRIBUTES = [f.name for f in NODE.fields[2:]]

SCORES = T.StructType(
    [
        T.StructField("traj_id", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("item", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

VISIT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("place_name", T.StringType()),
        T.StructField("place_type", T.StringType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("time_of_day", T.DoubleType()),
    ]
)
SAMPLE = T.StructType(
    [
        T.StructField(
            "input",
            T.StructType(
                [
                    T.StructField("user_id", T.StringType()),
                    T.StructField("trajectory_id", T.StringType()),
                    T.StructField("history", T.ArrayType(VISIT)),
                    T.StructField(
                        "context",
                        T.StructType(
                            [
                                T.StructField("day_of_week", T.IntegerType()),
                                T.StructField("time_of_day", T.DoubleType()),
                                T.StructField("date", T.StringType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField(
            "output",
            T.StructType(
                [
                    T.StructField(
                        "next_location",
                        T.StructType(
                            [
                                T.StructField("place_name", T.StringType()),
                                T.StructField("place_type", T.StringType()),
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("valid_place_names", T.ArrayType(T.StringType())),
        T.StructField("valid_place_types", T.ArrayType(T.StringType())),
        T.StructField("total_samples", T.LongType()),
        T.StructField("total_users", T.LongType()),
        T.StructField("total_trajectories", T.LongType()),
    ]
)
TRAINING_LINE = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("completion", T.StringType())]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from input: {', '.join(missing)}")
    return df
