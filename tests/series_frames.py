"""Frames of hourly series that several test modules use."""

import pandas as pd


def hours(n, start="2024-01-01"):
    return pd.date_range(start, periods=n, freq="h")


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("datetime", df["datetime"].cast("timestamp_ntz")) if "datetime" in pdf else df
