"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gustline.plans import artefacts, cleaning, features, models, monitoring, streams, summaries
from gustline.plans.frames import Query
from gustline.session import ship_package

ALL: list[Query] = [*artefacts.QUERIES, *cleaning.QUERIES, *features.QUERIES, *summaries.QUERIES, *monitoring.QUERIES,
                    *models.QUERIES, *streams.QUERIES]


def _prepared(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # hours are wall-clock hours; truncation goes through the session time zone
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return query.run(spark, sf_dir)

    run.__name__ = query.name
    run.__doc__ = query.run.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: _prepared(q) for q in ALL}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in ALL if q.sql is not None}
