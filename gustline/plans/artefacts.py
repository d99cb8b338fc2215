"""Queries over what is written and read again: versions, exports, reports, selections, layouts found in a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators import clean
from gustline.plans.frames import SERIES, SPEC, Query, features, hourly, merged, sql, stored_features
from gustline.session import shared_dir
from gustline.sources import tables
from gustline.spec import CALENDAR, Contract, split_columns

KEYS = [*SERIES, "datetime"]
MEASURES = ["pm25", "pm10", "co"]
CHECKED = Contract("drift", ["temperature", "wind_speed", "pm25_lag_1", "hour_sin"])
FEATURE_COLUMNS = [*MEASURES, "n", "temperature", "humidity", *SPEC.columns, *CALENDAR]
CANDIDATES = [c for c in FEATURE_COLUMNS if c not in clean.NOT_PREDICTORS]
SELECTED = 4


def replace_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced by a job that reads it; the version before stays readable."""
    path = f"{shared_dir(spark, 'versions')}/hours"
    tables.write_version(hourly(spark, sf), path)
    current = tables.read_version(spark, path)
    tables.write_version(current.where(F.hour("datetime") < 12).withColumn("pm25", F.col("pm25") * 2), path)
    both = [tables.read_version(spark, path, v).withColumn("version", F.lit(v)) for v in (1, 2)]
    return both[0].unionByName(both[1])


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Hours as an export and read back: numbers keep all digits, an absent value stays absent."""
    path = f"{shared_dir(spark, 'export')}/hours"
    df = hourly(spark, sf).withColumn("pm10", F.when(F.hour("datetime") != 7, F.col("pm10")))
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One report row per series and day, with nested and absent fields, through JSON."""
    path = f"{shared_dir(spark, 'report')}/days"
    days = hourly(spark, sf).groupBy(*SERIES, F.to_date("datetime").alias("day")).agg(
        F.struct(F.max("pm10").alias("high"), F.min("co").alias("low"), F.min(F.when(F.hour("datetime") == 5, F.col("pm25"))).alias("at_five")).alias("pm"),
        F.count(F.lit(1)).alias("hours"))
    tables.write_report(days, path)
    return tables.read_report(spark, path, days.schema).select(*SERIES, "day", "pm.*", "hours")


def optional_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Hours beside a source that is there, one that is missing and one whose files are no tables."""
    base = shared_dir(spark, "optional")
    rows = hourly(spark, sf)
    rows.select(*KEYS, "pm10").where(F.hour("datetime") < 6).write.parquet(f"{base}/there")
    rows.select(F.concat_ws(",", *SERIES, "pm10").alias("value")).write.text(f"{base}/broken")
    out = rows.select(*KEYS, "pm25")
    for name in ("there", "missing", "broken"):
        found = tables.read_or_empty(spark, f"{base}/{name}", rows.select(*KEYS, "pm10").schema)
        out = out.join(found.withColumnRenamed("pm10", name), KEYS, "left")
    return out


def importance_reader(spark: SparkSession, sf: str) -> DataFrame:
    """The first importance table found, whatever its format and the names of its columns."""
    base = shared_dir(spark, "importance")
    rows = hourly(spark, sf).unpivot(KEYS, MEASURES, "feature_name", "value")
    rows.groupBy("feature_name").agg(F.max("value").alias("Mean_Abs_SHAP"), F.count("value").alias("n")).write.option(
        "header", True).csv(f"{base}/shap.csv")
    return tables.read_importance(spark, [f"{base}/shap.parquet", f"{base}/shap.csv", f"{base}/shap.json"])


def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a target and the columns a forecasting model may use, found from names and types."""
    df = features(spark, sf).withColumn("pm25", F.when(F.hour("datetime") != 7, F.col("pm25")))
    rows, names = clean.candidate_features(df.withColumn("note", F.lit("text")))
    return rows.select(*KEYS, *names)


def base_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The base columns of the feature table, told from the derived ones by name."""
    df = features(spark, sf)
    base, _ = split_columns(df.columns)
    return df.select(*base)


def listed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Those of a list of columns that exist."""
    df = merged(spark, sf)
    return df.select(clean.existing_columns(df, [*KEYS, "pm25", "wind_speed", "humidity", "visibility"]))


def checked_features(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of the features a drift run looks at: those of the contract that exist, else all numbers but the target."""
    df = stored_features(spark, sf)
    out = None
    for source, contract in (("contract", CHECKED), ("numbers", None), ("foreign", Contract("x", ["wind_speed"]))):
        names = clean.features_to_check(df, contract)
        rows = df.select([F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "feature", "value")
        found = rows.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        found = found.withColumn("source", F.lit(source))
        out = found if out is None else out.unionByName(found)
    return out


def saved_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the most and the fewest different values, kept per model and loaded again to cut the table."""
    path = shared_dir(spark, "selection")
    df = stored_features(spark, sf)
    _, names = clean.candidate_features(df)
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in names]).first().asDict()        # one number per column
    ranked = sorted(names, key=lambda c: (-counts[c], c))
    tables.save_selection({"varied": ranked[:SELECTED], "plain": ranked[-SELECTED:]}, spark, path)
    out = None
    for model in ("varied", "plain"):
        chosen = tables.load_selection(spark, path, model)
        rows = df.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in chosen]).unpivot(KEYS, chosen, "feature", "value")
        rows = rows.withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days between a series' first and last that a stored table lacks."""
    path = f"{shared_dir(spark, 'days')}/snapshots"
    rows = hourly(spark, sf).withColumn("day", F.to_date("datetime"))
    kept = rows.where(F.pmod(F.dayofyear("day") + F.length("series"), F.lit(5)) != 0)
    tables.by_date(kept, "day").write.partitionBy("day").parquet(path)
    required = rows.groupBy(*SERIES).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return tables.missing_artefacts(spark.read.schema(kept.schema).parquet(path), required, [*SERIES, "day"])


def _ranges(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{c}' AS feature, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low, "
        f"CAST(max({c}) AS DOUBLE) AS high FROM features" for c in names)


_NUMBERS = [c for c in FEATURE_COLUMNS if c != "pm25"]
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS k FROM features" for c in CANDIDATES)
_LONG = " UNION ALL ".join(f"SELECT series, datetime, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM features" for c in CANDIDATES)

QUERIES = [
    Query("replace_table", replace_table, sql("hourly", """
        SELECT *, 1 AS version FROM hourly UNION ALL
        SELECT series, datetime, pm25 * 2 AS pm25, pm10, co, n, 2 AS version FROM hourly WHERE hour(datetime) < 12""")),
    Query("csv_export", csv_export, sql("hourly", """
        SELECT * REPLACE (CASE WHEN hour(datetime) <> 7 THEN pm10 END AS pm10) FROM hourly""")),
    Query("report_round_trip", report_round_trip, sql("hourly", """
        SELECT series, CAST(datetime AS DATE) AS day, max(pm10) AS high, min(co) AS low,
        min(pm25) FILTER (WHERE hour(datetime) = 5) AS at_five, count(*) AS hours FROM hourly GROUP BY 1, 2""")),
    Query("optional_sources", optional_sources, sql("hourly", """
        SELECT series, datetime, pm25, CASE WHEN hour(datetime) < 6 THEN pm10 END AS there,
        CAST(NULL AS DOUBLE) AS missing, CAST(NULL AS DOUBLE) AS broken FROM hourly""")),
    Query("importance_reader", importance_reader, sql("hourly", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, max({c}) AS importance FROM hourly" for c in MEASURES))),
    Query("candidate_rows", candidate_rows, sql("features", f"""
        SELECT series, datetime, {', '.join(CANDIDATES)} FROM features WHERE hour(datetime) <> 7""")),
    Query("base_columns", base_columns, sql("features", """
        SELECT series, datetime, pm25, pm10, co, n, temperature, humidity FROM features""")),
    Query("listed_columns", listed_columns, sql("merged", "SELECT series, datetime, pm25, humidity FROM merged")),
    Query("checked_features", checked_features, sql("features", " UNION ALL ".join([
        _ranges("contract", [c for c in CHECKED.features if c != "wind_speed"]), _ranges("numbers", _NUMBERS), _ranges("foreign", _NUMBERS)]))),
    Query("saved_selection", saved_selection, sql("features", f""",
        c AS ({_COUNTS}), l AS ({_LONG}),
        r AS (SELECT feature, row_number() OVER (ORDER BY k DESC, feature) AS i, count(*) OVER () AS size FROM c)
        SELECT series, datetime, feature, value, CASE WHEN i <= {SELECTED} THEN 'varied' ELSE 'plain' END AS model
        FROM l JOIN r USING (feature) WHERE i <= {SELECTED} OR i > size - {SELECTED}""")),
    Query("missing_days", missing_days, sql("hourly", """,
        d AS (SELECT series, CAST(datetime AS DATE) AS day FROM hourly),
        e AS (SELECT series, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS day
              FROM d GROUP BY series)
        SELECT series, day FROM e
        EXCEPT SELECT series, day FROM d WHERE (dayofyear(day) + length(series)) % 5 <> 0""")),
]
