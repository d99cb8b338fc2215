"""Queries over labels, overview tables, distributions and importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions import bands
from gustline.operators import summary
from gustline.operators.summary import WEEKDAYS
from gustline.plans.frames import MODEL_FEATURES, SERIES, Query, add_cte, dirty, features, hourly, sql, table

KEYS = [*SERIES, "datetime"]


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def overview_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.overview(hourly(spark, sf), SERIES), "mean_pm25", "mean_pm10")


def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.data_quality(dirty(spark, sf)), "missing_pct")


def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return summary.category_distribution(hourly(spark, sf), by=SERIES)


def weekday_mean(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.weekday_mean(hourly(spark, sf), by=SERIES), "mean_value")


def diurnal_boxplot(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.diurnal_boxplot(hourly(spark, sf)), "q1", "median", "q3")


def diurnal_boxplot_series(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.diurnal_boxplot(hourly(spark, sf), by=SERIES), "q1", "median", "q3")


def daily_outlook(spark: SparkSession, sf: str) -> DataFrame:
    return summary.daily_outlook(hourly(spark, sf), by=SERIES).withColumn("mean_value", F.round("mean_value", 8))


def abs_corr_top12(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.top_correlations(features(spark, sf), cols=[*MODEL_FEATURES, "n"]), "abs_corr")


def histogram40(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.histogram(hourly(spark, sf), "pm25"), "bin_start", "bin_end")


def histogram40_series(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.histogram(hourly(spark, sf), "pm25", by=SERIES), "bin_start", "bin_end")


def dominant_category(spark: SparkSession, sf: str) -> DataFrame:
    return summary.dominant_category(hourly(spark, sf), by=SERIES)


def family_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.family_counts(features(spark, sf), MODEL_FEATURES)


def pm25_category(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 10 != 0, F.col("value") - 1))
    return ev.select("event_id", bands.pm25_category("v").alias("label"),
                     bands.pm25_category("v", part=3).alias("emoji"), bands.pm25_category("v", part=4).alias("color"))


def us_aqi_category(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 10 != 0, F.round(F.col("value") * 2, 1)))
    return ev.select("event_id", bands.us_aqi_category("v").alias("label"), bands.us_aqi_category("v", part=3).alias("color"))


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The labels once more, through the SQL functions."""
    bands.register_sql(spark)
    ev = table(spark, sf, "events").selectExpr(
        "event_id", "pm25_category(value) AS label", "us_aqi_category(floor(value)) AS us_label",
        "feature_family(concat(event_type, '_lag_1')) AS family", "gap_verdict(value / 1000) AS verdict")
    return ev


def status_normalise(spark: SparkSession, sf: str) -> DataFrame:
    text = (F.when(F.col("event_type") == "error", "🔴 Drift").when(F.col("event_type") == "click", "🟡 warning")
            .when(F.col("event_type") == "view", "all normal").when(F.col("event_type") == "purchase", "odd"))
    ev = table(spark, sf, "events").withColumn("t", text)
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max(bands.normalize_status("t")).alias("status"),
        F.max(bands.normalize_status("t", "UNKNOWN")).alias("shown"))


def feature_family(spark: SparkSession, sf: str) -> DataFrame:
    """Family and filled values of every feature column."""
    filled = features(spark, sf).agg(*[F.count(c).alias(c) for c in MODEL_FEATURES])
    return filled.unpivot([], MODEL_FEATURES, "feature", "filled") \
        .withColumn("family", bands.feature_family("feature"))


def gap_verdict(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("gap", F.round(F.col("value") / 1000, 5))
    return ev.select("event_id", "gap", bands.gap_verdict("gap").alias("verdict"))


def _importance(spark: SparkSession, sf: str) -> DataFrame:
    imp = summary.abs_correlations(features(spark, sf), cols=MODEL_FEATURES, by=SERIES)
    return imp.withColumn("importance", F.round("abs_corr", 9)).where(F.col("importance").isNotNull()).drop("abs_corr")


def cumulative_importance(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.importance_share(_importance(spark, sf), SERIES), "pct", "cumulative", "importance")


def topk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.topk_coverage(summary.importance_share(_importance(spark, sf), SERIES), 5, SERIES), "coverage_pct")


def family_share(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summary.family_share(summary.importance_share(_importance(spark, sf), SERIES), SERIES), "share")


# -- SQL ------------------------------------------------------------------------------------
def band_case(v: str, part: int = 2) -> str:
    body = " ".join(f"WHEN {v} >= {b[0]} AND {v} < {b[1]} THEN '{b[part]}'" for b in bands.PM25_BANDS)
    none = bands.UNKNOWN[part - 2]
    return f"CASE WHEN {v} IS NULL THEN '{none}' {body} ELSE '{bands.PM25_BANDS[-1][part]}' END"


def us_case(v: str, part: int = 2) -> str:
    body = " ".join(f"WHEN {v} >= {b[0]} AND {v} <= {b[1]} THEN '{b[part]}'" for b in bands.US_AQI_BANDS)
    none = bands.UNKNOWN[0] if part == 2 else bands.UNKNOWN[2]
    return f"CASE WHEN {v} IS NULL THEN '{none}' {body} ELSE '{bands.US_AQI_BANDS[-1][part]}' END"


def family_case(v: str) -> str:
    body = " ".join(f"WHEN regexp_matches(lower({v}), '{p}') THEN '{label}'" for p, label in bands.FAMILY_PATTERNS)
    return f"CASE {body} ELSE '{bands.FAMILY_DEFAULT}' END"


def verdict_case(v: str) -> str:
    body = " ".join(f"WHEN {v} <= {limit} THEN '{label}'" for limit, label in bands.GAP_VERDICTS)
    return f"CASE {body} ELSE '{bands.GAP_DEFAULT}' END"


_BAD_COLS = ["series", "datetime", "pm25", "pm10", "co", "n", "no2", "aod"]
_BOX = """round(quantile_cont(pm25, 0.25), 6) AS q1, round(quantile_cont(pm25, 0.5), 6) AS median,
    round(quantile_cont(pm25, 0.75), 6) AS q3, min(pm25) AS min_value, max(pm25) AS max_value"""
_ORDER = "ORDER BY importance DESC, feature"

add_cte("corrs", ["features"], " UNION ALL ".join(
    f"SELECT series, '{c}' AS feature, round(abs(CASE WHEN isnan(corr({c}, pm25)) THEN NULL ELSE corr({c}, pm25) END), 9)"
    f" AS importance FROM features GROUP BY series" for c in MODEL_FEATURES))
add_cte("shares", ["corrs"], f"""SELECT *, sum(pct) OVER (PARTITION BY series {_ORDER} ROWS UNBOUNDED PRECEDING) AS cumulative
    FROM (SELECT series, feature, importance, importance / sum(importance) OVER (PARTITION BY series) AS pct,
    {family_case('feature')} AS family,
    CAST(row_number() OVER (PARTITION BY series {_ORDER}) AS INTEGER) AS rank FROM corrs WHERE importance IS NOT NULL)""")


def _hist(by: str) -> str:
    part = "PARTITION BY series" if by else ""
    key = "series, " if by else ""
    return sql("hourly", f""",
        s AS (SELECT {key}pm25, min(pm25) OVER ({part}) AS lo, max(pm25) OVER ({part}) AS hi FROM hourly),
        b AS (SELECT {key}lo, (hi - lo) / 40 AS w,
              CAST(least(floor((pm25 - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin FROM s)
        SELECT {key}bin, count(*) AS n, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end
        FROM b GROUP BY {key}bin, lo, w""")


QUERIES = [
    Query("overview_kpis", overview_kpis, sql("hourly", """
        SELECT series, count(*) AS n_rows, min(datetime) AS first_hour, max(datetime) AS last_hour,
        round(avg(pm25), 6) AS mean_pm25, max(pm25) AS max_pm25, min(pm25) AS min_pm25,
        round(avg(pm10), 6) AS mean_pm10 FROM hourly GROUP BY 1""")),
    Query("data_quality", data_quality, sql("dirty", f""",
        m AS (SELECT {' + '.join(f'(count(*) - count({c}))' for c in _BAD_COLS)} AS missing, count(*) AS total FROM dirty)
        SELECT total AS total_rows, total - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows,
        missing AS missing_values, round(missing / (total * {len(_BAD_COLS)}) * 100, 6) AS missing_pct FROM m""")),
    Query("category_distribution", category_distribution, sql("hourly", f"""
        SELECT series, {band_case('pm25')} AS category, count(*) AS n FROM hourly GROUP BY 1, 2""")),
    Query("weekday_mean", weekday_mean, sql("hourly", f""",
        d AS (SELECT unnest({WEEKDAYS}) AS weekday, unnest(range(0, 7)) AS position)
        SELECT s.series, CAST(d.position AS INTEGER) AS position, d.weekday, round(avg(h.pm25), 6) AS mean_value
        FROM (SELECT DISTINCT series FROM hourly) s CROSS JOIN d
        LEFT JOIN hourly h ON h.series = s.series AND isodow(h.datetime) - 1 = d.position GROUP BY 1, 2, 3""")),
    Query("diurnal_boxplot", diurnal_boxplot, sql("hourly", f"""
        SELECT CAST(hour(datetime) AS INTEGER) AS hour, {_BOX} FROM hourly GROUP BY 1""")),
    Query("diurnal_boxplot_series", diurnal_boxplot_series, sql("hourly", f"""
        SELECT series, CAST(hour(datetime) AS INTEGER) AS hour, {_BOX} FROM hourly GROUP BY 1, 2""")),
    Query("daily_outlook", daily_outlook, sql("hourly", f"""
        SELECT series, day, round(m, 8) AS mean_value, min_value, max_value, {band_case('m')} AS category FROM
        (SELECT series, CAST(datetime AS DATE) AS day, avg(pm25) AS m, min(pm25) AS min_value, max(pm25) AS max_value
         FROM hourly GROUP BY 1, 2)""")),
    Query("abs_corr_top12", abs_corr_top12, sql("features", f""",
        c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(corr({c}, pm25)) AS v FROM features"
                                  for c in [*MODEL_FEATURES, 'n'])})
        SELECT feature, round(v, 6) AS abs_corr FROM c ORDER BY v DESC, feature LIMIT 12""")),
    Query("histogram40", histogram40, _hist("")),
    Query("histogram40_series", histogram40_series, _hist("series")),
    Query("dominant_category", dominant_category, sql("hourly", f""",
        c AS (SELECT series, {band_case('pm25')} AS dominant, min({" + ".join(f"CAST(pm25 >= {b[0]} AS INTEGER)" for b in bands.PM25_BANDS)}) AS o,
              count(*) AS n FROM hourly GROUP BY 1, 2)
        SELECT series, dominant, n FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, o) = 1""")),
    Query("family_counts", family_counts, sql("features", f""",
        f AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, count({c}) AS n FROM features" for c in MODEL_FEATURES)})
        SELECT {family_case('feature')} AS family, count(*) AS n_features, CAST(sum(n) AS BIGINT) AS n_values
        FROM f GROUP BY 1""")),
    Query("pm25_category", pm25_category, f"""
        SELECT event_id, {band_case('v')} AS label, {band_case('v', 3)} AS emoji, {band_case('v', 4)} AS color
        FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value - 1 END AS v FROM events)"""),
    Query("us_aqi_category", us_aqi_category, f"""
        SELECT event_id, {us_case('v')} AS label, {us_case('v', 3)} AS color
        FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN round(value * 2, 1) END AS v FROM events)"""),
    Query("sql_functions", sql_functions, f"""
        SELECT event_id, {band_case('value')} AS label, {us_case('floor(value)')} AS us_label,
        {family_case("event_type || '_lag_1'")} AS family, {verdict_case('value / 1000')} AS verdict FROM events"""),
    Query("status_normalise", status_normalise, """
        SELECT event_type, count(*) AS n,
        CASE event_type WHEN 'error' THEN 'DRIFT' WHEN 'click' THEN 'WARNING' ELSE 'NORMAL' END AS status,
        CASE event_type WHEN 'error' THEN 'DRIFT' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'NORMAL'
        ELSE 'UNKNOWN' END AS shown FROM events GROUP BY 1"""),
    Query("feature_family", feature_family, sql("features", f""",
        f AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, count({c}) AS filled FROM features" for c in MODEL_FEATURES)})
        SELECT feature, filled, {family_case('feature')} AS family FROM f""")),
    Query("gap_verdict", gap_verdict, f"""
        SELECT event_id, gap, {verdict_case('gap')} AS verdict
        FROM (SELECT event_id, round(value / 1000, 5) AS gap FROM events)"""),
    Query("cumulative_importance", cumulative_importance, sql("shares", """
        SELECT series, feature, round(importance, 6) AS importance, round(pct, 6) AS pct, family, rank,
        round(cumulative, 6) AS cumulative FROM shares""")),
    Query("topk_coverage", topk_coverage, sql("shares", """
        SELECT series, min_by(feature, rank) AS top_driver, count(*) AS k, round(sum(pct) * 100, 6) AS coverage_pct
        FROM shares WHERE rank <= 5 GROUP BY 1""")),
    Query("family_share", family_share, sql("shares", """
        SELECT series, family, round(sum(pct), 6) AS share FROM shares GROUP BY 1, 2""")),
]
