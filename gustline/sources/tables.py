"""Tables on shared storage: scans, versions, upserts, history, exports, freshness."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from datetime import date, datetime
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.operators.blocks import null_safe_join


def _hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def date_range_scan(spark: SparkSession, path: str, first: date | datetime, last: date | datetime,
                    ts: str = "datetime") -> DataFrame:
    """Rows from ``first`` to ``last`` (inclusive); the filter reaches the parquet scan."""
    return spark.read.parquet(path).where(F.col(ts).between(F.lit(first), F.lit(last)))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty frame of that schema where it is missing or any of it unreadable.

    For small optional tables such as reports: it is read once to see whether all of it can be read.
    """
    empty = spark.createDataFrame([], schema)
    if not path_exists(spark, path):
        return empty
    df = spark.read.format(fmt).option("mode", "FAILFAST").schema(schema).load(path)
    try:
        df.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError) as error:
        if not re.search("(?i)malformed|corrupt|not a parquet|footer|FAILED_READ_FILE|cannot be read", str(error)):
            raise
        return empty
    return df


# -- versions -------------------------------------------------------------------------------
def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith("version=") and path_exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(int(n.split("=", 1)[1]) for n in done)


def write_version(df: DataFrame, path: str) -> str:
    """Replace a table by writing its next version beside the current one.

    A job may therefore read the table it replaces; readers see the old version until the new
    one is complete.
    """
    spark = df.sparkSession
    target = f"{path}/version={max(_versions(spark, path), default=0) + 1}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/version={version or versions[-1]}")


# -- upserts --------------------------------------------------------------------------------
def keep_last(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key, the latest by ``order_cols``.

    An aggregation, not a ranking: versions of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))


def upsert_latest(existing: DataFrame, new: DataFrame, keys: Sequence[str],
                  order_cols: Sequence[str]) -> DataFrame:
    """Existing and new rows, the newest per key; columns one side lacks are null."""
    return keep_last(existing.unionByName(new, allowMissingColumns=True), keys, order_cols)


def restore(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
            sort_by: Sequence[str] = ("datetime",)) -> DataFrame:
    """A stored table without repeated keys (the last one stays), sorted."""
    return keep_last(df, keys, order_cols).orderBy(*sort_by)


def by_date(df: DataFrame, part: str, salts: int = 8) -> DataFrame:
    """Few files per date, while a date with very many rows is split over several tasks."""
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", F.col(part))
    # stateful streams run without adaptive execution, which the hint needs
    return df.repartition(F.col(part), F.pmod(F.xxhash64(*df.columns), F.lit(salts)))


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], order_cols: Sequence[str],
                      ts: str = "datetime", part: str = "date") -> None:
    """Upsert into a table kept by date; only the folders of dates in ``new`` are read and written again.

    The new state of these dates is written into folders of its own; then a list of the folders that make up the table is written, and
    one pointer switches to it. A reader sees all dates before the upsert or all after it, also when the job dies between. Rows without a
    time have a folder of their own. One writer at a time; what neither this state nor the one before uses is deleted.
    """
    spark = new.sparkSession
    fresh = new.withColumn(part, F.to_date(ts))
    state = table_folders(spark, path)
    if state:
        days = [f"{_FOLDER}={'__HIVE_DEFAULT_PARTITION__' if d[0] is None else d[0]}"
                for d in fresh.select(F.col(part).cast("string")).distinct().collect()]     # one per date
        touched = [state[d] for d in days if d in state]
        if touched:
            stored = _read_folders(spark, path, touched)
            fresh = upsert_latest(stored, fresh, keys, order_cols)
        else:
            fresh = keep_last(fresh, keys, order_cols)
    else:
        fresh = keep_last(fresh, keys, order_cols)
    commit = f"commit-{uuid.uuid4().hex}"
    by_date(fresh.withColumn(_FOLDER, F.col(part)), _FOLDER).write.partitionBy(_FOLDER).parquet(f"{path}/data/{commit}")
    fs, folder = _hadoop_path(spark, f"{path}/data/{commit}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    state = state | {n: f"data/{commit}/{n}" for n in names if n.startswith(f"{_FOLDER}=")}
    if not state:       # an empty table has its columns
        state = {"": f"data/{commit}"}
    rows = spark.createDataFrame(list(state.items()), "name string, folder string")
    rows.coalesce(1).write.parquet(f"{path}/states/{commit}")      # one row per date
    before = current_version(spark, path)
    switch_pointer(spark, path, commit)
    _clean_up(spark, path, {commit, before})


_FOLDER = "_date"


def table_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The folders that make up a table written by ``upsert_partitions``, by the name of their date; empty if there is no table."""
    state = current_version(spark, path)
    if state is None:
        return {}
    rows = spark.read.parquet(f"{path}/states/{state}").collect()       # one row per date
    return {r["name"]: r["folder"] for r in rows}


def _read_folders(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/{f}" for f in folders])


def read_upserted(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """A table written by ``upsert_partitions``, on request only the dates from ``first`` to ``last`` (their folders alone are listed)."""
    state = table_folders(spark, path)
    if not state:
        raise FileNotFoundError(path)
    names = [n for n in state if (first is None or n >= f"{_FOLDER}={first}") and (last is None or n <= f"{_FOLDER}={last}")]
    if first is not None or last is not None:
        names = [n for n in names if not n.endswith("__HIVE_DEFAULT_PARTITION__")]
    if not names:
        return _read_folders(spark, path, list(state.values())[:1]).where("false")
    return _read_folders(spark, path, [state[n] for n in names])


def _clean_up(spark: SparkSession, path: str, keep: set[str | None]) -> None:
    """Delete states but those of ``keep``, and folders that these do not use."""
    fs, states = _hadoop_path(spark, f"{path}/states")
    used = set()
    for status in fs.listStatus(states):
        name = status.getPath().getName()
        if name in keep:
            used |= {r["folder"] for r in spark.read.parquet(f"{path}/states/{name}").collect()}
        else:
            fs.delete(status.getPath(), True)
    commits = {f.split("/")[1] for f in used}
    fs, data = _hadoop_path(spark, f"{path}/data")
    for status in fs.listStatus(data):
        commit = status.getPath().getName()
        if commit not in commits:
            fs.delete(status.getPath(), True)
            continue
        for inner in fs.listStatus(status.getPath()):
            name = inner.getPath().getName()
            if name.startswith(f"{_FOLDER}=") and f"data/{commit}/{name}" not in used:
                fs.delete(inner.getPath(), True)


# -- pointers -------------------------------------------------------------------------------
POINTER = "CURRENT"


def switch_pointer(spark: SparkSession, root: str, version: str) -> None:
    """Name ``version`` as the current one: the text is written beside the pointer and renamed over it."""
    fs, fresh = _hadoop_path(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    files = jvm.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(fresh), fs.makeQualified(jvm.Path(f"{root}/{POINTER}")), options)


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, path = _hadoop_path(spark, f"{root}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def append_history(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def save_snapshot(df: DataFrame, path: str, ts: str = "datetime") -> None:
    """Append-only snapshots, one folder per ingest date."""
    dated = df.withColumn("ingest_date", F.to_date(ts))
    by_date(dated, "ingest_date").write.mode("append").partitionBy("ingest_date").parquet(path)


# -- exports and reports --------------------------------------------------------------------
def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON reports: files of one object per line, and files that hold one document over several lines.

    A line that is no JSON of its own tells the second kind. Without a schema the columns are inferred.
    """
    broken = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    files = (spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.bool_or(broken).alias("document")).collect())       # one row per file
    lines, documents = [[unquote(f["file"]) for f in files if f["document"] is kind] for kind in (False, True)]

    def read(**how) -> DataFrame:
        return (spark.read.schema(schema) if schema is not None else spark.read).json(**how)

    if not documents:
        return read(path=path)
    whole = read(path=documents, multiLine=True)
    return whole.unionByName(read(path=lines), allowMissingColumns=True) if lines else whole


# Names an importance table may use for its two columns.
FEATURE_NAMES = ["feature", "feature_name"]
IMPORTANCE_NAMES = ["importance", "mean_abs_shap", "shap"]


def canonical_importance(df: DataFrame) -> DataFrame | None:
    lower = {c.lower(): c for c in df.columns}
    feature = next((lower[n] for n in FEATURE_NAMES if n in lower), None)
    value = next((lower[n] for n in IMPORTANCE_NAMES if n in lower), None)
    if feature is None or value is None:
        return None
    return df.select(F.col(feature).alias("feature"), F.col(value).cast("double").alias("importance"))


def read_importance(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """The first importance table found, parquet, CSV or JSON by its suffix."""
    for path in paths:
        if not path_exists(spark, path):
            continue
        suffix = path.rsplit(".", 1)[-1]
        if suffix == "csv":
            table = spark.read.option("header", True).csv(path)
        elif suffix == "json":
            table = read_report(spark, path)
        else:
            table = spark.read.parquet(path)
        found = canonical_importance(table)
        if found is not None:
            return found.orderBy(F.desc("importance"), "feature")
    return None


def freshness(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Newest file time per table; a missing table has a null time."""
    out = None
    for name, path in paths.items():
        if path_exists(spark, path):
            # one row per file, from the listing alone: no file is opened
            files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                     .select("path", "modificationTime"))
            row = files.agg(F.max("modificationTime").alias("last_modified"), F.count("path").alias("n_files"))
        else:
            row = spark.range(1).select(F.lit(None).cast("timestamp").alias("last_modified"),
                                        F.lit(0).cast("bigint").alias("n_files"))
        row = row.select(F.lit(name).alias("artefact"), "last_modified", "n_files")
        out = row if out is None else out.unionByName(row)
    return out


def missing_artefacts(present: DataFrame, required: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required artefacts that are not there."""
    return required.join(present, [*keys], "left_anti")


def save_selection(selected: dict[str, list[str]], spark: SparkSession, path: str) -> None:
    """Selected features per model."""
    rows = [(m, f) for m, f in selected.items()]
    spark.createDataFrame(rows, "model string, features array<string>").write.mode("overwrite").parquet(path)


def load_selection(spark: SparkSession, path: str, model: str) -> list[str]:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    row = spark.read.parquet(path).where(F.col("model") == model).first()
    if row is None:
        raise KeyError(model)
    return list(row["features"])


def contract_frame(spark: SparkSession, contract: dict) -> DataFrame:
    """A contract given as a dictionary, as a one-row table."""
    return spark.createDataFrame([(contract["model_name"], json.dumps(contract, sort_keys=True))],
                                 "model_name string, contract string")


def unseen(fetched: DataFrame, existing: DataFrame, keys: Sequence[str], latest_only: bool = False,
           not_after: datetime | None = None, ts: str = "datetime") -> DataFrame:
    """Fetched rows whose key is not stored yet.

    All of them by default; ``latest_only`` keeps the newest hour of each series,
    ``not_after`` drops hours that lie in the future.
    """
    rows = fetched if not_after is None else fetched.where(F.col(ts) <= F.lit(not_after))
    stored = existing.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    known = F.lit(True)
    for k in keys:
        known = known & rows[k].eqNullSafe(stored[f"_s_{k}"])
    rows = rows.join(stored, known, "left_anti")
    if not latest_only:
        return rows
    series = [k for k in keys if k != ts]
    newest = rows.groupBy(*series).agg(F.max(ts).alias(ts))
    return null_safe_join(rows, newest, [*series, ts])
