"""Fitted models on shared storage: versions with their scoring contract, and a pointer to the current one.

A version is a folder of its own with the contract (one row per series), linear models, ensembles as node tables and pipelines of Spark ML. The
pointer is one small file; it is replaced by a rename when everything is written, so readers see the version before or the whole new one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators.boosting import BoostedModel, from_nodes, node_table
from gustline.operators.trees import forest_ensemble
from gustline.sources.tables import current_version, switch_pointer


@dataclass
class Artefacts:
    """What a contract may name: ``linear`` holds (series, model, features, slopes, bias) rows, the others are by model name."""

    contract: DataFrame
    linear: DataFrame | None = None
    ensembles: dict[str, BoostedModel] = field(default_factory=dict)
    pipelines: dict[str, PipelineModel] = field(default_factory=dict)


def save_models(spark: SparkSession, root: str, artefacts: Artefacts) -> str:
    """Write a new version and make it the current one; returns its folder."""
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{root}/{version}"
    artefacts.contract.write.parquet(f"{folder}/contract")
    if artefacts.linear is not None:
        artefacts.linear.write.parquet(f"{folder}/linear")
    for name, model in artefacts.ensembles.items():
        node_table(spark, model).coalesce(1).write.parquet(f"{folder}/ensembles/{name}")      # bounded by the trees
    for name, pipeline in artefacts.pipelines.items():
        pipeline.write().save(f"{folder}/pipelines/{name}")
    switch_pointer(spark, root, version)
    return folder


def load_models(spark: SparkSession, root: str) -> Artefacts:
    """The current version; what its contract names must be there."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no promoted models below {root}")
    folder = f"{root}/{version}"
    contract = spark.read.parquet(f"{folder}/contract")
    names = [r["model_name"] for r in contract.select("model_name").distinct().collect()]      # a handful of models
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def there(part: str) -> bool:
        return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}"))

    out = Artefacts(contract, spark.read.parquet(f"{folder}/linear") if there("linear") else None)
    stored = set() if out.linear is None else {r["model"] for r in out.linear.select("model").distinct().collect()}
    for name in names:
        if there(f"ensembles/{name}"):
            out.ensembles[name] = from_nodes(spark.read.parquet(f"{folder}/ensembles/{name}"))
        elif there(f"pipelines/{name}"):
            out.pipelines[name] = PipelineModel.load(f"{folder}/pipelines/{name}")
            features = out.pipelines[name].stages[0].getInputCols()
            status = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pipelines/{name}/stages/1_*"))
            out.ensembles[name] = forest_ensemble(spark, status[0].getPath().toString(), features)
        elif name not in stored:
            raise FileNotFoundError(f"the contract names {name}, but {folder} holds no such model")
    return out


def features_of(contract: DataFrame, name: str) -> list[str]:
    """The features a shared model was promoted with."""
    return list(contract.where(F.col("model_name") == name).select("features").first()["features"])
