"""Session helpers: where shared scratch data lives, and reading the fixture tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str | None = None, app: str = "gatewell", **conf: str) -> SparkSession:
    """A session with the settings the library expects; extra settings override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of its own, because there
    driver and executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="gatewell-")
    return _FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/gatewell/{app}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of executors without recomputing, every
    reader sees the same rows, and the optimizer gets true sizes from the files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workspace(spark: SparkSession) -> str:
    """A database located in the shared folder, created once per application."""
    app = "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId)
    name = f"gatewell_{app}".lower()
    location = f"{shared_dir(spark)}/gatewell/{spark.sparkContext.applicationId}/db"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{location}'")
    return name


def fresh_table(spark: SparkSession, label: str) -> str:
    """A table name in the workspace that no earlier call has used."""
    return f"{workspace(spark)}.{label}_{uuid.uuid4().hex[:12]}"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
