"""Session set-up and the few helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table may be broadcast; above it the join shuffles instead.
BROADCAST_MAX_BYTES = 32 << 20


def get_spark(app: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; settings given by the cluster are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode,
    which is removed at the end. A cluster without the setting is refused, since its executors share no local folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if given:
        spark.sparkContext.setCheckpointDir(given)
        return given
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="eventloom-checkpoints-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``max_bytes``, else unchanged (the join then shuffles)."""
    size = F.lit(16)
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        wide = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c), "array": _json_length, "struct": _json_length, "map": _json_length}.get(kind)
        size = size + F.lit(16) + (F.coalesce(wide(c), F.lit(0)) if wide else F.lit(0))
    total = df.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df


def _json_length(c: Column) -> Column:
    return F.octet_length(F.to_json(F.struct(c.alias("v"))))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session, once; needed where it is not on their Python path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="eventloom-")  # the driver serves the file from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "eventloom_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
