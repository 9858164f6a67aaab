"""Session helper and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "corpuseval", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, compilable generated code)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # HotSpot does not compile methods above 8000 bytecodes; wide aggregates reach that.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
        # Every column expression would record its Python call site.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path below ``spark.checkpoint.dir``.

    The setting is the cluster's shared folder. Only a local session without it gets a
    temporary folder; on a cluster a missing setting is an error, because executors could
    not see a machine-local path.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/corpuseval-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application, for the operators that run Python.

    An installed package needs no shipping; a checkout on the driver's path does, as Python
    workers do not inherit that path.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    archive = shutil.make_archive(
        os.path.join(folder, "corpuseval"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two passes must see identical rows (the numbering in ``operators.keyed``):
    committed files survive lost executors and cut the lineage, and the second pass reads
    only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
