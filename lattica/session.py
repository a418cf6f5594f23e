"""Makes this package importable for Python workers on any executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one if it is unset and Spark is one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors once per application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    # by default a batch for Python has 10,000 rows, however long
    if spark.conf.get(BATCH_BYTES, None) in (None, str(2**31 - 1)):
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lattica-"), "lattica.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lattica", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def checkpointed(df):
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint()


def stored(df):
    """df as a Parquet table in the shared folder, for what is read several times, some columns each."""
    path = f"{work_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
