"""Session helpers shared by all operators: reading tables, cutting lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each application, so that they need no installation."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    path = Path(tempfile.mkdtemp(prefix="vanthu-")) / "vanthu.zip"  # the driver serves it from there
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a directory of parts) of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The folder in ``spark.checkpoint.dir`` is used where the cluster names one. Only a session on one machine (master
    ``local``: tests, a workstation) may go without and gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "vanthu-checkpoints")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; later plans start from there and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    # the plan's estimate of its size stays with a checkpoint; in loops of joins it would be squared in every step
    if out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 62:
        jdf = out._jdf
        out = DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), df.sparkSession)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut``, but compressed and read by column."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ONCE: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, make):
    """What ``make`` gives, made once for each application and key: for indexes that many requests share."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _ONCE:
        _ONCE[full] = make()
    return _ONCE[full]


def remove_scratch(spark: SparkSession) -> None:
    """Deletes the session's checkpoints and tables of ``cut`` and ``stored``; frames that came from them are void then."""
    _ONCE.clear()
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(current.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
