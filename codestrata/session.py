"""Session and table helpers shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast only while its estimated size stays under this bound.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codestrata")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Spark's own file server delivers the archive to every executor, also to those that join later, so
    the package need not be installed there. The driver keeps the archive only to serve it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    at = Path(tempfile.mkdtemp(prefix="codestrata-")) / "codestrata.zip"
    at.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; schema comes from the Parquet footer."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Like :func:`table`, narrowed to the columns asked for so that the scan reads no others."""
    return table(spark, sf_dir, name).select(*columns)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (an upper bound for scans and projections)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the estimated size is within ``limit``; else a shuffled join is used."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is empty on one machine (a ``local`` master, as in tests) a temporary folder is chosen
    and set; a cluster without the setting is an error, as a machine's own folder would lose rows there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        d = current.get() if current.isDefined() else os.path.join(tempfile.gettempdir(), "codestrata-checkpoints")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """For passes that compute much per row: hash the rows over all cores if the scan yields far too few partitions.

    A large table has more partitions than cores and is left as it is, without a shuffle; the case this
    helps is one file with a single row group.
    """
    n = cores(df.sparkSession)
    return df.repartition(n, key) if df.rdd.getNumPartitions() * 2 < n else df
