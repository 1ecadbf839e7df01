"""Session helpers: building a local session for tests/bench, UTC, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Conf every job of the library relies on.  Time-of-day logic compares instants
# with fixed clocks, so the session must render timestamps in UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Conf we recommend for scale; applied by build_session, never forced on a
# caller's session.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # runtime bloom filters shrink the page store side of hit->page joins
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# State of a stream on disk, of which a batch writes only what it changed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "hitweave", extra: dict | None = None) -> SparkSession:
    """Local session for tests and bench.  On a cluster use the cluster's session
    and call :func:`prepare` on it instead."""
    master = master or os.environ.get("HITWEAVE_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("HITWEAVE_DRIVER_MEMORY", "16g")))
    for k, v in {**RECOMMENDED_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the conf the library's semantics depend on (UTC)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


@contextmanager
def conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Conf that holds while something is started; the caller's own values come back."""
    held = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  Where it is unset, a local session (tests) gets a private folder;
    on a cluster, whose machines do not share one, that is an error.  Jobs write their durable
    intermediate tables and streaming state below this root."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="hitweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder name under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/hitweave/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: the lineage ends there,
    scans of it prune columns and take pushed filters, and a lost executor re-reads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables written below this session's scratch folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/hitweave")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
