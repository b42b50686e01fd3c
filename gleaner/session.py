"""Session helpers.

On a cluster the caller brings its own ``SparkSession``; these helpers only fill
in settings that are still unset, so cluster-level configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job in this package relies on. Applied only where unset.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = 8,
                  app: str = "gleaner", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only when nobody set it
    (local tests) is a fresh scratch folder created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="gleaner-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/gleaner-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows of ``df``, written once as Parquet and read again: a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_find_package(spark: SparkSession) -> None:
    """A local session's Python workers learn where this package is; a cluster's get it by ``--py-files``."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, paths)]))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, from the file index: no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .agg(F.sum("length")).first()[0])
    return int(files or 0)


def sized_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Partition sizing for an input of ``input_bytes`` on ``cores`` task slots.

    * Scan splits: two tasks per core for small inputs, at most 256 MB each
      (100 TB -> ~400k scan tasks).
    * Shuffle: one partition per GB of input, since exchanges carry a few
      projected columns (about a quarter of the input), which lands the largest
      exchange near 256 MB per partition; AQE coalesces smaller exchanges
      to the advisory size (16-256 MB), not to the most tasks.
    * A partition is skewed (and split by AQE) above 4x the median and
      64 MB-1 GB.
    """
    mb = 1 << 20
    split = min(256 * mb, max(1 * mb, input_bytes // (2 * cores)))
    shuffle = max(cores, min(200_000, input_bytes // (1024 * mb)))
    advisory = min(256 * mb, max(16 * mb, split))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(advisory),
        # Coalesce to the advisory size rather than to as many small tasks as
        # possible (Spark's advice for busy clusters; also faster locally).
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes":
            str(min(1024 * mb, max(64 * mb, 4 * advisory))),
    }
