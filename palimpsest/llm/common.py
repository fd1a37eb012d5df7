"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows need no more than this.
BROADCAST_BYTES = 32 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    The tables lie under ``scratch-<application id>``; ``clear_scratch`` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Remove all tables that ``materialise`` has written in this application. For when its results have been written: frames
    that operators have returned before can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def materialise_bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like ``materialise``, in as many buckets of ``key`` as a shuffle has partitions: grouping by it shuffles no row again.

    Spark knows buckets of tables with a name only, so one is in the current database while this runs.
    """
    spark, name = df.sparkSession, f"scratch_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
        found = spark.table(name).select("*")
        found.schema  # resolved before the name goes; the files of a table with a path of its own stay
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return found


def broadcast_if_small(df: DataFrame, row_bytes: int, *texts: str) -> DataFrame:
    """``df``, which must be materialised, hinted for broadcast if its rows fit; else Spark shuffles.

    A counted row takes ``row_bytes`` and the measured length of its columns ``texts``.
    """
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(row_bytes))
    return F.broadcast(df) if (df.agg(F.sum(length.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte plane by byte plane."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def expand(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Memo(dict):
    """A memo of a pure function, bounded by its entries and the length of its keys; beyond, the function is called again."""

    def __init__(self, function, limit: int = 400_000, longest: int = 256):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.limit and len(key) <= self.longest:
            self[key] = value
        return value


def word_hashes() -> Memo:
    """Memo from a word's bytes to its 64-bit hash."""
    return Memo(xxhash.xxh3_64_intdigest)


def hash_words(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
