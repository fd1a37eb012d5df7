"""Tiers of documents: the latest states, and archives of a bounded size that are filled one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents of one archive.
ARCHIVE = 2_000_000
#: Rows of a bucket of ids, and of a file of an archive, about.
BUCKET = 1_000_000
#: Documents of small archives that are written together.
TOGETHER = 100_000


def buckets(rows: int, size: int | None = None) -> int:
    """The number of buckets for so many rows, of ``size`` or BUCKET each: a power of two."""
    return 1 << max(-(-rows // (size or BUCKET)) - 1, 0).bit_length()


def index_names(name: str) -> dict[str, str]:
    return {"latest": f"data-{name}-latest", "all": f"data-{name}-*", "archives": f"data-{name}-arc-*", "archive": f"data-{name}-arc-"}


def assign(closed: DataFrame, size: int = ARCHIVE, last: int = 0, held: int = 0, buckets: int = 64) -> DataFrame:
    """``closed`` (id, version, ..) with ``arc``: archives are filled in turn, beginning with what is left in the last one.

    Rows are numbered without one sorted partition: each of ``buckets`` buckets of ids counts its rows, the buckets' sums come
    first. The caller gives as many buckets as keep one within a task's memory.
    """
    spread = closed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # over the few bucket counts alone
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy("bucket").orderBy("id", "version")) + F.col("start")
    rows = spread.join(F.broadcast(starts), "bucket").withColumn("number", number)
    room = max(size - held, 0)
    arc = F.when(F.col("number") <= room, F.lit(last)).otherwise(last + 1 + F.floor((F.col("number") - room - 1) / size))
    return rows.withColumn("arc", arc.cast("int")).drop("bucket", "start", "number")


def arc_counts(manifest: dict) -> dict[int, int]:
    """The archives and their documents, as the manifest has counted them."""
    out: dict[int, int] = {}
    for table in manifest.get("arcs", []):
        for arc, n in table["counts"].items():
            out[int(arc)] = out.get(int(arc), 0) + n
    return dict(sorted(out.items()))


def arc_status(manifest: dict) -> tuple[int, int]:
    """The last archive and its documents; (0, 0) without any."""
    return max(arc_counts(manifest).items(), default=(0, 0))
