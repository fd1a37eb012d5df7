"""Vector codes: every part of a vector is replaced by the number of the nearest entry of that part's integer codebook.

Components are scaled and floored to integers, so distances, sums and codebooks are exact and no order of summation matters.
Each round broadcasts the codebooks, whose size is fixed by the vectors' length; Arrow batches find all distances of a part at
once, as |x|^2 - 2 x.c + |c|^2 in 64-bit integers, and take the first least one. A task sends one row for each component of
each entry, and a shuffle adds them up by entry. The vectors themselves are read again each round and never shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import broadcast_if_small, materialise

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Bytes of codebooks that are broadcast at once; vectors of further lengths follow with theirs.
CODEBOOKS = 16 << 20
#: Sums are sent in digits of so many bits: adding up those of all tasks never overflows.
DIGIT = 40
#: Numbers below fit 64-bit integers; where larger ones could occur, numpy calculates with Python's.
_EXACT = 1 << 62

#: Codebooks by length of vectors: for each part its entries as rows of integers.
Codebooks = dict[int, list[np.ndarray]]


def _sound(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _integers(flat: np.ndarray) -> np.ndarray:
    """floor(4096 * x), exactly: a product by a power of two is exact unless it is too large for a double."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if np.abs(scaled).max(initial=0) < _EXACT:
        return scaled.astype(np.int64)
    return np.array([math.floor(Fraction(x) * SCALE) for x in flat.tolist()], object)


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, parts) for each length of the vectors in a batch; parts are as long as each other, filled up with zeros."""
    column = batch.column("vector")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    flat = _integers(column.flatten().to_numpy(zero_copy_only=False))
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        width = -(-length // PARTS)
        out = np.zeros((len(rows), PARTS * width), flat.dtype)
        out[:, :length] = flat[(ends[rows] - length)[:, None] + np.arange(length)]
        yield length, rows, out.reshape(len(rows), PARTS, width)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each point, and its squared distance, exactly."""
    largest = max((int(np.abs(x).max(initial=0)) for x in (points, entries)), default=0)
    if 4 * points.shape[1] * largest * largest >= _EXACT:
        points, entries = points.astype(object), entries.astype(object)
    found = (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)[None, :]
    at = found.argmin(1)
    return at, found[np.arange(len(at)), at]


def _summed(points: np.ndarray, at: np.ndarray, entries: int) -> np.ndarray:
    if int(np.abs(points).max(initial=0)) * len(points) >= _EXACT:
        points = points.astype(object)
    out = np.zeros((entries, points.shape[1]), points.dtype)
    np.add.at(out, at, points)
    return out.astype(object)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, place = (1 if value >= 0 else -1), abs(value), 0
    while rest:
        yield place, sign * (rest & ((1 << DIGIT) - 1))
        rest >>= DIGIT
        place += 1


def _round(kept: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floored means of the parts nearest to them; an entry without any stays."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for length, _, points in _split(batch):
                for part, entries in enumerate(shared.value[length]):
                    at, _ = nearest(points[:, part], entries)
                    counts, sums = np.bincount(at, minlength=len(entries)), _summed(points[:, part], at, len(entries))
                    before = held.get((length, part), (0, 0))
                    held[length, part] = (before[0] + counts, before[1] + sums)
        for (length, part), (counts, sums) in held.items():
            rows = [(length, part, e, -1, 0, n) for e, n in enumerate(counts.tolist()) if n]
            rows += [(length, part, e, i, *d) for e, line in enumerate(sums.tolist()) for i, x in enumerate(line) for d in _digits(x)]
            types = [pa.int32()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["length", "part", "entry", "at", "place", "value"])

    sent = kept.select("vector").mapInArrow(run, "length int, part int, entry int, at int, place int, value long")
    added = sent.groupBy("length", "part", "entry", "at", "place").agg(F.sum("value").alias("value"))
    out = {length: [x.astype(object) for x in parts] for length, parts in books.items()}
    counts, sums = {}, {}
    for r in added.collect():  # no more than the codebooks' components, and a count for each entry
        key = (r["length"], r["part"], r["entry"])
        if r["at"] < 0:
            counts[key] = r["value"]
        else:
            line = sums.setdefault(key, {})
            line[r["at"]] = line.get(r["at"], 0) + (r["value"] << (DIGIT * r["place"]))
    for (length, part, entry), n in counts.items():
        line = sums.get((length, part, entry), {})
        out[length][part][entry] = [line.get(i, 0) // n for i in range(out[length][part].shape[1])]
    shared.unpersist()
    return {length: [_narrow(x) for x in parts] for length, parts in out.items()}


def _narrow(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if int(np.abs(entries).max(initial=0)) < _EXACT else entries


def _first(kept: DataFrame) -> DataFrame:
    """(length, rank, id, vector) of the rows with the smallest ids of each length; of equal ids, those with the smaller vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, sizes = batch.column("id").to_pylist(), pc.list_value_length(batch.column("vector")).to_pylist()
            order: dict[int, list[tuple]] = {}
            for row, (own, size) in enumerate(zip(ids, sizes)):
                order.setdefault(size, []).append((own is None, own or 0, row))
            for size, found in order.items():
                # ties with the last one that stays are decided by their vectors
                bound = heapq.nsmallest(ENTRIES, found)[-1][:2]
                near = [(*x[:2], batch.column("vector")[x[2]].as_py()) for x in found if x[:2] <= bound]
                held[size] = heapq.nsmallest(ENTRIES, held.get(size, []) + near)
        rows = [(size, None if missing else own, vector) for size, found in held.items() for missing, own, vector in found]
        types = [pa.int32(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["length", "id", "vector"])

    few = kept.select("id", "vector").mapInArrow(run, "length int, id long, vector array<double>")
    few = few.withColumn("salt", F.pmod(F.xxhash64("id", "vector"), F.lit(256)))
    for key in (["length", "salt"], ["length"]):
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("id"), "vector"))).where(F.col("rank") <= ENTRIES)
    return few.select("length", "rank", "id", "vector")


def _started(first: DataFrame, lengths: list[int]) -> Codebooks:
    out: Codebooks = {}
    found = first.where(F.col("length").isin(lengths)).orderBy("length", "rank").select("length", "vector").collect()
    for length in lengths:
        batch = pa.RecordBatch.from_arrays([pa.array([r["vector"] for r in found if r["length"] == length], pa.list_(pa.float64()))], ["vector"])
        (_, _, points), = _split(batch)
        out[length] = [_narrow(points[:, part]) for part in range(PARTS)]
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for part in books for line in part.tolist() for x in line).encode()).hexdigest()


def _assigned(kept: DataFrame, books: Codebooks) -> DataFrame:
    shared = kept.sparkSession.sparkContext.broadcast((books, {length: digest(x) for length, x in books.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = shared.value
        for batch in batches:
            codes, errors, own = ([None] * batch.num_rows for _ in range(3))
            for length, rows, points in _split(batch):
                found = [nearest(points[:, part], entries) for part, entries in enumerate(books[length])]
                code = np.stack([at for at, _ in found], 1).astype(np.uint8).tobytes().hex()
                for k, row in enumerate(rows.tolist()):
                    codes[row], own[row] = code[2 * PARTS * k : 2 * PARTS * (k + 1)], digests[length]
                    total = sum(int(d[k]) for _, d in found)
                    errors[row] = total if total < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(own, pa.string())], ["id", "label", "code", "error", "codebooks_sha256"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every sound row of (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are left out; repeated rows and rows without id stay, and
    count last among the smallest ids. Vectors of each length have codebooks of their own; where 8 does not divide a length
    their parts end in zeros. With fewer than 16 rows there are as many entries. An error, or a sum of errors, beyond a 64-bit
    integer is null. Other columns are not read.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("label")).where(_sound(F.col("vector")))
    first = materialise(_first(kept))
    lengths = sorted(r["length"] for r in first.select("length").distinct().collect())
    parts, held = [[]], 0
    for length in lengths:
        size = 8 * ENTRIES * (length + PARTS)
        if parts[-1] and held + size > CODEBOOKS:
            parts.append([])
            held = 0
        parts[-1].append(length)
        held += size
    found = []
    for some in parts:
        own = kept if len(parts) == 1 else kept.where(F.size("vector").isin(some))
        books = _started(first, some)
        for _ in range(rounds if some else 0):
            books = _round(own, books)
        found.append(_assigned(own, books))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    coded = materialise(every)
    whole = F.when(F.count("*") == F.count("error"), F.try_sum("error"))
    labels = materialise(coded.groupBy(F.col("label").alias("own")).agg(whole.alias("label_error")))
    joined = coded.join(broadcast_if_small(labels, 32, "own") if dict(labels.dtypes)["own"] == "string" else broadcast_if_small(labels, 32), F.col("label").eqNullSafe(F.col("own")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
