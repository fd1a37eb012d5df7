"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds its distinct shingles of ``shingle_words`` lower-cased words (A-Z only; words are split at
ASCII white space). A text of fewer words is one shingle; a null or empty one has none and is linked with nothing.
Documents whose sets share at least ``percent`` of their union are linked; a group is what links reach.

Sets hold 64-bit hashes of shingles, so a link is decided on the whole sets, up to a hash collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import GOLDEN, broadcast_if_small, hash_words, materialise, mix, word_hashes

#: 24 bands of 4 registers: a pair at similarity 0.8 meets in no band with a chance of 3e-6.
BANDS, ROWS = 24, 4
#: Members of a bucket that are compared in one task, and shingles of their texts: fewer members if these are long.
BLOCK, WEIGHT = 512, 4_000_000
#: Hashes of whole sets that a verifying task keeps at hand.
HELD = 8_000_000
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingles(text: str | None, k: int, memo) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words, memo)
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * GOLDEN + h[i : len(words) - size + 1 + i])
    return np.unique(out)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def superminhash(items: np.ndarray, registers: int) -> np.ndarray:
    """Signature of a set of 64-bit hashes.

    Each element walks through one random permutation of the registers; its j-th step offers ``j + r`` to the j-th
    register of that permutation. All elements take a step together, and the walk ends as soon as no register can
    still fall, which long sets reach after one or two steps.
    """
    least = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    place = order = None
    for j in range(registers if len(items) else 0):
        z = mix(items + np.uint64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = ((z & _LOW) * np.uint64(registers - j) >> _32).astype(np.int64) + j
        if j == 0:
            target = first = k
        else:
            if order is None:
                place = np.arange(len(items))
                order = np.tile(np.arange(registers, dtype=np.uint16), (len(items), 1))
                order[place, first] = 0
                order[:, 0] = first
            target = order[place, k]
            order[place, k] = order[:, j]
            order[:, j] = target
        np.minimum.at(least, target, (z >> _32) + (np.uint64(j) << _32))
        if int(least.max()) < (j + 1) << 32:
            break
    return least


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * GOLDEN + parts[:, i])
    return key.view(np.int64)


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            sizes, prints, keys, signatures = [], [], [], []
            for text in batch.column(1):
                x = shingles(text.as_py(), k, memo)
                signature = superminhash(x, bands * rows)
                sizes.append(len(x))
                prints.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                keys.append(band_keys(signature, bands, rows) if len(x) else np.empty(0, np.int64))
                signatures.append(mix(signature).astype(np.uint16).tobytes())
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary()), lists], ["doc_id", "mark", "n_shingles", "print", "signature", "bands"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sets, held = word_hashes(), {}, 0

        def of(document: tuple[int, int], text: pa.StringScalar) -> np.ndarray:
            nonlocal held
            if document not in sets:
                found = shingles(text.as_py(), k, memo)
                if held + len(found) > HELD:
                    sets.clear()
                    held = 0
                sets[document] = found
                held += len(found)
            return sets[document]

        for batch in batches:
            keep = []
            for a, mark_a, b, mark_b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "mark_a", "b", "mark_b")), batch.column("text_a"), batch.column("text_b")):
                left, right = of((a, mark_a), text_a), of((b, mark_b), text_b)
                both = common(left, right)
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _partners(table: pa.Table, percent: int, registers: int) -> Iterator[tuple[int, np.ndarray]]:
    """Within one block of a bucket: each probe's members of other groups that signatures and sizes do not rule out.

    The estimate may fall 20 points below the threshold: at 96 registers a pair at similarity 0.8 falls lower with a
    chance of 1e-6.
    """
    least = registers * (percent - 20) // 100
    root, size = (table.column(c).to_numpy() for c in ("root", "size"))
    probe = table.column("probe").to_numpy()
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, registers)
    members = np.flatnonzero(~probe)
    for i in np.flatnonzero(probe):
        j = members[(root[members] != root[i]) & (100 * np.minimum(size[members], size[i]) >= percent * np.maximum(size[members], size[i]))]
        j = j[(signature[j] == signature[i]).sum(axis=1) >= least]
        if len(j):
            yield int(i), j


def _alike(percent: int, registers: int):
    """The rows of a block that have a partner."""

    def run(table: pa.Table) -> pa.Table:
        found = [np.append(j, i) for i, j in _partners(table, percent, registers)]
        return table.take(pa.array(np.unique(np.concatenate(found)) if found else [], pa.int64()))

    return run


def _links(k: int, percent: int, registers: int):
    """Links between partners of a block, by their whole texts."""

    def run(table: pa.Table) -> pa.Table:
        memo, rep, texts = word_hashes(), table.column("rep").to_pylist(), table.column("text")
        sets: dict[int, np.ndarray] = {}
        out: list[tuple[int, int]] = []
        for i, partners in _partners(table, percent, registers):
            left = shingles(texts[i].as_py(), k, memo)
            for j in partners.tolist():
                if j not in sets:
                    sets[j] = shingles(texts[j].as_py(), k, memo)
                both = common(left, sets[j])
                if 100 * both >= percent * (len(left) + len(sets[j]) - both):
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b -> (node, root): the smallest node that edges reach, for each node with an edge.

    Alternating large-star and small-star steps; every step is a grouped minimum and a join on the same key. The minima
    are written first: only a join of two plain tables is split where one node has very many edges. The loop ends when the edges no longer change, which takes a logarithmic number of rounds.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a")))
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("low").alias("a"), "b")
        else:  # b holds the smaller neighbours of a: they and a itself go to the least of them
            out = joined.select(F.col("low").alias("a"), F.col("b")).union(low.select(F.col("low").alias("a"), F.col("a").alias("b")))
        return materialise(out.where("a < b").distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = materialise(edges.select("a", "b").distinct())
    was = mark(edges)
    while was[0]:
        edges = star(star(edges, True), False)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reached by links; kept marks that document. Documents of equal sets form one
    class and only its smallest id is compared. A row without doc_id takes no part: its component is null, it is kept.
    Rows of one id with several texts are one document of which each text has its links: all are in one component. A row
    without words is linked with nothing, whatever other rows its id has.

    In each bucket of a band, all members are compared with the bucket's smallest id. Buckets that then still hold
    several groups compare the members of every group but the bucket's largest with all members of other groups, in
    blocks of bounded size, by signature and then by text, so no link among bucket members is lost.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, mark long, n_shingles long, print binary, signature binary, bands array<long>"
    signed = materialise(texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_sign(shingle_words, bands, rows), schema))
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Ids of several rows; only if these have several sets does a text need more than its id to be found again: its mark.
    often = real.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("print")).alias("p"), F.max(F.xxhash64("print")).alias("q"))
    often = materialise(often.where("n > 1").select("doc_id", (F.col("p") != F.col("q")).alias("several")))
    clashing = often.where("several").select(F.col("doc_id").alias("rep"), F.lit(True).alias("several"))
    classes = real.groupBy("print").agg(F.min("doc_id").alias("rep"), F.min_by("mark", "doc_id").alias("mark"), F.max("n_shingles").alias("size"))
    mark = F.when(F.col("several"), F.col("mark")).otherwise(0).alias("mark")
    classes = materialise(classes.join(broadcast_if_small(clashing, 16), "rep", "left").select("print", "rep", mark, "size"))
    firsts = real.withColumnRenamed("doc_id", "rep").drop("mark").join(classes, ["rep", "print"])
    members = firsts.select("rep", "mark", "size", F.explode("bands").alias("key"))
    # What is joined with hot keys is written first: Spark splits a skewed join only between two plain tables.
    lowest = [F.min("rep").alias("low"), F.min_by("mark", "rep").alias("low_mark"), F.min_by("size", "rep").alias("low_size"), F.count("*").alias("n")]
    buckets = materialise(members.groupBy("key").agg(*lowest).where("n > 1"))
    shared = materialise(members.join(buckets.drop("n"), "key").select("key", "rep", "mark", "size", "low", "low_mark", "low_size"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(doc_id, mark, text) of distinct (doc_id, mark), once each."""
        wanted = wanted.join(broadcast_if_small(often, 16), "doc_id", "left").select("doc_id", "mark", F.col("several").isNotNull().alias("often"))
        wanted = materialise(wanted)
        worded = texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # other rows of an id have no set
        found = materialise(worded.join(broadcast_if_small(wanted, 24), "doc_id").where("mark = 0 OR mark = xxhash64(text)").select("doc_id", "mark", "text", "often"))
        again = found.where("often").groupBy("doc_id", "mark").agg(F.min("text").alias("text"))
        return found.where("NOT often").drop("often").unionByName(again)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs)
        sides = pairs.select(F.col("a").alias("doc_id"), F.col("mark_a").alias("mark")).union(pairs.select("b", "mark_b")).distinct()
        sides = materialise(texts_of(sides))
        full = pairs.join(sides.withColumnsRenamed({"doc_id": "b", "mark": "mark_b", "text": "text_b"}), ["b", "mark_b"])
        full = full.join(sides.withColumnsRenamed({"doc_id": "a", "mark": "mark_a", "text": "text_a"}), ["a", "mark_a"])
        return full.select("a", "mark_a", "b", "mark_b", "text_a", "text_b").mapInArrow(_confirm(shingle_words, percent), "a long, b long")

    first = shared.where(f"rep > low AND 100 * least(size, low_size) >= {percent} * greatest(size, low_size)")
    first = first.select(F.col("low").alias("a"), F.col("low_mark").alias("mark_a"), F.col("rep").alias("b"), F.col("mark").alias("mark_b")).distinct()
    edges = verified(first)
    if clashing.take(1):
        own = real.join(broadcast_if_small(clashing.select(F.col("rep").alias("doc_id")), 8), "doc_id", "left_semi").select("doc_id", "print")
        own = materialise(own.join(classes.select("print", "rep"), "print").select("doc_id", "rep").distinct())
        least = materialise(own.groupBy("doc_id").agg(F.min("rep").alias("low")))
        edges = edges.union(own.join(least, "doc_id").where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")))
    roots = materialise(connected(edges))
    placed = shared.select("key", "rep", "mark", "size").join(roots, shared.rep == roots.node, "left").select("key", "rep", "mark", "size", F.coalesce("root", "rep").alias("root"))
    open_keys = materialise(placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"), F.sum("size").alias("total")).where("least < most").select("key", "n", "total"))
    placed = materialise(placed.join(open_keys, "key"))
    if placed.take(1):
        largest = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("own")).groupBy("key").agg(F.max(F.struct("n", "root", "own")).alias("top"))
        largest = materialise(largest.select("key", F.col("top.root").alias("main"), F.col("top.n").alias("most"), F.col("top.own").alias("held")))
        wanted = materialise(placed.select("rep", "mark").distinct())
        signatures = materialise(firsts.select("rep", "mark", "signature").join(broadcast_if_small(wanted, 24), ["rep", "mark"], "left_semi").dropDuplicates(["rep", "mark"]))
        rest = placed.join(largest, "key").join(signatures, ["rep", "mark"])
        # Blocks of members, and of probes: those outside of the largest group. Each block of one meets each of the other.
        spread = F.xxhash64("rep", "mark")
        of = lambda n, weight: F.ceil(F.greatest(n / BLOCK, weight / WEIGHT)).cast("int")
        blocks = {"all": of(F.col("n"), F.col("total")), "few": of(F.col("n") - F.col("most"), F.col("total") - F.col("held"))}
        every = {k: F.explode(F.sequence(F.lit(0), n - 1)) for k, n in blocks.items()}
        dealt = {k: F.pmod(spread, n).cast("int") for k, n in blocks.items()}
        columns = ["key", "rep", "mark", "root", "size", "signature"]
        sides = rest.select(*columns, F.lit(False).alias("probe"), dealt["all"].alias("block"), every["few"].alias("other"))
        sides = sides.union(rest.where("root <> main").select(*columns, F.lit(True), every["all"], dealt["few"]))
        groups = ["key", "block", "other"]
        alike = materialise(sides.groupBy(*groups).applyInArrow(_alike(percent, bands * rows), sides.schema))
        whole = materialise(texts_of(alike.select(F.col("rep").alias("doc_id"), "mark").distinct()))
        full = alike.join(whole.withColumnRenamed("doc_id", "rep"), ["rep", "mark"]).groupBy(*groups)
        again = materialise(full.applyInArrow(_links(shingle_words, percent, bands * rows), "a long, b long").distinct())
        if again.take(1):
            roots = materialise(connected(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(again)))
    roots = materialise(classes.join(roots, classes.rep == roots.node, "left").select("print", F.coalesce("root", "rep").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(roots, "print", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
