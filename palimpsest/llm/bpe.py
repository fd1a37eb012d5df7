"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

Texts fall into pieces by the vocabulary's pattern. A block of texts keeps its distinct pieces once, and where they occur
as numbers into that list, in order of position. The lists of all blocks are exploded and shuffled by piece; each distinct
piece is encoded once where its rows meet, and the ids go back to the blocks, where they are put together by position. The
blocks are written in buckets, so only the ids, packed by block, are shuffled to meet them.
Decoding looks every id of a text up in the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import expand, materialise_bucketed, squeeze
from palimpsest.llm.tokens import known_ranks, merged, pieces, read_ranks

#: Pieces after which a block is closed; a longer text is a block of its own.
BLOCK = 4_000_000
#: Encoded pieces, and bytes of them, that a task holds before it packs them by block.
PACK, PACK_BYTES = 1_000_000, 64 << 20


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = out = len(self)
        return out


_BLOCKS = "block long, docs array<long>, sizes array<long>, places binary, words array<string>"


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), itertools.count()

        def close() -> pa.RecordBatch:
            places = np.concatenate(found) if found else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(places, minlength=len(numbers)), kind="stable")  # frequent pieces get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            words = list(numbers)
            row = [(part << 32) + next(count), ids, [len(x) for x in found], squeeze(rank[places]), [words[i] for i in order]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["block", "docs", "sizes", "places", "words"])

        ids, found, numbers, held = [], [], _Numbers(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = pieces(text.as_py() or "")
                ids.append(doc)
                found.append(np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts)))
                held += len(parts) + 1
                if held >= block:
                    yield close()
                    ids, found, numbers, held = [], [], _Numbers(), 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCKS)


def _packed(blocks: list[int], ats: list[int], ids: list[bytes]) -> pa.RecordBatch:
    """One row per block: steps between the rising places, numbers of ids and the ids, each squeezed."""
    block, at, count = np.array(blocks, np.int64), np.array(ats, np.int64), np.array([len(x) // 4 for x in ids], np.int64)
    order = np.lexsort((at, block))
    ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(order))
    rows = []
    for part in np.split(order, ends[:-1]):
        data = np.frombuffer(b"".join(map(ids.__getitem__, part.tolist())), "<u4")
        rows.append((int(block[part[0]]), squeeze(np.diff(at[part], prepend=0)), squeeze(count[part]), squeeze(data)))
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["block", "steps", "counts", "ids"])


def _unpacked(table: pa.Table, words: int) -> list[bytes]:
    """The ids of a block's distinct pieces, in order."""
    out = [b""] * words
    for steps, counts, ids in zip(*(table.column(c).to_pylist() for c in ("steps", "counts", "ids"))):
        data, ends = expand(ids).tobytes(), 4 * np.cumsum(expand(counts), dtype=np.int64)
        for at, a, b in zip(np.cumsum(expand(steps), dtype=np.int64).tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out[at] = data[a:b]
    return out


def encode_words(words: DataFrame, ranks: str, pack: int = PACK) -> DataFrame:
    """(word, block, at) -> packs of ids by block: rows of one word meet in one partition, where it is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, ids, size = known_ranks(ranks), None, b"", 0
        blocks, ats, out = [], [], []
        for batch in batches:
            for word, block, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if word != last:
                    last, found = word, merged(word.encode("utf-8", "surrogatepass"), known)
                    ids = struct.pack(f"<{len(found)}I", *found)
                blocks.append(block)
                ats.append(at)
                out.append(ids)
                size += len(ids)
                if len(out) >= pack or size >= PACK_BYTES:
                    yield _packed(blocks, ats, out)
                    blocks, ats, out, size = [], [], [], 0
        if out:
            yield _packed(blocks, ats, out)

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, steps binary, counts binary, ids binary")


def encode(docs: DataFrame, ranks: str | None = None, block: int = BLOCK, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of (doc_id, text); with ``keep`` ids (binary, little-endian
    unsigned 32-bit) and the decoded text too. A null text is an empty one. Rows of equal or null doc_id stay apart."""
    ranks = ranks or path("byte_bpe_multi_50k.tiktoken")
    table = {rank: token for token, rank in read_ranks(ranks).items()}
    token_bytes = docs.sparkSession.sparkContext.broadcast([table.get(i, b"") for i in range(max(table) + 1)])
    found = materialise_bucketed(blocks(docs, block).withColumn("distinct", F.size("words")), "block")
    coded = encode_words(found.select("block", F.posexplode("words").alias("at", "word")).select("word", "block", "at"), ranks)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for k in range(left.num_rows):
            ids = _unpacked(right, left.column("distinct")[k].as_py())
            places = expand(left.column("places")[k].as_py())
            at = 0
            for doc, size in zip(left.column("docs")[k].as_py(), left.column("sizes")[k].as_py()):
                data = b"".join(map(ids.__getitem__, places[at : at + size].tolist()))
                at += size
                text = b"".join(map(token_bytes.value.__getitem__, np.frombuffer(data, "<u4").tolist()))
                rows.append((doc, len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(text).hexdigest(), *((data, text.decode("utf-8", "replace")) if keep else ())))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep else 4]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types[: len(names)]], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    return found.select("block", "docs", "sizes", "places", "distinct").groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(run, schema)
