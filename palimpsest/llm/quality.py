"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

A text's features say whether an n-gram occurs: single words, and runs of one to three word shapes. A shape keeps a
word's case pattern, its digits and its punctuation, and says whether the word repeats the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import svm
from palimpsest.llm.common import GOLDEN, Memo, broadcast_if_small, hash_words, materialise, mix, word_hashes
from palimpsest.llm.langid import remainder

#: Features are hashed into 2^BITS places.
BITS = 18
#: Labelled rows of each class that the hinge-loss model is fitted on: all if fewer and of no more than SAMPLE_BYTES of
#: features, else about so many by hash of their id. The log-count ratios are always taken over all labelled rows.
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
#: Classes of a word's shape in one window.
WINDOW = 12
_REPEAT = np.uint64(0xD6E8FEB86659FD93)


def classes(word: bytes) -> str:
    """Runs of capitals, other letters and digits as one mark each, and all other characters as they are."""
    out = []
    for c in word.decode("utf-8", "replace"):
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind or kind not in "Aa0":
            out.append(kind)
    return "".join(out)


def shape(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(classes(word))


def windows(word: bytes) -> list[int]:
    """Of a word with a long shape (a line of a script without blanks, say), the shape in consecutive windows."""
    found = classes(word)
    return [xxhash.xxh3_64_intdigest(found[k : k + WINDOW], 1) for k in range(0, len(found), WINDOW)] if len(found) > WINDOW else []


class Features:
    def __init__(self):
        self.words, self.shapes = word_hashes(), Memo(shape)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted places of the n-grams that occur."""
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if not words:
            return np.empty(0, np.uint32)
        h, s = hash_words(words, self.words), hash_words(words, self.shapes)
        s[1:] ^= np.where(h[1:] == h[:-1], _REPEAT, np.uint64(0))
        two = mix(s[:-1] * GOLDEN + s[1:])
        long = [x for w in words if len(w) > WINDOW for x in windows(w)]
        parts = [mix(h), mix(s), two, mix(two[:-1] * GOLDEN + s[2:]), mix(np.array(long, np.uint64))]
        found = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32)
        if len(found) < 1 << BITS - 5:
            return np.unique(found)
        flags = np.zeros(1 << BITS, bool)
        flags[found] = True
        return np.flatnonzero(flags).astype(np.uint32)


class Model:
    def __init__(self, ratios: np.ndarray, rows: list[np.ndarray], labels: np.ndarray):
        self.ratios = ratios
        y = np.where(labels > 0, 1.0, -1.0)
        scaled = [self._scaled(x) for x in rows]
        w = svm.fit(scaled, y, 1 << BITS, svm.balanced_cost(y, 10.0))
        self.weights, self.bias = w[:-1], w[-1]
        self.curve = svm.calibrate(np.array([self._margin(at, v) for at, v in scaled]), y) if len(set(y)) == 2 else (0.0, 30.0 * y[0])

    def _scaled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.ratios[at]
        return at, v / max(float(np.sqrt(v @ v)), 1e-9)

    def _margin(self, at: np.ndarray, v: np.ndarray) -> float:
        return float(self.weights[at] @ v + self.bias)

    def score(self, at: np.ndarray) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self._margin(*self._scaled(at)) + b, -30, 30))))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model learnt from (doc_id, text, label 0 or 1); None without rows."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            found = [of(x).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "x"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[label, np.frombuffer(x, np.uint32)] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0, at]), pa.array(total[1, at])], ["at", "n0", "n1"])

    rows = labelled.where("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    rows = materialise(rows.mapInArrow(features, "doc_id long, label int, x binary"))
    totals = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("bytes")).collect()
    sizes = {r["label"]: r["n"] for r in totals}
    if not sizes:
        return None
    found = rows.select("label", "x").mapInArrow(counts, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n = np.ones((2, 1 << BITS))
    n[:, found["at"]] += found[["n0", "n1"]].to_numpy(float).T
    ratios = np.log(n[1] / (sizes.get(1, 0) + 2)) - np.log(n[0] / (sizes.get(0, 0) + 2))
    shares = {r["label"]: min(1.0, sample / r["n"], SAMPLE_BYTES / max(r["bytes"], 1)) for r in totals}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("label")]
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share).collect()
    drawn.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    return Model(ratios, [np.frombuffer(r["x"], np.uint32) for r in drawn], np.array([r["label"] for r in drawn])) if drawn else None


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with a score column (replaced if there) in 0 to 1; 0.5 without a model. A null text scores as an empty one."""
    docs = docs.drop(name)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            found = [0.5 if shared.value is None else shared.value.score(of(x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, text, label) of the rows that may be learnt from: labelled and outside the held-out fold.

    Of several labels of one id the largest counts; labels other than 0 and 1 are none.

    Labels hold two numbers a document, far less than its text; they are broadcast if counted small, else joined by shuffle.
    """
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    marks = materialise(marks.where(remainder("doc_id", folds) != held))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(broadcast_if_small(marks, 40), "doc_id")


def quality_of(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; held_out is false for a row without doc_id."""
    model = train(labelled(docs, labels, folds, held), sample)
    held_out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("string").alias("text"))
    return score(own, model).select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
