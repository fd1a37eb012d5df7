"""Language identification in two steps: the family first, then one-versus-one linear support vector machines.

A text is the frequencies of its byte trigrams (A-Z lower-cased), hashed into ``DIMS`` places. All models are linear
in them, so a text's margins are means of weight rows over its trigrams, whatever its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import svm
from palimpsest.llm.common import broadcast_if_small, materialise

DIMS = 8192
#: Training texts of each language: all if there are fewer, else about so many, chosen by the hash of their id.
SAMPLE = 400
#: Training texts of other families that a family is told from: all if there are fewer, else about so many of them, chosen by
#: the hash of their id. They are what all tasks share, with 48 KB each at most.
REST = 4000
#: Scale of the trigram frequencies, so that rows have norms near one.
SCALE = 10.0
#: Bytes of a text that are hashed at once.
WINDOW = 1 << 20
_LETTER = regex.compile(r"\p{L}")

# Language families by code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"own:{lang}")


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Places of the text's trigrams, window by window."""
    data = np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass").lower(), np.uint8)
    for at in range(0, len(data) - 2, WINDOW):
        b = data[at : at + WINDOW + 2].astype(np.uint32)
        yield ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)) % np.uint32(DIMS)


def frequencies(text: str) -> np.ndarray:
    total = np.zeros(DIMS)
    for at in trigrams(text):
        total += np.bincount(at, minlength=DIMS)
    return SCALE * total / max(total.sum(), 1.0)


def sparse(x: np.ndarray) -> tuple[bytes, bytes]:
    """Places that are not zero, and their values."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes(), x[at].astype(np.float32).tobytes()


def _model(*about: str) -> str:
    """The name of a family's model, or of a pair's."""
    return json.dumps(about)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float, tuple[float, float]]:
    """Weights over places, bias and curve of one linear model."""
    w = svm.fit(rows, y, DIMS, svm.balanced_cost(y, 10.0))
    curve = svm.calibrate(np.array([w[at] @ v + w[-1] for at, v in rows]), y)
    return (SCALE * w[:-1]).astype(np.float32), float(w[-1]), curve


class Model:
    """Families, languages and one matrix that holds all linear models."""

    def __init__(self, texts: list, langs: list[str], fitted: dict[str, tuple] | None = None):
        """``texts`` are frequencies, or (places, values) of those that are not zero; with ``fitted`` models by name none is learnt
        here."""
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family_of(a) == family_of(b)]
        if fitted is None:
            rows = [x if isinstance(x, tuple) else (np.flatnonzero(x), x[np.flatnonzero(x)]) for x in texts]
            family, fitted = np.array([family_of(x) for x in langs]), {}
            for name in self.families if len(self.families) > 1 else []:
                fitted[_model("family", name)] = learn(rows, np.where(family == name, 1.0, -1.0))
            for a, b in self.pairs:
                keep = [i for i, x in enumerate(langs) if x in (a, b)]
                fitted[_model("pair", a, b)] = learn([rows[i] for i in keep], np.array([1.0 if langs[i] == a else -1.0 for i in keep]))
        names = [_model("family", x) for x in self.families if len(self.families) > 1] + [_model("pair", a, b) for a, b in self.pairs]
        self.weights = np.ascontiguousarray(np.array([fitted[x][0] for x in names], np.float32).reshape(-1, DIMS).T)
        self.bias, self.curves = np.array([fitted[x][1] for x in names]), [fitted[x][2] for x in names]

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest family's likeliest language, with its chance; equal ones go to the later in order of names within a
        family, to the earlier between families."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in trigrams(text):
            total += self.weights[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        margins = total / max(n, 1) + self.bias
        sure = np.array([1 / (1 + np.exp(-np.clip(a * m + b, -30, 30))) for m, (a, b) in zip(margins, self.curves)])
        many = len(self.families) if len(self.families) > 1 else 0
        chances = sure[:many] / sure[:many].sum() if many else np.ones(1)
        k = int(chances.argmax())
        own = [x for x in self.langs if family_of(x) == self.families[k]]
        odds = dict.fromkeys(own, 2.0 - len(own))
        for (a, b), p in zip(self.pairs, sure[many:]):
            if a in odds:
                odds[a] += 1 / p
                odds[b] += 1 / (1 - p)
        shares = {x: 1 / max(odds[x], 1.0) for x in own}  # pairwise coupling: 1 if every pair is certain, 1/n if none is
        total = sum(shares.values())
        best = max(own, key=lambda x: (shares[x], x))
        return best, float(min(max(chances[k] * shares[best] / total, 0.0), 1.0))


def _rows(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(float)) for *_, at, x in rows]


def _fitted(drawn: DataFrame, langs: list[str], rest: list[tuple]) -> dict[str, tuple]:
    """Every model by its name, each learnt in a task of its own: a family from its texts and those that all share, a pair of
    languages from the texts of both."""
    families: dict[str, list[str]] = {}
    for x in langs:
        families.setdefault(family_of(x), []).append(x)
    several = len(families) > 1
    tasks = [(x, name) for family, own in families.items() for x in own for name in ([_model("family", family)] if several else []) + [_model("pair", a, b) for a, b in combinations(own, 2) if x in (a, b)]]
    spark = drawn.sparkSession
    shared = spark.sparkContext.broadcast(rest)

    def run(table: pa.Table) -> pa.Table:
        name = table.column("model")[0].as_py()
        kind, first, *_ = json.loads(name)
        own = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "lang", "at", "x"))))
        if kind == "family":
            own += [r for r in shared.value if family_of(r[1]) != first]
        own.sort()
        of = family_of if kind == "family" else str
        weights, bias, curve = learn(_rows(own), np.array([1.0 if of(r[1]) == first else -1.0 for r in own]))
        return pa.table({"model": [name], "weights": pa.array([weights.tobytes()], pa.binary()), "bias": [bias], "slope": [curve[0]], "offset": [curve[1]]})

    named = spark.createDataFrame(tasks, "lang string, model string") if tasks else None
    if named is None:
        return {}
    found = drawn.join(named, "lang").groupBy("model").applyInArrow(run, "model string, weights binary, bias double, slope double, offset double")
    return {r["model"]: (np.frombuffer(r["weights"], np.float32), r["bias"], (r["slope"], r["offset"])) for r in found.collect()}


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model learnt from (doc_id, text, lang), which must hold labelled rows only; None without any such row.

    All languages are learnt. To the driver come their names, the shared texts and the models' weights (32 KB each).
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sparse(frequencies(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in found], pa.binary()) for k in (0, 1))], ["doc_id", "lang", "at", "x"])

    chosen = rows.select("doc_id", "lang", "text").join(broadcast_if_small(counts, 32, "lang"), "lang").where(spread < F.least(F.lit(1.0), sample / F.col("n")))
    drawn = materialise(chosen.select("doc_id", "lang", "text").mapInArrow(features, "doc_id long, lang string, at binary, x binary"))
    langs = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return None
    few = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30) < REST / sum(langs.values())
    rest = [(r["doc_id"], r["lang"], bytes(r["at"]), bytes(r["x"])) for r in drawn.where(few).collect()]
    return Model([], sorted(langs), _fitted(drawn, sorted(langs), rest))


def identify(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", sure: str = "score") -> DataFrame:
    """``docs`` with two columns added: the language and how sure it is (columns of those names are replaced).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if there is no model.
    """
    docs = docs.drop(pred, sure)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [("und", 0.0) if x is None or shared.value is None or not _LETTER.search(x) else shared.value.predict(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], [*batch.schema.names, pred, sure])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(sure, T.DoubleType())]))


def remainder(column: str, by: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def language_of(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learnt from rows outside the held-out fold of their doc_id.

    A row without doc_id belongs to no fold: held_out is false and nothing is learnt from it.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(own.where(remainder("doc_id", folds) != held), sample)
    held_out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out")
    return identify(own.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score")
