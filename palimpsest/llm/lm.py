"""Masked pseudo-likelihood: a window network predicts every token from the two before and the two behind it.

All words of the corpus are counted. The most frequent are the network's vocabulary, whose size is a parameter; others are
one token to it, and each has its own share of that token's chance by its count. Every task trains the network on every
position of its texts in numpy, and the networks are averaged as a tree, weighted by their targets; rounds go on until the
next would gain little: less than SETTLED a token between quarters of a round, which a corpus of some MB reaches in its first
round, though further rounds still gain a few hundredths each. The output is a class of 64 words, then the word in it. A document's score is the sum of its words'
log-probabilities.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import expand, materialise, materialise_bucketed, squeeze

SIDE, CLASSES, WIDTH = 2, 64, 16
#: Tokens of the vocabulary, one of which stands for all other words.
VOCABULARY = CLASSES * CLASSES
#: A round's targets are taken in batches, smaller in small slices, so that these make steps enough too.
BATCH, RATE = 2048, 0.15
#: Logits up to this size need no shift before their exponentials are taken in single precision.
FAR = 80
#: Rounds at most; they end when the last quarter of a round's targets is, with confidence, predicted less than SETTLED a
#: token better than the quarter before, each by the network that has not yet seen it in that round.
ROUNDS, SETTLED = 40, 0.05
#: Distinct words that a counting task holds before it passes its counts on.
HELD = 300_000
#: Tokens whose positions are shuffled together in training, and tokens of a block of scored texts.
TOGETHER, BLOCK = 500_000, 2_000_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_PAD, _OTHER = VOCABULARY, VOCABULARY - 1
_BLANK = re.compile(rb"[ \t-\r]")


def words(text: str | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text between ASCII white space, in lists of bounded size."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE)
        end = cut.end() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in words(text.as_py()):
                    held.update(part)
                    if len(held) > HELD:
                        yield pack(held)
                        held = Counter()
        yield pack(held)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> tuple[dict[bytes, int], np.ndarray]:
    """The most frequent words with their numbers, and the counts of all tokens."""
    counts = materialise(word_counts(docs)) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - 1).collect()
    n = np.zeros(VOCABULARY)
    n[: len(top)] = [r["n"] for r in top]
    n[_OTHER] = max((counts.agg(F.sum("n")).first()[0] or 0) - n.sum(), 1)
    return {bytes(r["word"]): i for i, r in enumerate(top)}, n


class Network:
    """Parameters: context vectors by place, class and member weights, class and member biases."""

    shapes = [(2 * SIDE, VOCABULARY + 1, WIDTH), (WIDTH, CLASSES), (WIDTH, CLASSES), (CLASSES,), (CLASSES, CLASSES)]

    def __init__(self, parameters: list[np.ndarray]):
        self.parameters = parameters

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        p = ((counts + 0.5) / (counts + 0.5).sum()).reshape(CLASSES, CLASSES)
        context, outer, inner = (rng.normal(0, 0.1, x).astype(np.float32) for x in cls.shapes[:3])
        return cls([context, outer, inner, np.log(p.sum(axis=1)).astype(np.float32), np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)])

    @classmethod
    def read(cls, data: bytes) -> Network:
        flat, out = np.frombuffer(data, np.float32), []
        for shape in cls.shapes:
            n = int(np.prod(shape))
            out.append(flat[:n].reshape(shape).copy())
            flat = flat[n:]
        return cls(out)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters])

    def weights(self) -> tuple[np.ndarray, bool]:
        """Class and member weights side by side, and whether all logits are far from where their exponentials leave the
        range of single precision: no hidden component is above 1."""
        _, outer, inner, outer_bias, inner_bias = self.parameters
        both = np.concatenate([outer, inner], axis=1)
        return both, bool(np.abs(both).sum(axis=0).max() + max(np.abs(outer_bias).max(), np.abs(inner_bias).max()) < FAR)

    def forward(self, context: np.ndarray, target: np.ndarray, weights: tuple[np.ndarray, bool] | None = None):
        """Hidden layer (targets by WIDTH), exponentials of the logits of classes and, beside them, of members of the target's
        class (targets by 2 * CLASSES), the sums of both (targets by 2), and the log-probability of each target."""
        vectors, _, _, outer_bias, inner_bias = self.parameters
        both, near = weights or self.weights()
        hidden = vectors[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            hidden += vectors[k].take(context[:, k], axis=0)
        np.tanh(hidden, out=hidden)
        group, member = target // CLASSES, target % CLASSES
        logits = hidden @ both
        logits[:, :CLASSES] += outer_bias
        logits[:, CLASSES:] += inner_bias.take(group, axis=0)
        halves = logits.reshape(-1, CLASSES)
        if not near:
            halves -= halves.max(axis=1, keepdims=True)
        row = np.arange(len(target))
        chosen = logits[row, group] + logits[row, CLASSES + member]
        np.exp(logits, out=logits)
        total = (halves @ np.ones(CLASSES, np.float32)).reshape(-1, 2)
        return hidden, logits, total, chosen - np.log(total).sum(axis=1)

    def step(self, context: np.ndarray, target: np.ndarray, squares: list[np.ndarray]) -> np.ndarray:
        """One Adagrad step on the mean loss of a batch; the losses before it."""
        n = len(target)
        order = np.argsort(target.astype(np.int16), kind="stable")
        context, target = context[order], target[order]
        both, _ = weights = self.weights()
        hidden, p, total, chance = self.forward(context, target, weights)
        halves, share = p.reshape(-1, 2, CLASSES), np.float32(1 / n)
        halves *= (share / total)[:, :, None]
        group, row = target // CLASSES, np.arange(n)
        p[row, group] -= share
        p[row, CLASSES + target % CLASSES] -= share
        back = p @ both.T
        back *= 1 - hidden * hidden
        by_both, ones = hidden.T @ p, np.ones(n, np.float32)
        by_group, first = np.zeros_like(self.parameters[4]), _starts(group).tolist()
        for i, j in zip(first, [*first[1:], n]):
            by_group[group[i]] = ones[: j - i] @ p[i:j, CLASSES:]
        # All places have one table of vectors here; pairs of components are added as complex numbers, two at a time.
        vectors, square = self.parameters[0].reshape(-1, WIDTH), squares[0].reshape(-1, WIDTH)
        places = (context.T + np.arange(2 * SIDE)[:, None] * (VOCABULARY + 1)).astype(np.int16).ravel()
        order = np.argsort(places, kind="stable")
        own = places[order]
        first = _starts(own)
        at = own[first].astype(np.intp)
        gradient = np.add.reduceat(back.take(order % n, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        own = square.take(at, axis=0)
        own += gradient * gradient
        square[at] = own
        own += np.float32(1e-8)
        gradient /= np.sqrt(own, out=own)
        gradient *= np.float32(RATE)
        vectors[at] = np.subtract(vectors.take(at, axis=0), gradient, out=gradient)
        gradients = (by_both[:, :CLASSES], by_both[:, CLASSES:], ones @ p[:, :CLASSES], by_group)
        for value, gradient, square in zip(self.parameters[1:], gradients, squares[1:]):
            square += gradient**2
            value -= RATE * gradient / np.sqrt(square + 1e-8)
        return -chance


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Places where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _tokens(text: str | None, numbers: dict[bytes, int], rare: list[bytes] | None = None) -> np.ndarray:
    """The text's tokens between two paddings on each side; words outside the vocabulary are added to ``rare``."""
    pad, out = np.full(SIDE, _PAD, np.int32), []
    for part in words(text):
        out.append(np.fromiter(map(numbers.get, part, itertools.repeat(_OTHER)), np.int32, len(part)))
        if rare is not None:
            rare += itertools.compress(part, (out[-1] == _OTHER).tolist())
    return np.concatenate([pad, *out, pad])


def _context(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([tokens[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def _gathered(texts: Iterator, numbers: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Tokens of several texts, until they are TOGETHER; a longer text is alone or ends such a group."""
    held, n = [], 0
    for text in texts:
        held.append(_tokens(text, numbers))
        n += len(held[-1])
        if n >= TOGETHER:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


_TRAINED = "part long, n long, network binary, quarters array<double>"


def _round(docs: DataFrame, numbers: dict[bytes, int], network: Network, squares: Network, number: int, stride: int) -> tuple[Network, Network, bool]:
    """The network and Adagrad's squares after every task has trained on its texts, averaged by their targets, and whether
    the loss has settled."""
    shared = docs.sparkSession.sparkContext.broadcast((numbers, network.flat().tobytes(), squares.flat().tobytes()))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, sums = shared.value
        own, squares = Network.read(start), Network.read(sums)
        losses = [np.zeros((0, 3))]
        for tokens in _gathered((x.as_py() for batch in batches for x in batch.column(0)), known):
            at = np.flatnonzero(tokens != _PAD)[number % stride :: stride]
            at = np.random.default_rng(len(at) + number).permutation(at)
            size = min(BATCH, max(16, len(at) // 64))
            for k in range(0, len(at), size):
                found = own.step(_context(tokens, at[k : k + size]), tokens[at[k : k + size]], squares.parameters).astype(np.float64)
                losses.append(np.array([[len(found), found.sum(), found @ found]]))
        steps = np.concatenate(losses)
        n = int(steps[:, 0].sum())
        if n:
            done = steps[:, 0].cumsum() / n
            quarters = [*steps[(done > 0.5) & (done <= 0.75)].sum(axis=0), *steps[done > 0.75].sum(axis=0)]
            both = np.concatenate([own.flat(), squares.flat()])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([both.tobytes()], pa.binary()), pa.array([quarters], pa.list_(pa.float64()))], ["part", "n", "network", "quarters"])

    found = docs.select("text").mapInArrow(fit, _TRAINED)
    for groups in (1024, 32):
        found = found.groupBy(F.pmod("part", F.lit(groups))).applyInArrow(_total, _TRAINED)
    found = found.collect()  # 32 networks at most
    if not found:
        return network, squares, True
    found = _total(pa.Table.from_pylist([r.asDict() for r in found])).to_pylist()[0]
    network, squares = (Network.read(x.tobytes()) for x in np.split(np.frombuffer(found["network"], np.float32), 2))
    return network, squares, settled(found["quarters"])


def _total(table: pa.Table) -> pa.Table:
    """One row of several: the networks' mean, weighted by their targets, and the sums of all else."""
    table = table.sort_by("part")
    n = table.column("n").to_pylist()
    flat = 0
    for k, x in zip(n, table.column("network")):
        flat = flat + k * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
    quarters = np.array(table.column("quarters").to_pylist()).sum(axis=0).tolist()
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64())]
    row = [table.column("part")[0].as_py(), sum(n), (flat / sum(n)).astype(np.float32).tobytes(), quarters]
    return pa.table([pa.array([x], t) for x, t in zip(row, types)], ["part", "n", "network", "quarters"])


def settled(quarters: list[float]) -> bool:
    """Whether the mean loss fell by less than SETTLED from one quarter to the next (each: number, sum, sum of squares), with
    two standard errors to spare."""
    means, errors = [], 0.0
    for n, total, square in (quarters[:3], quarters[3:]):
        if not n:
            return False
        means.append(total / n)
        errors += max(square / n - (total / n) ** 2, 0) / n
    return means[0] - means[1] + 2 * math.sqrt(errors) < SETTLED


def mean_loss(docs: DataFrame, numbers: dict[bytes, int], network: Network) -> float | None:
    """Minus the mean log-probability of the network's tokens of all rows of (text); None if there are none."""
    total = score(docs.select(F.lit(None).alias("doc_id"), "text"), numbers, network).agg(F.sum("n_tokens"), F.sum("log_likelihood")).first()
    return -total[1] / total[0] if total[0] else None


def train(docs: DataFrame, stride: int = 1, rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[dict[bytes, int], Network]:
    """The vocabulary and the network learnt from all rows of (text); ``counts`` are those of their words if known.

    Every position is a target in every round; with ``stride``, one in so many in each round, in turn.
    """
    numbers, sizes = vocabulary(docs, counts)
    network = Network.fresh(sizes)
    squares = Network([np.zeros_like(x) for x in network.parameters])
    for number in range(rounds):
        network, squares, done = _round(docs, numbers, network, squares, number, stride)
        if done and number + 1 >= stride:
            break
    return numbers, network


_SCORED = "doc_id long, n_tokens long, log_likelihood double"


def score(docs: DataFrame, numbers: dict[bytes, int], network: Network, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum; 0 for a null or empty text) and mean_log_likelihood (null there) of every row.

    With the ``counts`` of all words, a word outside the vocabulary takes the chance of the token for these times its own
    share of their count; all unseen words share one count. Without, each takes the whole chance of that token.
    """
    shared = docs.sparkSession.sparkContext.broadcast((numbers, network.flat().tobytes()))
    counted = counts is not None
    names = ["block", "docs", "sizes", "sums", "many", "places", "words"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, data = shared.value
        own = Network.read(data)
        part, block = TaskContext.get().partitionId(), itertools.count()
        ids, tokens, rare, held = [], [], [], 0
        place: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)  # of each rare word among the block's

        def close() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, tokens)])
            flat = np.concatenate(tokens)
            at = np.flatnonzero(flat != _PAD)
            weights = own.weights()
            chances = [own.forward(_context(flat, at[k : k + BATCH]), flat[at[k : k + BATCH]], weights)[3] for k in range(0, len(at), BATCH)]
            sums = np.concatenate([[0.0], *chances]).cumsum(dtype=np.float64)[np.searchsorted(at, ends)]
            sizes = [len(x) - 2 * SIDE for x in tokens]
            if not counted:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.diff(sums))], _SCORED.replace(",", "").split()[::2])
            distinct = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in place), np.uint64, len(place))
            row = [(part << 32) + next(block), ids, sizes, np.diff(sums).tolist(), [len(x) for x in rare], squeeze(np.concatenate(rare)), distinct.view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found: list[bytes] = []
                ids.append(doc)
                tokens.append(_tokens(text.as_py(), known, found if counted else None))
                rare.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
                held += len(tokens[-1])
                if held >= BLOCK:
                    yield close()
                    ids, tokens, rare, held = [], [], [], 0
                    place = defaultdict(itertools.count().__next__)
        if ids:
            yield close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not counted:
        found = own.mapInArrow(run, _SCORED)
    else:
        blocks = materialise_bucketed(own.mapInArrow(run, "block long, docs array<long>, sizes array<long>, sums array<double>, many array<long>, places binary, words array<long>"), "block")
        known = docs.sparkSession.createDataFrame([(bytearray(w),) for w in numbers], "word binary")
        tail = materialise(counts.join(F.broadcast(known), "word", "left_anti").select(F.xxhash64("word").alias("word"), "n"))
        whole = math.log((tail.agg(F.sum("n")).first()[0] or 0) + 1)
        # Each block asks once for each of its words, so no key is hot.
        asked = blocks.select("block", F.posexplode("words").alias("at", "word")).join(tail.groupBy("word").agg(F.sum("n").alias("n")), "word")

        def add(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for row in left.to_pylist():
                share = np.full(row["distinct"], -whole)  # an unseen word counts as one
                share[right.column("at").to_numpy()] += np.log(right.column("n").to_numpy())
                sums = np.concatenate([[0.0], share[expand(row["places"])]]).cumsum()
                ends = np.cumsum([0, *row["many"]])
                out.append((row["docs"], row["sizes"], np.array(row["sums"]) + np.diff(sums[ends])))
            columns = [list(itertools.chain.from_iterable(x)) for x in zip(*out)] or [[], [], []]
            return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "n_tokens", "log_likelihood"])

        left = blocks.select("block", "docs", "sizes", "sums", "many", "places", F.size("words").alias("distinct"))
        found = left.groupBy("block").cogroup(asked.select(F.col("block").alias("of"), "at", "n").groupBy("of")).applyInArrow(add, _SCORED)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood")
    return found.select("doc_id", "n_tokens", "log_likelihood", mean)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on the rows of (doc_id, text), then score them all. Equal rows have equal scores; rows without id are scored too."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = materialise(word_counts(texts))
    return score(docs, *train(texts, counts=counts), counts)
