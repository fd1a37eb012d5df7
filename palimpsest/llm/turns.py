"""Repair of conversations: damage, faults, and the cheapest edits that make the roles of each one a legal sequence.

A finite automaton knows the legal sequences, ``(s?(ua)+)?`` by the roles' initials. DuckDB's recursive query takes each task's
batch of conversations one turn further with each recursion, and keeps for each state of the automaton the cheapest way there
and, of equally cheap ones, the least record of its edits. That is enough: two different records of equal cost at one turn never
begin one with the other, so whatever follows does not change their order.

A long conversation is not one task's work. The turns of all conversations are sorted, numbered through and cut into stretches
of bounded length; the recursion runs on every stretch from every state it may begin in, and then, in rounds, on runs of
stretches, whose ways from state to state take the place of turns. Only the hash of a repaired conversation reads it in one
place, as such a hash must; it streams the turns and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import broadcast_if_small, materialise

#: Turns of a stretch, and stretches whose ways one round puts together.
STRETCH, RUN = 32, 32
#: Steps (turns or stretches, by states) and bytes of them, that one query takes at once.
BATCH, BYTES = 20_000, 16 << 20
#: What edits cost, a truncated row that stays, and the letters of the record.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; where a sequence may end.
STATES, ENDS = (0, 1, 2, 3), (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLES = {"u": "user", "a": "assistant"}

_WHITE = r"\x20\x09-\x0D"


def _inserted() -> dict[int, list[tuple[int, str, int]]]:
    """From each state, those that inserted turns lead to: (state, record, cost). More than two come back to the same states."""
    out = {}
    for state in STATES:
        ways, at = [(state, "", 0)], state
        for n in (1, 2):
            at = next(to for c in _ROLES if (to := _NEXT.get((at, c))) is not None)
            ways.append((at, "I" * n, n * INSERT))
        out[state] = ways
    return out


def moves() -> list[tuple[str, int, int, str, int]]:
    """(kind of row, state before, state after, record, cost), with insertions before the row: the cheapest, least way for each.

    A kind is ``-`` for a row that must go, else its initial (``?`` for one that can't stay as it is), with ``t`` if truncated.
    """
    best: dict[tuple, tuple] = {}
    for kind in ("-", *(c + t for c in "sua?" for t in ("", "t"))):
        stay = TRUNCATED if kind.endswith("t") else 0
        for src, ways in _inserted().items():
            for mid, record, cost in ways:
                found = [(mid, record + "D", cost + DELETE)]
                if kind != "-":
                    found += [(_NEXT[mid, c], record + "K", cost + KEEP + stay) for c in kind[0] if (mid, c) in _NEXT]
                    found += [(_NEXT[mid, c], record + "R", cost + REROLE + stay) for c in _ROLES if (mid, c) in _NEXT]
                for dst, edits, total in found:
                    best[kind, src, dst] = min(best.get((kind, src, dst), (total, edits)), (total, edits))
    return [(*key, edits, total) for key, (total, edits) in best.items()]


def _endings() -> list[tuple[int, str, int]]:
    """(state, record, cost) of what is inserted at a conversation's end."""
    return [(src, record, cost) for src, ways in _inserted().items() for mid, record, cost in ways if mid in ENDS]


# -- rows


def damage(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as the contract damages them, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls in these
    count as one blank, and no role or text is null afterwards."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named[2].alias("role"), named[3].alias("text"),
                       (F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    changed = rows.where("kind <> 0").withColumns({"text": text, "role": role})
    return changed.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``place``, which rises along each conversation: by turn, nulls first, then role and text.

    Rows are dealt out by ranges of all these, so that no conversation, turn or text has to be one task's; equal rows by chance.
    """
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    spread = rows.withColumn("chance", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys, F.substring("text", 1, 64).asc(), "chance")
    return spread.sortWithinPartitions(*keys, "text").withColumn("place", F.monotonically_increasing_id()).drop("chance")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, initial, fault) of ordered rows; fault is blank, duplicate, truncated or null."""
    kind = F.when(~F.col("text").rlike(f"[^{_WHITE}]"), "blank").when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), "truncated")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    looked = materialise(rows.select("conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"), same.alias("same"), kind.alias("fault")))
    often = looked.groupBy("conv_id", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    often = materialise(often.select(F.col("conv_id").alias("own"), F.col("same").alias("seen"), "first"))
    joined = looked.join(broadcast_if_small(often, 120), F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("same") == F.col("seen")), "left")
    again = (F.col("first") < F.col("place")) & ~F.col("fault").eqNullSafe("blank")
    return joined.select("conv_id", "turn", "place", "initial", F.when(again, F.lit("duplicate")).otherwise(F.col("fault")).alias("fault"))


# -- the recursion

#: Steps (key, step from 1 on, src, dst, record, cost), states to begin in, and each key's last step: one more step with each recursion.
_ADVANCE = """
    WITH RECURSIVE ways(key, start, step, state, cost, record) AS (
        SELECT key, state, 0::BIGINT, state, 0::BIGINT, '' FROM starts
        UNION ALL
        SELECT key, start, step, state, best.cost, best.record FROM (
            SELECT w.key, w.start, w.step + 1 AS step, s.dst AS state, min({'cost': w.cost + s.cost, 'record': w.record || s.record}) AS best
            FROM ways w JOIN steps s ON s.key = w.key AND s.step = w.step + 1 AND s.src = w.state GROUP BY ALL)
    )
    SELECT w.key, w.start AS src, w.state AS dst, w.record, w.cost FROM ways w JOIN lengths l ON w.key = l.key AND w.step = l.n
"""
_ENDED = f"""
    SELECT key, src, 0 AS dst, best.record AS record, best.cost AS cost FROM (
        SELECT w.key, w.src, min({{'cost': w.cost + e.cost, 'record': w.record || e.record}}) AS best
        FROM ({_ADVANCE}) w JOIN endings e ON e.state = w.dst GROUP BY ALL)
"""
_WAYS = "conv_id long, stretch long, src int, dst int, record string, cost long, first string, last string, illegal long"
_LEGAL = {"su", "ua", "au"}


def _connection() -> duckdb.DuckDBPyConnection:
    own = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    own.execute("CREATE TABLE moves (kind VARCHAR, src INTEGER, dst INTEGER, record VARCHAR, cost BIGINT)")
    own.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
    own.execute("CREATE TABLE endings (state INTEGER, record VARCHAR, cost BIGINT)")
    own.executemany("INSERT INTO endings VALUES (?, ?, ?)", _endings())
    return own


class _Groups:
    """Some whole groups of sorted rows: rows of one (conv_id, stretch) are next to each other."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        conv, stretch = rows["conv_id"], rows["stretch"].to_numpy()
        absent, number = conv.isna().to_numpy(), conv.fillna(0).to_numpy().astype(np.int64)
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (absent[1:] != absent[:-1]) | (number[1:] != number[:-1]) | (stretch[1:] != stretch[:-1])
        self.starts = np.flatnonzero(fresh)
        self.key = np.cumsum(fresh) - 1

    def step(self, of: np.ndarray) -> np.ndarray:
        """Numbers from 1 on in each group: one more wherever ``of`` changes within it."""
        change = np.ones(len(of), np.int64)
        change[1:] = of[1:] != of[:-1]
        total = np.cumsum(change)
        return total - total[self.starts][self.key] + 1

    def illegal(self, at: np.ndarray, first: str, last: str, own: np.ndarray) -> tuple[list, list, np.ndarray]:
        """Each group's first and last initials, and the illegal neighbours: those within its steps and between them."""
        heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (self.key[1:] != self.key[:-1])))
        key, firsts, lasts = self.key[heads], self.rows[first].to_numpy()[heads], self.rows[last].to_numpy()[heads]
        bad = own[heads].astype(np.int64)
        bad[1:] += [k == j and a + b not in _LEGAL for k, j, a, b in zip(key[1:], key[:-1], lasts[:-1], firsts[1:])]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
        return firsts[np.append(0, ends[:-1] + 1)].tolist(), lasts[ends].tolist(), np.bincount(key, bad).astype(np.int64)


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[_Groups]:
    """Sorted rows by groups, as many at once as ``BATCH`` and ``BYTES`` let."""
    held: pd.DataFrame | None = None
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            size += part.nbytes
            rows = part.to_pandas(integer_object_nulls=True)
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if len(held) < BATCH and size < BYTES:
                continue
            last = _Groups(held).starts[-1]
            if last:
                yield _Groups(held[:last])
                held, size = held[last:].reset_index(drop=True), 0
    if held is not None and len(held):
        yield _Groups(held)


def _advanced(own: duckdb.DuckDBPyConnection, groups: _Groups, step: np.ndarray, steps: dict, starts: np.ndarray, sides: tuple, build: str, query: str) -> Iterator[pa.RecordBatch]:
    """The ways that the query finds through the groups, with what else is known of each; groups of like lengths go together.

    ``starts`` says for each group and state whether a way may begin there.
    """
    lengths = step[np.append(groups.starts[1:], len(step)) - 1]
    table = pa.table({"key": groups.key, "step": step, **steps})
    heads = groups.rows.iloc[groups.starts]
    about = [pa.array(heads["conv_id"].tolist(), pa.int64(), from_pandas=True), pa.array(heads["stretch"].tolist(), pa.int64())]
    about += [pa.array(side, t) for side, t in zip(sides, (pa.string(), pa.string(), pa.int64()))]
    size = np.ceil(np.log2(lengths)).astype(np.int64)
    for one in np.unique(size):
        own.register("given", table.filter(pa.array((size == one)[groups.key])))
        own.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {build}")
        keys, states = np.nonzero(starts & (size == one)[:, None])
        own.register("starts", pa.table({"key": keys, "state": states.astype(np.int32)}))
        own.register("lengths", pa.table({"key": np.flatnonzero(size == one), "n": lengths[size == one]}))
        found = own.sql(query).to_arrow_table().combine_chunks()
        conv, stretch, first, last, illegal = (x.take(found["key"].combine_chunks()) for x in about)
        columns = [conv, stretch, *(found[c].cast(t) for c, t in (("src", pa.int32()), ("dst", pa.int32()), ("record", pa.string()), ("cost", pa.int64()))), first, last, illegal]
        yield from pa.table(columns, ["conv_id", "stretch", "src", "dst", "record", "cost", "first", "last", "illegal"]).to_batches()


def _ways(rows: DataFrame) -> DataFrame:
    """The cheapest ways through every stretch of the rows of (conv_id, place, initial, fault), by states before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = "SELECT t.key, t.step, m.src, m.dst, m.record, m.cost FROM given t JOIN moves m USING (kind)"
        with _connection() as own:
            for groups in _whole_groups(batches):
                place = groups.rows["place"].to_numpy()
                step = groups.step(place)
                sides = groups.illegal(step, "initial", "initial", np.zeros(len(place)))
                # a stretch that does not begin where stretches are cut has another conversation before it
                starts = ((place[groups.starts] % STRETCH) == 0)[:, None] | (np.array(STATES) == 0)
                yield from _advanced(own, groups, step, {"kind": groups.rows["kind"].tolist()}, starts, sides, build, _ADVANCE)

    initial = F.when(F.col("initial").isin(*"sua"), F.col("initial")).otherwise("?")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.concat(initial, F.lit("t"))).otherwise(initial)
    cut = rows.select("conv_id", F.expr(f"place div {STRETCH}").alias("stretch"), "place", "initial", kind.alias("kind"))
    return cut.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place").mapInArrow(run, _WAYS)


def _joined(ways: DataFrame, ends: bool) -> DataFrame:
    """Ways through runs of stretches from those through each; or, at the end, each conversation's cheapest legal way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connection() as own:
            for groups in _whole_groups(batches):
                rows = groups.rows
                step = groups.step(rows["below"].to_numpy())
                sides = groups.illegal(step, "first", "last", rows["illegal"].to_numpy())
                starts = np.zeros((len(groups.starts), len(STATES)), bool)
                heads = step == 1
                starts[groups.key[heads], 0 if ends else rows["src"].to_numpy()[heads]] = True
                steps = {c: pa.array(rows[c], t) for c, t in (("src", pa.int32()), ("dst", pa.int32()), ("record", pa.string()), ("cost", pa.int64()))}
                yield from _advanced(own, groups, step, steps, starts, sides, "SELECT * FROM given", _ENDED if ends else _ADVANCE)

    upper = F.lit(0).cast("long") if ends else F.expr(f"below div {RUN}")
    cut = ways.withColumnRenamed("stretch", "below").withColumn("stretch", upper)
    return cut.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "below").mapInArrow(run, _WAYS)


def cheapest(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, record, illegal) of every conversation of (conv_id, place, initial, fault)."""
    ways = materialise(_ways(rows))
    while (ways.groupBy("conv_id").agg(F.countDistinct("stretch").alias("n")).agg(F.max("n")).first()[0] or 0) > RUN:
        ways = materialise(_joined(ways, ends=False))
    return _joined(ways, ends=True).select("conv_id", "cost", "record", "illegal")


# -- the repaired conversation


class _Repair:
    """Follows a record through a conversation's rows and hashes what stays."""

    def __init__(self, record: str):
        self.record, self.at, self.state = record, 0, 0
        self.hash, self.begun = hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.begun = True
        self.state = _NEXT[self.state, role[0]]

    def _due(self) -> str:
        return next(role for c, role in _ROLES.items() if (self.state, c) in _NEXT)

    def _insertions(self) -> None:
        while self.record[self.at : self.at + 1] == "I":
            self._line(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.record[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._due(), text)

    def digest(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


def repaired(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(conv_id, record, cost, illegal, repaired_sha256): each conversation's rows stream by after its record, none is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        repair = None
        for batch in batches:
            out = []
            for head, conv, cost, record, illegal, role, text in zip(*(batch.column(c).to_pylist() for c in ("head", "conv_id", "cost", "record", "illegal", "role", "text"))):
                if head:
                    if repair:
                        out.append((*now, repair.digest()))
                    now, repair = (conv, record, cost, illegal), _Repair(record)
                else:
                    repair.row(role, text)
            yield made(out)
        if repair:
            yield made([(*now, repair.digest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "record", "cost", "illegal", "repaired_sha256"])

    heads = records.withColumn("head", F.lit(True))
    both = rows.withColumn("head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    both = both.select("head", "conv_id", "cost", "record", "illegal", "turn", "role", "text")
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, "conv_id long, record string, cost long, illegal long, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of (conv_id, turn, role, text): its faults after damage, the cheapest edits, the repaired hash.

    A null conv_id is a conversation of its own. Rows of one turn stand in order of role and text; repeated rows are duplicates.
    A role whose initial is none of s, u, a, an empty one too, can't stay as it is. A conversation all of whose rows are dropped
    has zeros, an empty audit and the hash of an empty text. Other columns are not read.
    """
    rows = damage(conversations)
    found = materialise(faults(ordered(rows)))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = found.groupBy("conv_id", "turn").agg(*(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")))
    counts = counts.groupBy("conv_id").agg(gaps, *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    edits = repaired(rows, materialise(cheapest(found)))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.alias("e").join(counts.alias("c"), F.expr("e.conv_id <=> c.conv_id"), "left").join(edits.alias("r"), F.expr("e.conv_id <=> r.conv_id"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("e.conv_id", *zero, F.coalesce("record", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
