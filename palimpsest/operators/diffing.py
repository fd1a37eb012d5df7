"""Differences of nested documents, and their application; natively for flat ones."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def diff(base: dict, new: dict) -> list[tuple[tuple, dict]]:
    """(path, changes) of each container that differs, outer ones first.

    Changes of objects: dn new, dd deleted, dc changed; of lists: lc changed, ln appended, ld first place cut off.
    Containers of one kind are compared within; equal is what Python calls equal.
    """
    if not (isinstance(base, dict) and isinstance(new, dict)):
        raise TypeError("both sides must be objects")
    out, todo = [], [((), base, new)]
    while todo:
        path, left, right = todo.pop(0)
        changes: dict = {}
        if isinstance(left, dict):
            pairs = [(k, left[k], right[k]) for k in left if k in right]
            gone, added = [k for k in left if k not in right], {k: v for k, v in right.items() if k not in left}
            changes |= ({"dn": added} if added else {}) | ({"dd": gone} if gone else {})
        else:
            pairs = [(i, a, b) for i, (a, b) in enumerate(zip(left, right))]
            if len(right) > len(left):
                changes["ln"] = right[len(left) :]
            elif len(right) < len(left):
                changes["ld"] = len(right)
        other = []
        for key, a, b in pairs:
            if a != b:
                if any(isinstance(a, kind) and isinstance(b, kind) for kind in (dict, list)):
                    todo.append(((*path, key), a, b))
                else:
                    other.append((key, b))
        if other:
            changes |= {"dc": dict(other)} if isinstance(left, dict) else {"lc": other}
        if changes:
            out.append((path, changes))
    return out


def patch(base: dict, ops) -> dict:
    """``base`` with the changes made, itself untouched."""

    def applied(value, path, changes):
        value = value.copy()
        if path:
            value[path[0]] = applied(value[path[0]], path[1:], changes)
            return value
        if isinstance(value, dict):
            value.update(changes.get("dc", {}))
            value.update(changes.get("dn", {}))
            return {k: v for k, v in value.items() if k not in set(changes.get("dd", ()))}
        for i, v in changes.get("lc", ()):
            value[i] = v
        value += changes.get("ln", [])
        return value[: changes["ld"]] if "ld" in changes else value

    for path, changes in ops:
        base = applied(base, tuple(path), changes)
    return base


@F.pandas_udf(T.StringType())
def diff_json(base: pd.Series, new: pd.Series) -> pd.Series:
    """The differences of two JSON objects as JSON: a list of [path, changes]."""
    return pd.Series([None if a is None or b is None else json.dumps(diff(json.loads(a), json.loads(b))) for a, b in zip(base, new)], dtype=object)


@F.pandas_udf(T.StringType())
def patch_json(base: pd.Series, ops: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else json.dumps(patch(json.loads(a), json.loads(b))) for a, b in zip(base, ops)], dtype=object)


def diff_flat(base: Column, new: Column) -> Column:
    """Differences of two maps of plain values: names of new, deleted and changed keys, each in order."""
    shared = F.array_intersect(F.map_keys(base), F.map_keys(new))
    return F.struct(
        F.array_sort(F.array_except(F.map_keys(new), F.map_keys(base))).alias("dn"),
        F.array_sort(F.array_except(F.map_keys(base), F.map_keys(new))).alias("dd"),
        F.array_sort(F.filter(shared, lambda k: ~base[k].eqNullSafe(new[k]))).alias("dc"),
    )


#: A full state is kept at least after so many differences.
EVERY = 16


def compressed(history: DataFrame, every: int = EVERY) -> DataFrame:
    """(id, version, run, place, data, ops) of a history (id, version, data): a record's newest state in full, older ones as the
    changes that lead back to them from the next newer one, and each ``every``-th in full again.

    A run is a full state and the differences behind it, so no state needs more than ``every`` patches, and a record with very
    many states is rebuilt run by run. A deletion (null data), and a state next to one, has no differences: it stays as it is.
    """
    newest = W.partitionBy("id").orderBy(F.desc("version"))
    rows = history.select("id", "version", "data", (F.row_number().over(newest) - 1).alias("n"), F.lag("data").over(newest).alias("newer"))
    rows = rows.select("id", "version", "data", "newer", F.expr(f"n div {every}").alias("run"), (F.col("n") % every).cast("int").alias("place"))
    back = (F.col("place") > 0) & F.col("data").isNotNull() & F.col("newer").isNotNull()
    ops = F.when(back, diff_json(F.when(back, F.col("newer")), F.col("data")))
    return rows.select("id", "version", "run", "place", F.when(~back, F.col("data")).alias("data"), ops.alias("ops"))


def restored(stored: DataFrame) -> DataFrame:
    """The history (id, version, data) that ``compressed`` has stored: each run is folded from its full state on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for rows in batches:
            out = []
            for data, ops in rows[["data", "ops"]].itertuples(index=False):  # a run's first row holds a state
                state = patch(state, json.loads(ops)) if isinstance(ops, str) else json.loads(data) if isinstance(data, str) else None
                out.append(None if state is None else json.dumps(state, ensure_ascii=False))
            yield pd.DataFrame({"id": rows["id"], "version": rows["version"], "data": pd.Series(out, rows.index, dtype=object)})

    dealt = stored.repartition("id", "run").sortWithinPartitions("id", "run", "place")
    return dealt.select("id", "version", "data", "ops").mapInPandas(run, "id string, version bigint, data string")
