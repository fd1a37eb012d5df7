"""What a batch of records does to a store: its operation on each id, as one plan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.values import identity, prepare
from palimpsest.operators.parsing import spread

_JSON = json.JSONEncoder(ensure_ascii=False).encode


@F.pandas_udf(T.StructType([T.StructField("data", T.StringType()), T.StructField("same", T.StringType())]))
def prepared(ids: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Sanitised data with its record's id as ``_id`` (null for a deletion), and the text by which equal data is known."""
    out = []
    for own, x in zip(ids, data):
        value = prepare(json.loads(x)) if isinstance(x, str) and x else {}
        value = {**value, "_id": own} if value else None
        out.append((_JSON(value), identity(value)) if value else (None, "{}"))
    return pd.DataFrame(out, columns=["data", "same"])


@F.pandas_udf(T.StructType([T.StructField("data", T.StringType()), T.StructField("same", T.StringType()), T.StructField("reason", T.StringType())]))
def checked(ids: pd.Series, data: pd.Series) -> pd.DataFrame:
    """What ``prepared`` gives, with the reason why a row is no record: it has no id, or its data is not one JSON object."""
    out = []
    for own, x in zip(ids, data):
        try:
            value = json.loads(x) if isinstance(x, str) and x else {}
            reason = None if isinstance(value, dict) else f"no object but {type(value).__name__}"
            value = prepare(value) if reason is None else {}
        except (ValueError, RecursionError) as error:
            value, reason = {}, f"malformed JSON: {str(error).split(':')[0]}"
        if not isinstance(own, str):
            reason = reason or "no id"
        value = {**value, "_id": own} if value and reason is None else None
        out.append((_JSON(value), identity(value), None) if value else (None, "{}", reason))
    return pd.DataFrame(out, columns=["data", "same", "reason"])


@F.pandas_udf(T.BooleanType())
def same_without(data: pd.Series, old: pd.Series, name: pd.Series) -> pd.Series:
    """Whether two records both have a top-level field and differ in that field at most."""

    def same(x, y, field) -> bool:
        if not isinstance(x, str) or not isinstance(y, str):
            return False
        x, y = json.loads(x), json.loads(y)
        if field not in x or field not in y:
            return False
        left, right = (identity({k: v for k, v in z.items() if k != field}) for z in (x, y))
        return left is not None and left == right

    return pd.Series([same(x, y, field) for x, y, field in zip(data, old, name)])


def last_wins(records: DataFrame, order: str = "seq") -> DataFrame:
    """One row per id, the last in order."""
    others = [c for c in records.columns if c != "id"]
    return records.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("x")).select("id", *[F.col(f"x.{c}").alias(c) for c in others])


def received(records: DataFrame) -> DataFrame:
    """(id, data, same, raw, reason) of records (id, data as JSON, seq): one row an id, the last that is sound; and each different
    row that is not, as it came."""
    own = spread(records.select(F.col("id").cast("string").alias("id"), F.col("data").cast("string").alias("raw"), "seq"))
    rows = own.select("id", "raw", "seq", checked("id", "raw").alias("x")).select("id", "seq", "x.*", F.when(F.col("x.reason").isNotNull(), F.col("raw")).alias("raw"))
    return rows.groupBy("id", "reason", "raw").agg(F.max_by(F.struct("data", "same"), "seq").alias("x")).select("id", "x.data", "x.same", "raw", "reason")


def classify(batch: DataFrame, committed: DataFrame, staged: DataFrame, modified_field: str | None = None) -> DataFrame:
    """(id, data, same, op) of a batch (id, data, same; null data deletes) against the committed and the uncommitted state.

    Ops: insert, update (a deletion of a committed record too), delete (a never committed one goes), revert (an uncommitted
    change is taken back). A row that changes nothing is left out. With ``modified_field`` a change of that top-level field
    alone is none.
    """
    old = committed.select("id", F.col("data").alias("old_data"), F.col("same").alias("old_same"), F.lit(True).alias("has_old"))
    new = staged.select("id", F.col("same").alias("staged_same"), F.lit(True).alias("has_staged"))
    joined = batch.join(old, "id", "left").join(new, "id", "left")
    equal = F.col("same").isNotNull() & F.col("same").eqNullSafe(F.col("old_same"))
    if modified_field is not None:
        equal = equal | same_without(F.col("data"), F.col("old_data"), F.lit(modified_field))
    op = (
        F.when(F.col("has_old") & equal, F.when(F.col("has_staged"), "revert"))
        .when(F.col("has_old"), "update")
        .when(F.col("has_staged"), F.when(F.col("data").isNull(), "delete").when(F.coalesce(F.col("same") == F.col("staged_same"), F.lit(False)), None).otherwise("update"))
        .when(F.col("data").isNotNull(), "insert")
    )
    return joined.withColumn("op", op).where("op IS NOT NULL").select("id", "data", "same", "op")
