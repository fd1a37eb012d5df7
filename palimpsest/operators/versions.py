"""Folding of data and options histories into intervals of validity ``[version, next)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def intervals(history: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """``history`` with ``next``: the version at which a row's state ends, null for the current one."""
    return history.withColumn("next", F.lead(version).over(W.partitionBy(key).orderBy(version)))


def grid(history: DataFrame, options: DataFrame, strict: bool = False) -> DataFrame:
    """(id, version, data, option): every moment at which a record's data or the options change, both carried forward.

    ``history`` is (id, version, data), null data for a deletion; ``options`` is (version, option), a small table with a row
    for each commit of options. Moments begin with a record's first data, for which the earliest options ever hold; with
    ``strict`` those in force then.
    """
    known = options.select("version", "option").orderBy("version").collect()  # a row for each commit of options
    kind = dict(options.dtypes)["option"]
    points = F.array(*[F.struct(F.lit(v).cast("bigint").alias("at"), F.lit(x).cast(kind).alias("option")) for v, x in known])
    # Moments of options come with a record's first row, so all below is done within one shuffle by id.
    first = F.col("version")
    later = F.filter(points, lambda x: x["at"] >= first)
    if strict:  # those in force at the first data count from there on
        before = F.filter(points, lambda x: x["at"] < first)
        held = F.transform(F.slice(before, -1, 1), lambda x: F.struct(first.alias("at"), x["option"].alias("option")))
        later = F.when((F.size(before) > 0) & ~F.exists(later, lambda x: x["at"] == first), F.concat(held, later)).otherwise(later)
    by_id = W.partitionBy("id").orderBy("version")
    data = dict(history.dtypes)["data"]
    state, none = f"struct<data:{data}>", lambda t: F.lit(None).cast(t)
    own = F.array(F.struct(F.col("version"), F.struct("data").cast(state).alias("state"), none(kind).alias("option")))
    moments = F.transform(F.when(F.col("n") == 1, later).otherwise(F.slice(points, 1, 0)), lambda x: F.struct(x["at"].alias("version"), none(state).alias("state"), x["option"].alias("option")))
    rows = history.select("id", "version", "data", F.row_number().over(by_id).alias("n")).select("id", F.explode(F.concat(own, moments)).alias("x")).select("id", "x.*")
    merged = rows.groupBy("id", "version").agg(F.first("state", ignorenulls=True).alias("state"), F.first("option", ignorenulls=True).alias("option"))
    w = by_id.rowsBetween(W.unboundedPreceding, 0)
    carried = merged.select("id", "version", F.last("state", ignorenulls=True).over(w).alias("state"), F.last("option", ignorenulls=True).over(w).alias("option"))
    return carried.select("id", "version", F.col("state.data").alias("data"), F.coalesce("option", F.lit(known[0]["option"]).cast(kind)).alias("option"))


def fold(history: DataFrame, options: DataFrame, parse: Callable[[DataFrame], DataFrame], strict: bool = False) -> DataFrame:
    """Intervals of distinct parsed states: (id, version, next, data, parsed).

    ``parse`` adds ``parsed``, a comparable column, to rows of (id, version, data, option); it is null where data is null.
    It may add ``state`` too, by which equal states are known. A moment counts only if its parsed state differs from the one
    before; a deletion closes the last interval.
    """
    parsed = parse(grid(history, options, strict))
    w, known = W.partitionBy("id").orderBy("version"), "state" if "state" in parsed.columns else "parsed"
    changed = parsed.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag(known).over(w))
    changed = changed.where((F.col("n") == 1) | ~F.col(known).eqNullSafe(F.col("before")))
    return changed.withColumn("next", F.lead("version").over(w)).where("parsed IS NOT NULL").select("id", "version", "next", "data", "parsed")


def as_of(docs: DataFrame, version: int) -> DataFrame:
    return docs.where((F.col("version") <= version) & (F.col("next").isNull() | (F.col("next") > version)))


def latest(docs: DataFrame) -> DataFrame:
    return docs.where("next IS NULL")


def of_versions(databases: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Rows of several databases, each as of its own version, with the column ``name``."""
    parts = [as_of(docs, version).withColumn("name", F.lit(name)) for name, (docs, version) in databases.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stabbed(docs: DataFrame, asked: DataFrame, name: str = "name") -> DataFrame:
    """Documents (name, version, next, ..) of many databases as of many versions: ``asked`` is (name, at). Rows have ``at`` too.

    A join on ranges would compare every document with every version of its database. Versions fall into bins, about as many as
    a database has versions asked for; a document goes to the bins that its interval reaches into and that hold one, and meets
    the versions there.
    """
    wanted = asked.select(F.col(name).alias("own"), F.col("at").cast("bigint").alias("at")).where("at IS NOT NULL").distinct()
    spans = wanted.groupBy("own").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
    spans = spans.withColumn("width", F.expr("(high - low) div n + 1"))
    binned = wanted.join(spans, "own").select("own", "at", F.expr("(at - low) div width").alias("bin"))
    rows = docs.select(F.col(name).alias("own"), F.struct(*docs.columns).alias("doc"))
    first = F.greatest(F.col("doc.version"), F.col("low"))
    last = F.least(F.coalesce(F.col("doc.next") - 1, F.col("high")), F.col("high"))
    reach = rows.join(spans, "own").where(first <= last).select("own", "doc", F.explode(F.sequence(F.call_function("div", first - F.col("low"), F.col("width")), F.call_function("div", last - F.col("low"), F.col("width")))).alias("bin"))
    found = reach.join(binned, ["own", "bin"]).where((F.col("doc.version") <= F.col("at")) & (F.col("doc.next").isNull() | (F.col("at") < F.col("doc.next"))))
    return found.select("doc.*", "at")


def serialised(ops: DataFrame, index: str) -> DataFrame:
    """(id, version, line): index operations (op, id, version, data as JSON) as lines of JSON, an action and, to index, the
    document, for a store that takes such lines in bulk."""
    name = F.concat_ws(":", "id", "version")
    action = F.to_json(F.struct(F.lit(index).alias("_index"), name.alias("_id")))
    document = F.concat(F.lit('{"id":'), F.to_json(F.struct("id")).substr(F.lit(7), F.length(F.to_json(F.struct("id"))) - 7), F.lit(',"version":'), F.col("version").cast("string"), F.lit(',"data":'), F.coalesce("data", F.lit("null")), F.lit("}"))
    line = F.when(F.col("op") == "index", F.concat(F.lit('{"index":'), action, F.lit("}\n"), document)).otherwise(F.concat(F.lit('{"delete":'), action, F.lit("}")))
    return ops.select("id", "version", line.alias("line"))


def changed_since(docs: DataFrame, after: int | None) -> DataFrame:
    """Index operations since a sync at ``after``: op (index or delete), id, version, next.

    Newer intervals and the one that was open at ``after`` are written; if that was closed without a successor that is
    open, its record leaves the latest tier.
    """
    if after is None:
        return docs.select(F.lit("index").alias("op"), "id", "version", "next")
    touched = docs.where((F.col("version") > after) | (F.col("next") > after))
    gone = touched.groupBy("id").agg(F.max("next").alias("version"), F.bool_or(F.col("next").isNull()).alias("open"), F.min("version").alias("first"))
    gone = gone.where(f"NOT open AND first <= {after}").select(F.lit("delete").alias("op"), "id", "version", F.lit(None).cast("bigint").alias("next"))
    return touched.select(F.lit("index").alias("op"), "id", "version", "next").unionByName(gone)
