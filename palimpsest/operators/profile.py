"""Profiles: fields with their types and counts, terms, and versions with their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def terms(docs: DataFrame, column: str) -> DataFrame:
    """(value, count) of a column, in the order of values; of a list, each distinct value once a row."""
    many = dict(docs.dtypes)[column].startswith("array")
    values = docs.select(F.explode(F.array_distinct(column)).alias("value") if many else F.col(column).alias("value"))
    return values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("count")).orderBy("value")


def fields(docs: DataFrame, column: str = "data_types", weight: str | None = None) -> DataFrame:
    """(path, tag, count, tag_count): rows of a path's tags. A combination of tags counts once for its path and once for
    each of its tags; a row that stands for several documents has their number in ``weight``."""
    number = F.sum(weight) if weight else F.count("*")
    return of_combinations(docs.select(F.explode(F.array_distinct(column)).alias("x"), *([weight] if weight else [])).groupBy("x").agg(number.alias("n")))


def of_combinations(combos: DataFrame) -> DataFrame:
    """``fields`` from the numbers (x, n) of each path's combinations of tags. What they are made of is read once: a path's
    combinations, of six tags at most, are put together and dealt out to their tags."""
    parts = combos.select(F.regexp_extract("x", r"^(.*)\.([^.]*)$", 1).alias("path"), F.split(F.regexp_extract("x", r"^(.*)\.([^.]*)$", 2), ",").alias("tags"), "n")
    paths = parts.groupBy("path").agg(F.sum("n").alias("count"), F.collect_list(F.struct("tags", "n")).alias("own"))
    tags = paths.select("path", "count", F.explode("own").alias("x")).select("path", "count", F.explode("x.tags").alias("tag"), "x.n")
    return tags.groupBy("path", "count", "tag").agg(F.sum("n").alias("tag_count")).select("path", "tag", "count", "tag_count")


def _linked(profile: DataFrame) -> DataFrame:
    """(path, container, own, within): a place of the hierarchy, whether a profile's field there is a container, the field itself if
    it has none around it, and the fields one part longer below; a field is (path, count, entries). The profile is read once, so
    what it is made of is not made again for each side of a join."""
    entries = F.array_sort(F.collect_list(F.struct("tag", "tag_count"))).alias("entries")
    rows = profile.groupBy("path", "count").agg(entries)
    around = F.when(F.instr("path", ".") > 0, F.regexp_extract("path", r"^(.*)\.[^.]*$", 1))
    field, container = F.struct("path", "count", "entries"), F.exists("entries", lambda x: x["tag"].isin("#d", "#l"))
    below = F.struct(around.alias("at"), F.when(around.isNull(), F.col("path")).alias("top"), F.lit(False).alias("container"), field.alias("field"))
    itself = F.struct(F.col("path").alias("at"), F.lit(None).cast("string").alias("top"), container.alias("container"), F.lit(None).cast(rows.select(field).dtypes[0][1]).alias("field"))
    return rows.select(F.explode(F.array(below, itself)).alias("x")).select("x.*").groupBy("at", "top").agg(F.bool_or("container").alias("container"), F.collect_list("field").alias("fields"))


def listed(profile: DataFrame) -> DataFrame:
    """(path, count, types, parent) of a profile's fields, the most frequent first, then by path. ``types`` maps tags to their
    counts; ``parent`` is the container around a path, or null."""
    found = _linked(profile).select(F.when(F.col("container"), F.col("at")).alias("parent"), F.explode("fields").alias("x"))
    return found.select("x.path", "x.count", F.map_from_entries("x.entries").alias("types"), "parent").orderBy(F.desc("count"), "path")


def described(profile: DataFrame) -> DataFrame:
    """``listed`` with what a field is: parsed_path (without the empty parts that stand for lists), is_list_element, is_container,
    and its children in order."""
    linked, none = _linked(profile), lambda kind: F.lit(None).cast(kind)
    parent, inner = F.when(F.col("container"), F.col("at")), F.array_sort(F.transform("fields", lambda x: x["path"]))
    kind = dict(linked.dtypes)["fields"][len("array<") : -1]
    fields = F.transform("fields", lambda x: F.struct(x["path"].alias("path"), x.alias("field"), parent.alias("parent"), none("array<string>").alias("children")))
    held = F.when(F.col("container"), F.array(F.struct(F.col("at").alias("path"), none(kind).alias("field"), none("string").alias("parent"), inner.alias("children"))))
    both = linked.select(F.explode(F.concat(fields, F.coalesce(held, F.slice(fields, 1, 0)))).alias("x")).select("x.*")
    merged = both.groupBy("path").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("field", "parent", "children")]).where("field IS NOT NULL")
    parsed = F.regexp_replace(F.regexp_replace("path", r"\.+", "."), r"\.$", "")
    container = F.exists(F.map_keys("types"), lambda tag: tag.isin("#d", "#l"))
    rows = merged.select("path", "field.count", F.map_from_entries("field.entries").alias("types"), "parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    return rows.withColumns({"parsed_path": parsed, "is_list_element": F.col("path").endswith("."), "is_container": container}).orderBy(F.desc("count"), "path")


def hierarchy(profile: DataFrame) -> DataFrame:
    """(parent, child) of paths in a profile: a container and the paths one part longer below it."""
    return _linked(profile).where("container").select(F.col("at").alias("parent"), F.explode("fields").alias("x")).select("parent", F.col("x.path").alias("child"))


def changed_counts(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(version, count). Ends of intervals take the place of the beginnings at the same version, so that a version's count is
    that of updates and deletions if it has any; with ``exact`` it is that of all its changes."""
    starts = docs.groupBy("version").agg(F.count("*").alias("starts"))
    ends = docs.where("next IS NOT NULL").groupBy(F.col("next").alias("version")).agg(F.count("*").alias("ends"))
    if exact:
        ids = docs.select("id", "version").union(docs.where("next IS NOT NULL").select("id", "next")).distinct()
        return ids.groupBy("version").agg(F.count("*").alias("count"))
    return starts.join(ends, "version", "full").select("version", F.coalesce("ends", "starts").alias("count"))


def versions(docs: DataFrame) -> DataFrame:
    return docs.select("version").union(docs.select("next")).where("version IS NOT NULL").distinct()


def rounded(docs: DataFrame, version: int) -> DataFrame:
    """The largest version that is not above the given one, or null."""
    return versions(docs).where(F.col("version") <= version).agg(F.max("version").alias("version"))


def indexed_version(docs: DataFrame) -> DataFrame:
    return docs.agg(F.greatest(F.max("version"), F.max("next")).alias("version"))


#: Counts that a sync adds for what it has changed: ``starts`` and ``ends`` at a version of documents (kind ``docs``), and of a
#: path's combination of tags in them (``data_types``, ``parsed_types``); for kind ``ids``, records that changed at it.
SUMMARY = "version bigint, kind string, x string, starts bigint, ends bigint"


def summary(docs: DataFrame, after: int | None) -> DataFrame:
    """The counts of documents that begin or end after a version. What begins or ends up to it has been counted before: a later
    sync adds to the sums and takes away from them, and none is ever changed."""
    of_kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))
    lists = F.concat(*[F.transform(F.array_distinct(kind), of_kind(kind)) for kind in ("data_types", "parsed_types")])
    each = F.concat(F.array(F.struct(F.lit("docs").alias("kind"), F.lit("").alias("x"))), lists)
    edges = F.array(*[F.struct(F.col(c).alias("version"), F.lit(1 - k).alias("starts"), F.lit(k).alias("ends")) for k, c in enumerate(("version", "next"))])
    new = lambda e: e["version"].isNotNull() & (F.lit(after is None) | (e["version"] > (after or 0)))
    rows = docs.select(F.col("id"), each.alias("each"), F.explode(F.filter(edges, new)).alias("e")).select("id", "each", "e.*")
    counted = rows.select("version", "starts", "ends", F.explode("each").alias("k")).select("version", "k.kind", "k.x", "starts", "ends")
    ids = rows.select("id", "version").distinct().select("version", F.lit("ids").alias("kind"), F.lit("").alias("x"), F.lit(1).alias("starts"), F.lit(0).alias("ends"))
    return counted.unionByName(ids).groupBy("version", "kind", "x").agg(F.sum("starts").cast("bigint").alias("starts"), F.sum("ends").cast("bigint").alias("ends"))


def summed_fields(sums: DataFrame, kind: str, at: int | str | None = None) -> DataFrame:
    """``fields`` of the documents that hold as of a version (None: now; ``all``: of every document), from the sums alone."""
    own = sums.where(F.col("kind") == kind)
    if isinstance(at, int):
        own = own.where(F.col("version") <= at)
    n = F.sum("starts") if at == "all" else F.sum(F.col("starts") - F.col("ends"))
    return of_combinations(own.groupBy("x").agg(n.alias("n")).where("n > 0"))


def summed_changes(sums: DataFrame, exact: bool = False) -> DataFrame:
    """``changed_counts`` from the sums."""
    own = sums.where(F.col("kind") == ("ids" if exact else "docs")).groupBy("version").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    return own.select("version", F.when(F.col("ends") > 0, F.col("ends")).otherwise(F.col("starts")).alias("count"))


class TermPages:
    """A column's terms and their counts in the order of terms, a page at a time: each asks for what comes after the last one's
    key, so no page holds more than its size and none is counted again.

    The terms are written once, sorted, and a page's scan passes over the files that end before its key.
    """

    def __init__(self, docs: DataFrame, column: str, path: str, size: int = 50):
        found = terms(docs, column)
        found.write.option("compression", "zstd").parquet(path)
        self.table, self.size = docs.sparkSession.read.schema(found.schema).parquet(path), size

    def after(self, key=None) -> list:
        """The next rows (value, count) behind a key, or the first ones."""
        rest = self.table if key is None else self.table.where(F.col("value") > F.lit(key))
        return rest.orderBy("value").limit(self.size).collect()

    def __iter__(self):
        page = self.after()
        while page:
            yield page
            page = self.after(page[-1]["value"]) if len(page) == self.size else []
