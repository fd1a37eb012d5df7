"""A named database of versioned records: ingest, commit, roll back, sync into tiers, search and profile."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.values import now as clock
from palimpsest.functions.values import prepare
from palimpsest.operators import cells, profile, versions, words
from palimpsest.operators import ingest as merging
from palimpsest.operators.options import ParsingOptions
from palimpsest.operators.parsing import LEAF, PARSED, parse_documents
from palimpsest.operators.search import Search, Tables, leaf_rows
from palimpsest.plans import tiers
from palimpsest.sources.store import Buckets, Conflict, Folder, Layers, Locks, Runs, WriteError

HISTORY = "id string, version bigint, data string, same string"
STAGED = "id string, data string, same string, committed boolean"
RECEIVED = "id string, data string, same string, raw string, reason string"
REJECTS = "id string, raw string, reason string"
FOLDED = f"id string, version bigint, next bigint, data string, {PARSED}"
DOCS = f"{FOLDED}, tier string, arc int"
LEAVES = "id string, version bigint, " + LEAF[len("struct<") : -1].replace(":", " ")
ENDS = "id string, version bigint, next bigint"
DOC_COLUMNS = [c.split(" ")[0] for c in ("id", "version", "next", "data", "data_types", "parsed_types", "leaves")]
#: What a sync derives from the documents that it writes, how each is dealt and sorted, and its schema.
DERIVED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "leaves": (LEAVES, lambda x: x.repartitionByRange("path", "k", "id").sortWithinPartitions("path", "k", "n")),
    "postings": (words.POSTINGS, words.by_token),
    "words": (words.WORDS, words.by_word),
    "cells": (cells.CELLS, cells.by_cell),
    "ends": (ENDS, lambda x: x.repartitionByRange("id").sortWithinPartitions("id")),
    "summary": (profile.SUMMARY, lambda x: x.coalesce(1)),
}


#: How often a batch is merged if others change what it is compared with.
ATTEMPTS = 5


@dataclass(frozen=True)
class IngestResult:
    version: int | None
    inserted: int
    updated: int
    deleted: int
    rejected: int = 0

    @property
    def was_committed(self) -> bool:
        return self.version is not None


@dataclass(frozen=True)
class WriteResult:
    indexed: int
    deleted: int
    tiers: dict[str, int]

    @property
    def total(self) -> int:
        return self.indexed + self.deleted


class Engine:
    """Databases under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def database(self, name: str, now: Callable[[], int] = clock) -> Database:
        return Database(self, name, now)


class Database:
    def __init__(self, engine: Engine, name: str, now: Callable[[], int] = clock):
        self.spark, self.name, self.now = engine.spark, name, now
        self.folder = Folder(engine.spark, f"{engine.root}/{name}")
        self.locks = Locks(self.folder)

    # -- state: the history of all commits, the present state of every record, and what is not committed

    def _layers(self, what: str, schema: str, manifest: dict | None = None) -> Layers:
        return Layers(self.folder, (self.folder.manifest() if manifest is None else manifest).get(what), schema)

    def _staged(self, manifest: dict | None = None) -> Layers:
        return self._layers("staged", STAGED, manifest)

    def _current(self, manifest: dict | None = None) -> Layers:
        return self._layers("current", HISTORY, manifest)

    def _latest(self, manifest: dict | None = None) -> Layers:
        return self._layers("latest", DOCS, manifest)

    def _history(self, manifest: dict | None = None) -> Runs:
        return self._runs("history", HISTORY, manifest)

    def _runs(self, what: str, schema: str | None = None, manifest: dict | None = None) -> Runs:
        return Runs(self.folder, (self.folder.manifest() if manifest is None else manifest).get(what), schema or DERIVED[what][0])

    def _archives(self, manifest: dict | None = None) -> DataFrame:
        return self.folder.parts((self.folder.manifest() if manifest is None else manifest).get("arcs", []), DOCS)

    def _docs(self) -> DataFrame:
        manifest = self.folder.manifest()
        return self._latest(manifest).rows().unionByName(self._archives(manifest))

    def tables(self) -> Tables:
        """What conditions are looked up in, of the documents in any tier."""
        manifest = self.folder.manifest()
        return Tables(*[self._runs(what, manifest=manifest).rows() for what in ("leaves", "postings", "cells", "ends")], self.dictionary)

    def dictionary(self) -> DataFrame:
        """The pieces of all words, by which words some edits away are found: made when first asked for, and then of new words alone."""
        manifest = self.folder.manifest()
        made = manifest.get("pieces_to", -1)
        if any(t["newest"] > made for t in manifest.get("words", [])):
            with self.locks.lock("sync", name=self.name):
                before = manifest = self.folder.manifest()
                new = self._runs("words", manifest=manifest).rows(after=made)
                name, seen = self.folder.write_counted(words.by_piece(words.terms(new)), n=F.count(F.lit(1)))
                terms = self._runs("pieces", words.TERMS, manifest).add(name, seen["n"] or 0).compacted(words.by_piece)
                manifest = {**manifest, "pieces": terms.tables, "pieces_to": max(t["newest"] for t in manifest["words"])}
                self.folder.change(before, manifest)
        return self._runs("pieces", words.TERMS, manifest).rows()

    def records(self) -> DataFrame:
        """(id, version, data) of the current state; an uncommitted one has no version, a deleted one no data."""
        manifest = self.folder.manifest()
        staged = self._staged(manifest).rows().select("id", F.lit(None).cast("bigint").alias("version"), "data")
        return self._current(manifest).rows().select("id", "version", "data").join(staged.select("id"), "id", "left_anti").unionByName(staged)

    def history(self) -> DataFrame:
        return self._history().rows().select("id", "version", "data")

    def rejects(self) -> DataFrame:
        """(id, raw, reason) of the rows that no ingest could take."""
        return self._runs("rejects", REJECTS).rows()

    def has_data(self) -> bool:
        """Whether any record is committed."""
        return bool(self.folder.manifest().get("history"))

    def has_options(self) -> bool:
        """Whether any options are committed."""
        return bool(self.folder.manifest().get("options"))

    def has_uncommitted_data(self) -> bool:
        return any(t["kept"] for t in self._staged().deltas) and bool(self._staged().rows().take(1))

    def has_uncommitted_options(self) -> bool:
        return bool(self.folder.manifest().get("pending_options"))

    def options(self, include_uncommitted: bool = False) -> dict[int | None, ParsingOptions]:
        manifest = self.folder.manifest()
        out = {x["version"]: ParsingOptions.from_doc(x["options"]) for x in manifest.get("options", [])}
        pending = manifest.get("pending_options")
        return {None: ParsingOptions.from_doc(pending), **out} if include_uncommitted and pending else out

    def committed_version(self) -> int | None:
        return self._committed(self.folder.manifest())

    @staticmethod
    def _committed(manifest: dict) -> int | None:
        found = [x["version"] for x in manifest.get("options", [])] + ([manifest["data_version"]] if "data_version" in manifest else [])
        return max(found, default=None)

    # -- changes

    def frame(self, records: Iterable[tuple[str, dict | None]]) -> DataFrame:
        """(id, data, seq) of records in order; None or an empty object deletes."""
        rows = [(i, json.dumps(prepare(x)) if x else None, n) for n, (i, x) in enumerate(records)]
        return self.spark.createDataFrame(rows, "id string, data string, seq bigint")

    def ingest(self, records: DataFrame, commit: bool = True, modified_field: str | None = None) -> IngestResult:
        """Merge (id, data as JSON, seq); of one id the last row counts. Empty data deletes.

        The batch is written once, and what it changes once more; a row that is no record (no id, malformed JSON, no object) goes
        to ``rejects()`` and does not keep the others from landing. If someone else has changed what the batch was compared with,
        it is merged again.
        """
        for attempt in range(ATTEMPTS):
            try:
                found = self._ingest(records, modified_field)
                break
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        return replace(found, version=self.commit()) if commit else found

    def _ingest(self, records: DataFrame, modified_field: str | None) -> IngestResult:
        before = manifest = self.folder.manifest()
        bad = F.col("reason").isNotNull()
        name, seen = self.folder.write_counted(
            merging.received(records.select("id", "data", "seq")), n=F.count_if(~bad), bad=F.count_if(bad), gone=F.count_if(~bad & F.col("data").isNull())
        )
        n, rejected = seen["n"] or 0, seen["bad"] or 0
        batch = self.folder.table([name], RECEIVED).where("reason IS NULL").select("id", "data", "same")
        out, counts = dict(manifest), {"insert": 0, "update": 0, "delete": 0, "revert": 0}
        if rejected:
            bad_rows = self.folder.write(self.folder.table([name], RECEIVED).where("reason IS NOT NULL").select("id", "raw", "reason"))
            out["rejects"] = self._runs("rejects", REJECTS, manifest).add(bad_rows, rejected).tables
        current, staged = self._current(manifest), self._staged(manifest)
        if n and current.empty and staged.empty and not rejected and not seen["gone"]:  # nothing to compare with: the batch is the change
            counts["insert"] = n
            out["staged"] = staged.add(name, n, kept=n, fresh=n).entry
        elif n:
            ids = batch.select("id")
            within = Buckets.of(batch, manifest["buckets"]) if current.base else None
            old = current.rows(ids, within)
            ops = merging.classify(batch, old, staged.rows(ids), modified_field).join(old.select("id", F.lit(True).alias("committed")), "id", "left")
            gone, op = F.col("op").isin("delete", "revert"), F.col("op")
            made = ops.select("id", "data", "same", F.coalesce("committed", F.lit(False)).alias("committed"), gone.alias("gone"), "op")
            fresh = ~F.col("committed") & ~F.col("gone")
            change, seen = self.folder.write_counted(made, **{k: F.count_if(op == k) for k in counts}, fresh=F.count_if(fresh))
            counts = {k: seen[k] or 0 for k in counts}
            if sum(counts.values()):
                out["staged"] = staged.add(change, sum(counts.values()), kept=counts["insert"] + counts["update"], fresh=seen["fresh"] or 0).entry
        if out != manifest:
            self.folder.change(before, out, "staged", "current")
        return IngestResult(None, counts["insert"], counts["update"] + counts["revert"], counts["delete"], rejected)

    def commit(self) -> int | None:
        """Give all that is uncommitted one new version, in one step; None if there is nothing.

        What one ingest has staged is not written again: its table becomes one of the history and of the present states, and the
        version is said in the manifest.
        """
        with self.locks.lock("commit", name=self.name):
            manifest = self.folder.manifest()
            staged = self._staged(manifest)
            pending = manifest.get("pending_options")
            table, rows, fresh = None, 0, 0
            if len(staged.deltas) == 1 and staged.deltas[0]["kept"] == staged.deltas[0]["rows"]:
                table, rows, fresh = (staged.deltas[0][k] for k in ("name", "rows", "fresh"))
            elif staged.deltas:
                table, seen = self.folder.write_counted(staged.rows(), n=F.count(F.lit(1)), fresh=F.count_if(~F.col("committed")))
                rows, fresh = seen["n"] or 0, seen["fresh"] or 0
            if not rows and not pending:
                if not staged.empty:
                    self.folder.change(manifest, {**manifest, "staged": None})
                return None
            version = max(self.now(), (self.committed_version() or 0) + 1)
            out = {**manifest, "staged": None}
            if not pending and not manifest.get("options"):
                pending = ParsingOptions().to_doc()
            if pending:
                out |= {"options": [*manifest.get("options", []), {"version": version, "options": pending}], "pending_options": None}
            if rows:
                total = manifest.get("rows", 0) + fresh
                number = max(manifest.get("buckets", 1), tiers.buckets(total))
                out["history"] = self._history(manifest).add(table, rows, version=version).compacted(lambda x: x.repartitionByRange("id", "version").sortWithinPartitions("id", "version")).tables
                current = self._current(manifest).add(table, rows, version=version)
                out["current"] = (current.compacted(number) if current.due(tiers.BUCKET) else current).entry
                out |= {"data_version": version, "rows": total, "buckets": number}
            self.folder.change(manifest, out, "staged", "current", "pending_options")
            return version

    def update_options(self, options: ParsingOptions, commit: bool = True) -> int | None:
        self.rollback_options()
        current = self.options()
        if current and current[max(current)] == options:
            return None
        self.folder.publish({**self.folder.manifest(), "pending_options": options.to_doc()})
        return self.commit() if commit else None

    def rollback_options(self) -> int:
        manifest = self.folder.manifest()
        if not manifest.get("pending_options"):
            return 0
        self.folder.publish({**manifest, "pending_options": None})
        return 1

    def rollback_records(self) -> int:
        manifest = self.folder.manifest()
        staged = self._staged(manifest)
        n = staged.rows().count()
        if not staged.empty:
            self.folder.publish({**manifest, "staged": None})
        return n

    def clean(self) -> int:
        """Remove the tables that the present state no longer needs, and say how many. For when nobody ingests or reads."""
        with self.locks.lock("commit", name=self.name), self.locks.lock("sync", name=self.name):
            found = self.folder.unused(self.folder.manifest())
            for name in found:
                self.folder.delete(name)
            return len(found)

    # -- index

    def _folded(self, history: DataFrame, strict: bool) -> DataFrame:
        """Intervals of parsed states; rows under different options are parsed in one pass."""
        every = [(v, json.dumps(o.to_doc())) for v, o in self.options().items()]
        table = self.spark.createDataFrame(every, "version bigint, option string")

        def parse(rows: DataFrame) -> DataFrame:
            return parse_documents(rows, state="state").withColumn("parsed", F.when(F.col("data").isNotNull(), F.struct("data_types", "parsed_types", "leaves")))

        return versions.fold(history.select("id", "version", "data"), table, parse, strict).select("id", "version", "next", "data", "parsed.*")

    def _archived(self, closed: DataFrame, n: int, manifest: dict, size: int) -> list[dict]:
        """The archives' tables and a new one that goes on where they end; none is written anew. Small archives lie in one folder
        together, so that there are as many files as the rows ask for and not as many as archives."""
        if not n:
            return manifest.get("arcs", [])
        last, held = tiers.arc_status(manifest)
        rows = tiers.assign(closed, size, last, held, buckets=max(8, tiers.buckets(n, 100_000)))
        few = max(1, tiers.TOGETHER // size)
        rows = rows.withColumns({"tier": F.lit("arc"), "part": F.floor(F.col("arc") / few).cast("int")})
        table = self.folder.write_parts(rows, "part", -(-min(size, n) // tiers.BUCKET))
        counts = self.folder.parts([table], DOCS).groupBy("arc").agg(F.count("*").alias("n")).collect()
        return [*manifest.get("arcs", []), {**table, "counts": {str(r["arc"]): r["n"] for r in counts}}]

    def _derived(self, what: str, rows: DataFrame, manifest: dict) -> list[dict]:
        """A kind of derived tables with one more, of ``rows``; many small ones are put together."""
        schema, dealt = DERIVED[what]
        name, seen = self.folder.write_counted(dealt(rows), n=F.count(F.lit(1)))
        return self._runs(what, manifest=manifest).add(name, seen["n"] or 0, newest=manifest["data_version"]).compacted(dealt).tables

    def sync(self, resync: bool = False, size: int = tiers.ARCHIVE, strict: bool = False) -> WriteResult:
        """Bring the tiers up to date: only records with newer data are folded again, or all if options changed since.

        What is written follows what has changed: archives get new files for what has been closed since, the latest tier a table
        of changes on top of its base, and leaves, postings, words, cells and sums one table more each. Nothing of a sync that
        fails is visible.
        """
        with self.locks.lock("sync", name=self.name):
            before = manifest = self.folder.manifest()
            last, newest = None if resync else manifest.get("synced"), self._committed(manifest)
            if not manifest.get("history") or last == newest:
                return WriteResult(0, 0, {})
            if last is None:
                manifest = {k: v for k, v in manifest.items() if k not in ("arcs", "latest", "indexed", "pieces", "pieces_to", *DERIVED)}
            try:
                out, indexed, deleted = self._synced(manifest, last, size, strict)
            except Exception as error:
                raise WriteError([str(error).split("\n")[0]]) from error
            self.folder.change(before, {**out, "synced": newest})
            return WriteResult(indexed, deleted, self._shares())

    def _synced(self, manifest: dict, last: int | None, size: int, strict: bool) -> tuple[dict, int, int]:
        history = self._history(manifest)
        rows = history.rows()
        if last is not None and not any(x["version"] > last for x in manifest["options"]):
            newer = history.rows(after=last).where(F.col("version") > last).select("id").distinct()
            rows = rows.join(newer, "id", "left_semi")
        new = F.lit(True) if last is None else F.col("version") > last
        ended = F.col("next").isNotNull() if last is None else F.col("next") > last
        was_open = F.lit(False) if last is None else (F.col("version") <= last) & (F.col("next").isNull() | (F.col("next") > last))
        name, seen = self.folder.write_counted(
            self._folded(rows, strict), n=F.count_if(new | F.coalesce(ended, F.lit(False))), closed=F.count_if(ended), open=F.count_if(F.col("next").isNull()),
            was=F.count_if(was_open), newest=F.max(F.greatest("version", "next")),
        )
        folded = self.folder.table([name], FOLDED)
        count = lambda k: seen[k] or 0
        number, latest = manifest["buckets"], self._latest(manifest)
        tier = {"tier": F.lit("latest"), "arc": F.lit(None).cast("int")}

        def latest_tier() -> tuple[dict, int]:
            opened = folded.where(F.col("next").isNull() & new).withColumns(tier)
            if last is None:
                return latest.started(opened, number, count("open")).entry, 0
            left = folded.groupBy("id").agg(F.bool_or(F.col("next").isNull()).alias("open"), F.bool_or(was_open).alias("was")).where("was AND NOT open")
            changes = opened.withColumn("gone", F.lit(False)).unionByName(left.select("id", F.lit(True).alias("gone")), allowMissingColumns=True)
            table, rows = self.folder.write_counted(changes, n=F.count(F.lit(1)), gone=F.count_if("gone"))
            added = latest.add(table, rows["n"]) if rows["n"] else latest
            return (added.compacted(number) if added.due(tiers.BUCKET) else added).entry, rows["gone"] or 0

        fresh = folded.where(new)
        leaves = leaf_rows(fresh)
        posted = words.postings(leaves)
        closed = folded.where(ended)
        jobs = [lambda: latest_tier(), lambda: self._archived(closed.select(*DOC_COLUMNS), count("closed"), manifest, size)]
        derived = {
            "leaves": leaves, "postings": posted, "words": posted.select("token"), "cells": cells.rows(leaves), "ends": closed.select("id", "version", "next"), "summary": profile.summary(folded, last),
        }
        jobs += [lambda what=what, x=x: self._derived(what, x, manifest) for what, x in derived.items()]
        (entry, deleted), arcs, *tables = self.folder.together(*jobs)
        size_now = manifest.get("latest_rows", 0) + count("open") - count("was") if last is not None else count("open")
        newest = max(x for x in (manifest.get("indexed"), seen["newest"], 0) if x is not None) or None
        return {**manifest, "arcs": arcs, "latest": entry, "latest_rows": size_now, "indexed": newest, **dict(zip(derived, tables))}, count("n"), deleted

    def compact(self) -> None:
        """Put the layers and small tables of this state together at once, as commits and syncs do by and by."""
        with self.locks.lock("commit", name=self.name), self.locks.lock("sync", name=self.name):
            manifest = self.folder.manifest()
            out, number = dict(manifest), manifest.get("buckets", 1)
            for what, schema in (("current", HISTORY), ("latest", DOCS)):
                out[what] = self._layers(what, schema, manifest).compacted(number).entry
            if len(manifest.get("history", [])) > 1:
                out["history"] = self._history(manifest).compacted(lambda x: x.repartitionByRange("id", "version").sortWithinPartitions("id", "version"), least=2).tables
            for what, (_, dealt) in DERIVED.items():
                out[what] = self._runs(what, manifest=manifest).compacted(dealt, least=2).tables
            self.folder.change(manifest, out)

    def _shares(self) -> dict[str, int]:
        manifest = self.folder.manifest()
        n = manifest.get("latest_rows", 0)
        return ({"latest": n} if n else {}) | {f"arc-{arc}": k for arc, k in tiers.arc_counts(manifest).items()}

    def resync_arcs(self, size: int = tiers.ARCHIVE, strict: bool = False) -> WriteResult:
        """Write all archives anew; the latest tier, and what documents are looked up in, are not touched."""
        with self.locks.lock("sync", name=self.name):
            before = self.folder.manifest()
            manifest = {**before, "arcs": []}
            if not manifest.get("history"):
                return WriteResult(0, 0, {})
            synced = manifest.get("synced")
            fits = F.col("next").isNotNull() if synced is None else F.col("next") <= synced  # what is newer comes with the next sync
            name, seen = self.folder.write_counted(self._folded(self._history(manifest).rows(), strict).where(fits), n=F.count(F.lit(1)))
            arcs = self._archived(self.folder.table([name], FOLDED), seen["n"] or 0, manifest, size)
            self.folder.change(before, {**manifest, "arcs": arcs}, "synced")
            shares = {f"arc-{arc}": k for arc, k in tiers.arc_counts({"arcs": arcs}).items()}
            return WriteResult(sum(shares.values()), 0, shares)

    def arc_status(self) -> tuple[int, int]:
        return tiers.arc_status(self.folder.manifest())

    def current_indices(self) -> list[str]:
        names = tiers.index_names(self.name)
        return sorted(names["latest"] if tier == "latest" else f"{names['archive']}{tier[len('arc-') :]}" for tier in self._shares())

    def search(self, version: int | str = "latest") -> Search:
        """``latest``, ``all``, or as of a version; from the newest indexed version on, the latest tier is enough."""
        manifest = self.folder.manifest()
        tables, newest = self.tables(), manifest.get("indexed")
        if version == "all":
            return Search(self._docs(), tables, "all")
        if version == "latest" or newest is None or version >= newest:
            return Search(self._latest(manifest).rows(), tables)
        return Search(versions.as_of(self._docs(), version), tables, version)

    def delete_documents(self, found: Search) -> int:
        """Take the documents of a search out of the latest tier, until a sync from the start; records and archives stay."""
        with self.locks.lock("sync", name=self.name):
            manifest = self.folder.manifest()
            latest = self._latest(manifest)
            keys = latest.rows().select("id", "version").join(found.docs.select("id", "version"), ["id", "version"], "left_semi")
            table, seen = self.folder.write_counted(keys.withColumn("gone", F.lit(True)), n=F.count(F.lit(1)))
            if seen["n"]:
                self.folder.change(manifest, {**manifest, "latest": latest.add(table, seen["n"]).entry, "latest_rows": manifest.get("latest_rows", 0) - seen["n"]})
            return seen["n"] or 0

    def _sums(self) -> DataFrame:
        return self._runs("summary").rows()

    def indexed_version(self) -> int | None:
        return self.folder.manifest().get("indexed")

    def version_changed_counts(self, exact: bool = False) -> dict[int, int]:
        return {r["version"]: r["count"] for r in profile.summed_changes(self._sums(), exact).collect()}

    def versions(self) -> list[int]:
        return sorted(self.version_changed_counts())

    def rounded_version(self, version: int) -> int | None:
        return max((v for v in self.versions() if v <= version), default=None)

    def _fields(self, kind: str, version: int | str, condition) -> DataFrame:
        if condition is None:
            newest = self.indexed_version()
            at = None if version == "latest" or (isinstance(version, int) and newest is not None and version >= newest) else version
            found = profile.summed_fields(self._sums(), kind, at)
        else:
            found = profile.fields(self.search(version).filter(condition).docs, kind)
        return found.orderBy(F.desc("count"), "path", "tag")

    def data_fields(self, version: int | str = "latest", condition=None) -> DataFrame:
        """(path, tag, count, tag_count), the most frequent paths first, then by path; from the sums that syncs have kept, or with
        a condition from the documents."""
        return self._fields("data_types", version, condition)

    def parsed_fields(self, version: int | str = "latest", condition=None) -> DataFrame:
        return self._fields("parsed_types", version, condition)
