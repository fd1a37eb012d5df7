"""Tables of a database under a folder, a manifest that names the current ones, and locks. Works on any Hadoop file system."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class WriteError(Exception):
    """Documents could not be written; nothing of their sync is visible. ``errors`` holds what went wrong."""

    def __init__(self, errors: list):
        super().__init__(f"{len(errors)} errors while writing. Sample: {errors[0]}")
        self.errors = errors


class AlreadyLocked(Exception):
    """The lock is held by someone else."""


class Conflict(RuntimeError):
    """Someone else has published a state since the one that a change was made on."""


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> None:
        """Write a new file; fails if it is there already."""
        try:
            stream = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception as error:
            if self.exists(name):
                raise AlreadyLocked(name) from error
            raise
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def manifest(self) -> dict:
        """The newest manifest; each state of the database is a file of its own, written whole before it has its name."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        number = max((int(x.getPath().getName()[len("manifest-") : -len(".json")]) for x in found), default=0)
        return (self.read(f"manifest-{number}.json") if number else None) or {"number": 0}

    def publish(self, manifest: dict) -> None:
        """The next state, whole or not at all; only one can follow another."""
        number = manifest["number"] + 1
        self.create(own := f"manifest-{number}.tmp-{uuid.uuid4().hex}", {**manifest, "number": number})
        try:
            self._name(own, f"manifest-{number}.json")
        except FileExistsError as error:
            raise Conflict("the database was changed meanwhile") from error
        finally:
            self.delete(own)

    def change(self, before: dict, after: dict, *reads: str) -> None:
        """Publish what ``after`` says otherwise than ``before``. If others have published meanwhile, it goes on top of theirs,
        unless they have changed the same parts or some that it ``reads``: that is a conflict."""
        own = {k for k in {*before, *after} - {"number"} if before.get(k) != after.get(k)}
        while True:
            now = self.manifest()
            if any(now.get(k) != before.get(k) for k in own.union(reads)):
                raise Conflict("the database was changed meanwhile")
            try:
                return self.publish({k: v for k, v in now.items() if k not in own} | {k: after[k] for k in own if k in after})
            except Conflict:
                continue

    def _name(self, own: str, name: str) -> None:
        """Give a file a name that no other has, in one step: a second link on a local disk, elsewhere a rename that replaces
        nothing."""
        if self._fs.getScheme() == "file":
            local = self._path(f"{self.root}/").toUri().getPath().rstrip("/")
            os.link(f"{local}/{own}", f"{local}/{name}")
            return
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(self._path(f"{self.root}/{own}"), self._path(f"{self.root}/{name}"), options)
        except Exception as error:
            if self.exists(name):
                raise FileExistsError(name) from error
            raise

    def unused(self, manifest: dict) -> list[str]:
        """Tables that a manifest doesn't name."""
        found = self._fs.globStatus(self._path(f"{self.root}/tables/*")) or []
        text = json.dumps(manifest)
        return [name for x in found if (name := f"tables/{x.getPath().getName()}") not in text]

    def write(self, df: DataFrame) -> str:
        """A new table; visible only once a manifest names it."""
        name = f"tables/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return name

    def write_counted(self, df: DataFrame, **counts: Column) -> tuple[str, dict[str, int]]:
        """A new table, and sums or other aggregates of its rows that are taken while it is written."""
        seen = Observation()
        name = self.write(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
        return name, {k: seen.get.get(k) for k in counts}

    @staticmethod
    def together(*jobs: Callable[[], object]) -> list:
        """The results of independent jobs that run at the same time."""
        with ThreadPoolExecutor(max(len(jobs), 1)) as pool:
            return [x.result() for x in [pool.submit(job) for job in jobs]]

    def table(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names])

    def write_parts(self, df: DataFrame, key: str, spread: int = 1) -> dict:
        """A new table with a folder for each value of ``key``, an integer column that the files do not hold; which there are.

        A value's rows are written by ``spread`` tasks, dealt by id, and each file is sorted by id.
        """
        name = f"tables/{uuid.uuid4().hex}"
        dealt = [key] + ([F.pmod(F.xxhash64("id"), F.lit(spread))] if spread > 1 else [])
        df.repartition(*dealt).sortWithinPartitions(key, "id").write.option("compression", "zstd").partitionBy(key).parquet(f"{self.root}/{name}")
        found = self._fs.globStatus(self._path(f"{self.root}/{name}/{key}=*")) or []
        return {"name": name, "key": key, "has": sorted(int(x.getPath().getName().partition("=")[2]) for x in found)}

    def parts(self, tables: list[dict], schema: str) -> DataFrame:
        return self.table([f"{t['name']}/{t['key']}={k}" for t in tables for k in t["has"]], schema)


class Buckets:
    """Rows by buckets of their ids: which folders of which tables hold the present ones. Their number is a power of two, and a
    bucket of a table with fewer holds those of a finer division whose numbers are equal to its own by that modulus."""

    def __init__(self, folder: Folder, tables: list[dict], schema: str):
        self.folder, self.tables, self.schema = folder, tables, schema

    @staticmethod
    def of(rows: DataFrame, number: int) -> set[int]:
        """The buckets that the ids of ``rows`` fall into: as many numbers as there are buckets at most."""
        return {r["bucket"] for r in rows.select(bucket(number).alias("bucket")).distinct().collect()}

    def within(self, wanted: set[int]) -> Buckets:
        return self._split(wanted)[0]

    def _split(self, wanted: set[int]) -> tuple[Buckets, Buckets]:
        parts: tuple[list, list] = ([], [])
        for t in self.tables:
            own = {x % t["of"] for x in wanted}
            for k, has in enumerate(([x for x in t["has"] if x in own], [x for x in t["has"] if x not in own])):
                if has:
                    parts[k].append({**t, "has": has})
        return Buckets(self.folder, parts[0], self.schema), Buckets(self.folder, parts[1], self.schema)

    def rows(self) -> DataFrame:
        return self.folder.parts(self.tables, self.schema)

    def add(self, rows: DataFrame, number: int, **about) -> Buckets:
        table = self.folder.write_parts(rows.withColumn("bucket", bucket(number)), "bucket")
        return Buckets(self.folder, self.tables + ([{**table, "of": number, **about}] if table["has"] else []), self.schema)

    def count(self) -> int:
        """Rows by the files' own counts."""
        return self.rows().count()

    def replace(self, wanted: set[int], rows: DataFrame, number: int) -> Buckets:
        """Those outside of ``wanted`` as they are, and ``rows``, which must be all others: no other bucket is written anew."""
        return self._split(wanted)[1].add(rows, number)


#: A store of layers merges them when it has so many on top of its base, or when these have a quarter of the base's rows.
LAYERS, SHARE = 8, 0.25


class Layers:
    """Present rows of ids: a base in buckets, and tables of changes on top of it. Of one id the newest row counts; one that is
    ``gone`` takes the id away. A change writes its own rows alone, reading merges, and compaction keeps the layers few.

    A table of changes whose rows are all of one version may leave that to its entry.
    """

    def __init__(self, folder: Folder, entry: dict | None, schema: str):
        entry = entry or {}
        self.folder, self.schema = folder, schema
        self.base, self.deltas, self.size = entry.get("base", []), entry.get("deltas", []), entry.get("size", 0)

    @property
    def entry(self) -> dict:
        """What a manifest says of this store."""
        return {"base": self.base, "deltas": self.deltas, "size": self.size}

    @property
    def empty(self) -> bool:
        return not self.base and not self.deltas

    def add(self, name: str, rows: int, **about) -> Layers:
        """With one more table of changes: (the schema's columns, gone), one row an id; a missing ``gone`` is none."""
        return Layers(self.folder, {**self.entry, "deltas": [*self.deltas, {"name": name, "rows": rows, **about}]}, self.schema)

    def started(self, rows: DataFrame, number: int, size: int) -> Layers:
        """Only ``rows``, as a base."""
        base = Buckets(self.folder, [], self.schema).add(rows, number).tables if size else []
        return Layers(self.folder, {"base": base, "size": size}, self.schema)

    def changes(self) -> DataFrame:
        """The newest change of every changed id, with ``gone``."""
        columns = [c.split(" ")[0] for c in self.schema.split(", ")]
        every = None
        for n, t in enumerate(self.deltas):
            rows = self.folder.table([t["name"]], self.schema + ", gone boolean").withColumn("gone", F.coalesce("gone", F.lit(False)))
            if "version" in t:
                rows = rows.withColumn("version", F.lit(t["version"]).cast("bigint"))
            rows = rows.select(*columns, "gone", F.lit(n).alias("layer"))
            every = rows if every is None else every.unionByName(rows)
        if every is None:
            return self.folder.table([], self.schema + ", gone boolean")
        if len(self.deltas) == 1:
            return every.drop("layer")
        others = [c for c in [*columns, "gone"] if c != "id"]
        newest = every.groupBy("id").agg(F.max_by(F.struct(*others), "layer").alias("x"))
        return newest.select("id", *[F.col(f"x.{c}").alias(c) for c in others]).select(*columns, "gone")

    def rows(self, ids: DataFrame | None = None, within: set[int] | None = None) -> DataFrame:
        """The present rows; with ``ids`` those of them alone, and ``within`` the buckets that these are in."""
        base = Buckets(self.folder, self.base, self.schema)
        base = (base.within(within) if within is not None else base).rows()
        if ids is not None:
            base = base.join(ids, "id", "left_semi")
        if not self.deltas:
            return base
        changed = self.changes() if ids is None else self.changes().join(ids, "id", "left_semi")
        return base.join(changed.select("id"), "id", "left_anti").unionByName(changed.where("NOT gone").drop("gone"))

    def due(self, least: int) -> bool:
        """Whether there are many layers, or as many changes as are worth a new base."""
        return len(self.deltas) >= LAYERS or sum(t["rows"] for t in self.deltas) >= max(SHARE * self.size, least)

    def compacted(self, number: int) -> Layers:
        """The same rows in fewer layers: few changes become one table of changes, many go to the base, whose buckets that they
        are in are written anew."""
        if not self.deltas:
            return self
        n = sum(t["rows"] for t in self.deltas)
        if self.base and n < SHARE * self.size:
            name, counts = self.folder.write_counted(self.changes(), n=F.count(F.lit(1)))
            return Layers(self.folder, {**self.entry, "deltas": [{"name": name, "rows": counts["n"] or 0}]}, self.schema)
        touched = Buckets.of(self.changes(), number)
        base = Buckets(self.folder, self.base, self.schema).replace(touched, self.rows(within=touched), number)
        return Layers(self.folder, {"base": base.tables, "size": base.count()}, self.schema)


class Runs:
    """Tables to which rows are only added; small ones are put together, so that their number stays small."""

    def __init__(self, folder: Folder, tables: list[dict] | None, schema: str):
        self.folder, self.tables, self.schema = folder, tables or [], schema

    def rows(self, after: int | None = None) -> DataFrame:
        """All rows, or those of the tables that hold a version above ``after`` (others of theirs too)."""
        out = None
        plain = [t["name"] for t in self.tables if "version" not in t and (after is None or t.get("newest", after + 1) > after)]
        if plain:
            out = self.folder.table(plain, self.schema)
        for t in self.tables:
            if "version" in t and (after is None or t["version"] > after):
                rows = self.folder.table([t["name"]], self.schema).withColumn("version", F.lit(t["version"]).cast("bigint"))
                out = rows if out is None else out.unionByName(rows)
        return self.folder.table([], self.schema) if out is None else out

    def add(self, name: str, rows: int, **about) -> Runs:
        return Runs(self.folder, [*self.tables, {"name": name, "rows": rows, **about}] if rows else self.tables, self.schema)

    def compacted(self, dealt: Callable[[DataFrame], DataFrame], least: int = LAYERS) -> Runs:
        """With so many tables or more, all that have less than a quarter of the largest one's rows become one, dealt and sorted;
        all of them if these are few."""
        if len(self.tables) < least:
            return self
        limit = SHARE * max(t["rows"] for t in self.tables)
        small = [t for t in self.tables if t["rows"] < limit]
        if len(small) < max(least - 1, 2):
            small = self.tables
        name = self.folder.write(dealt(Runs(self.folder, small, self.schema).rows()))
        newest = [t.get("newest", t.get("version")) for t in small]
        about = {"newest": max(newest)} if None not in newest else {}
        return Runs(self.folder, [t for t in self.tables if t not in small] + [{"name": name, "rows": sum(t["rows"] for t in small), **about}], self.schema)


def bucket(number: int):
    return F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")


class Locks:
    """Named locks with metadata: a lock is a file that only one can create. One that is held for longer than its lease counts as
    left behind, and the next who asks takes it over."""

    def __init__(self, folder: Folder, lease: float = 3600.0, clock: Callable[[], float] = time.time):
        self.folder, self.lease, self.clock = folder, lease, clock

    def _held(self, name: str) -> dict | None:
        found = self.folder.read(f"lock-{name}.json")
        return found if found and found["until"] > self.clock() else None

    def acquire(self, name: str, /, **metadata) -> str:
        """The token of the one who holds it."""
        found = self.folder.read(f"lock-{name}.json")
        if found and found["until"] <= self.clock():
            # whoever gives the old lock another name first may take its place
            stale = f"lock-{name}.json.{found['token']}"
            try:
                self.folder.create(stale, {})
            except AlreadyLocked:
                raise AlreadyLocked(name) from None
            self.folder.delete(f"lock-{name}.json")
        token = uuid.uuid4().hex
        self.folder.create(own := f"lock-{name}.tmp-{token}", {"token": token, "until": self.clock() + self.lease, "metadata": metadata})
        try:
            self.folder._name(own, f"lock-{name}.json")
        except FileExistsError as error:
            raise AlreadyLocked(name) from error
        finally:
            self.folder.delete(own)
        return token

    def release(self, name: str, token: str | None = None) -> None:
        """Give the lock back; with a token only if it is still the one's own."""
        found = self.folder.read(f"lock-{name}.json")
        if found and token in (None, found["token"]):
            self.folder.delete(f"lock-{name}.json")

    def is_locked(self, name: str) -> bool:
        return self._held(name) is not None

    def metadata(self, name: str) -> dict | None:
        found = self._held(name)
        return found and found["metadata"]

    @contextmanager
    def lock(self, name: str, /, **metadata):
        token = self.acquire(name, **metadata)
        try:
            yield
        finally:
            self.release(name, token)
