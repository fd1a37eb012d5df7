"""Layers, indexes and sums against plain versions, and the plans they leave."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.database import Engine
from palimpsest.functions import geo
from palimpsest.operators import cells, diffing, parsing, profile, search, versions, words
from palimpsest.operators.options import OptionsBuilder, ParsingOptions
from palimpsest.plans import tiers
from palimpsest.sources import store
from palimpsest.sources.store import AlreadyLocked, Conflict, Folder, Layers, Locks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def database(spark, tmp_path, name="d"):
    ticks = iter(range(1, 10_000))
    return Engine(spark, f"file://{tmp_path}").database(name, lambda: next(ticks))


def test_layers_against_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    folder, want = Folder(spark, f"file://{tmp_path}"), {}
    layers = Layers(folder, None, "id string, x bigint")
    for step in range(12):
        change = {str(rng.randrange(60)): (rng.randrange(1000), rng.random() < 0.3) for _ in range(rng.randrange(1, 20))}
        rows = spark.createDataFrame([(i, x, gone) for i, (x, gone) in change.items()], "id string, x bigint, gone boolean")
        layers = layers.add(folder.write(rows), len(change))
        for i, (x, gone) in change.items():
            want.pop(i, None)
            if not gone:
                want[i] = x
        if layers.due(40):
            layers = layers.compacted(4)
        if step % 3:
            continue
        assert {r["id"]: r["x"] for r in layers.rows().collect()} == want
        some = {str(i) for i in range(0, 60, 7)}
        ids = spark.createDataFrame([(i,) for i in some], "id string")
        assert {r["id"]: r["x"] for r in layers.rows(ids).collect()} == {i: x for i, x in want.items() if i in some}
    assert len(layers.deltas) < store.LAYERS and layers.base
    assert {r["id"]: r["x"] for r in layers.compacted(4).rows().collect()} == want


def test_a_small_batch_writes_few_rows(spark, tmp_path, monkeypatch):
    """Of 3,000 records in 32 buckets, 75 change: what is written has their number of rows, not that of the buckets."""
    monkeypatch.setattr(tiers, "BUCKET", 100)
    db = database(spark, tmp_path)
    db.ingest(db.frame([(str(i), {"x": i}) for i in range(3000)]))
    db.sync()
    before = db.folder.manifest()
    assert before["current"]["base"] and before["buckets"] == 32
    written, write = [], Folder.write

    def noted(self, df):
        written.append(write(self, df))
        return written[-1]

    monkeypatch.setattr(Folder, "write", noted)
    db.ingest(db.frame([(str(i), {"x": -1}) for i in range(0, 3000, 40)]))
    db.sync()
    rows = sum(spark.read.parquet(f"{db.folder.root}/{name}").count() for name in written)
    after = db.folder.manifest()
    assert rows < 75 * 25 and after["current"]["base"] == before["current"]["base"] and after["latest"]["base"] == before["latest"]["base"]
    got = {r["id"]: json.loads(r["data"])["x"] for r in db.search().docs.collect()}
    assert got == {str(i): -1 if i % 40 == 0 else i for i in range(3000)} and db._shares() == {"latest": 3000, "arc-0": 75}
    db.compact()
    assert {r["id"]: json.loads(r["data"])["x"] for r in db.search().docs.collect()} == got and db.clean() > 0
    assert len(db.folder.manifest()["latest"]["deltas"]) == 1 and len(db.folder.manifest()["history"]) == 1 and db.history().count() == 3075


def test_sums_are_full_counts(spark, tmp_path):
    db = database(spark, tmp_path)
    rng = random.Random(2)
    made = lambda: rng.choice([None, {"a": rng.choice([1, "x", 2.5, [1, "y"], {"b": 1}])}, {"c": ["q", {"d": None}]}])
    for step in range(4):
        db.ingest(db.frame([(str(rng.randrange(25)), made()) for _ in range(20)]))
        if step == 2:
            db.update_options(OptionsBuilder().with_true_value("x").build())
        db.sync()
    docs = db._docs()
    plain = lambda df: sorted(tuple(r) for r in df.select("path", "tag", "count", "tag_count").collect())
    for kind, of in (("data_types", db.data_fields), ("parsed_types", db.parsed_fields)):
        assert plain(of("latest")) == plain(profile.fields(versions.latest(docs), kind)) != []
        assert plain(of("all")) == plain(profile.fields(docs, kind))
        for at in db.versions()[:-1]:
            assert plain(of(at)) == plain(profile.fields(versions.as_of(docs, at), kind))
    for exact in (False, True):
        assert db.version_changed_counts(exact) == {r["version"]: r["count"] for r in profile.changed_counts(docs, exact).collect()}
    assert db.indexed_version() == profile.indexed_version(docs).first()["version"] and db._shares()["latest"] == versions.latest(docs).count()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_against_all_distances(spark):
    rng = random.Random(3)
    known = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"x" * n for n in range(20, 31)} | {"ab" * 13, "b" + "ab" * 12}
    table = words.terms(spark.createDataFrame([(x,) for x in known], "token string")).cache()
    for asked in ["abc", "a", "éab", "bca", "x" * 24, "x" * 26, "ab" * 12, "q", *rng.sample(sorted(known), 4)]:
        for k in (1, 2, 3):
            assert {r["token"] for r in words.near(table, asked, k).collect()} == {w for w in known if edits(w, asked) <= k}, (asked, k)


def exchanged(a, b):
    """Edits between two words, an exchange of neighbours one of them, by trying all: up to two."""
    letters = sorted(set(a + b))

    def step(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}

    one = step(a)
    return 0 if a == b else 1 if b in one else 2 if any(b in step(w) for w in one) else 3


def test_exchanges_of_neighbours(spark):
    rng = random.Random(6)
    known = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(120)}
    table = words.terms(spark.createDataFrame([(x,) for x in known], "token string")).cache()
    for asked in ["ca", "abc", "b", *rng.sample(sorted(known), 3)]:
        for k in (1, 2):
            want = {w for w in known if exchanged(asked, w) <= k}
            assert {r["token"] for r in words.near(table, asked, k, swaps=True).collect()} == want, (asked, k)
            assert {r["token"] for r in words.near(table, asked, k, 1, True).collect()} == {w for w in want if w[0] == asked[0]}


def test_what_a_text_query_asks_for():
    asked = search.Asked("ab abc Abcde abcdef", fuzziness="AUTO")
    assert list(asked.words.values()) == [0, 1, 1, 2] and asked.needed == 1
    needed = lambda x, operator="or": search.Asked("a b c d", operator, minimum_should_match=x).needed
    assert [needed(x) for x in (None, 0, 3, -3, -9, 9, "74%", "75%", "-26%", "2")] == [1, 1, 3, 1, 1, 9, 2, 3, 3, 2] and needed(1, "and") == 4
    for wrong in ({"operator": "nor"}, {"zero_terms_query": "some"}, {"fuzziness": 3, "fuzzy_transpositions": True}):
        with pytest.raises(ValueError):
            search.Asked("abc", **wrong)


def test_lookups_give_what_scans_give(spark, tmp_path, monkeypatch):
    db = database(spark, tmp_path)
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("red green blue gray grey marsh hen can't 2.75".split()) for _ in range(rng.randrange(1, 5)))
    shape = lambda x, y: f"POLYGON (({x} {y}, {x + 3} {y}, {x} {y + 3}, {x} {y}))"
    made = lambda: {"t": text(), "u": {"v": [text(), text()]}, "p": f"POINT ({rng.randrange(-180, 180)} {rng.randrange(-90, 90)})", "s": shape(rng.randrange(-170, 170), rng.randrange(-80, 80))}
    for _ in range(3):
        db.ingest(db.frame([(str(rng.randrange(60)), made() if rng.random() < 0.9 else None) for _ in range(40)]))
        db.sync()
    conditions = [search.match_of("RED blue"), search.match_of("red blue", "u.v", "and"), search.match_of("grxy", fuzziness=1), search.match_of("marsh grean", "t", "and", 1), search.match_of(""), search.match_of("gene", fuzziness=2)]
    conditions += [search.box_of(-60, 50, 90, -40), search.shapes_of(-60, 50, 90, -40), search.term_of("t", "red"), search.exists_of("u"), search.has_geo_of()]
    options = [search.match_of("red blue marsh hen", minimum_should_match=x) for x in (2, -1, "60%", "-60%", 9)]
    options += [search.match_of("erd bleu", "t", "and", "AUTO", fuzzy_transpositions=True), search.match_of("grxy", fuzziness="AUTO:2,4", prefix_length=3), search.match_of("--", zero_terms_query="all")]
    for at in ("latest", "all", 2):
        whole = db.search(at)
        rows = whole.docs.cache()
        for c in conditions + options:
            want = {(r["id"], r["version"]) for r in rows.where(c.on_leaves()).select("id", "version").collect()}
            found = whole.filter(c)
            assert {tuple(r) for r in found.docs.select("id", "version").collect()} == want, vars(c)
            assert {tuple(r) for r in found.keys().collect()} == want
    every = {(r["id"], r["version"]) for r in rows.select("id", "version").collect()}
    a, b, c = conditions[0], conditions[6], conditions[8]
    hit = lambda x: {(r["id"], r["version"]) for r in rows.where(x.on_leaves()).select("id", "version").collect()}
    keys = lambda x: {tuple(r) for r in x.docs.select("id", "version").collect()}
    assert keys(whole.must_not(a)) == every - hit(a) and keys(whole.should(a, b, c)) == hit(a) | hit(b) | hit(c)
    assert keys(whole.should(a, search.has_geo())) == hit(a) | hit(conditions[-1]) and keys(whole.must_not(search.has_geo())) == every - hit(conditions[-1])
    both = db.search().filter(a).must_not(c)
    assert {tuple(r) for r in both.keys().collect()} == keys(both)


def test_lookups_read_what_they_ask_for(spark, tmp_path):
    db = database(spark, tmp_path)
    db.ingest(db.frame([(str(i), {"t": f"word{i} common", "p": f"POINT ({i} {i})"}) for i in range(80)]))
    db.sync()
    docs = [t["name"].split("/")[1] for t in db.folder.manifest()["latest"]["base"]]
    for condition, pushed in ((search.match_of("word7"), "(token"), (search.box_of(1, 5, 5, 1), "Or(And(GreaterThanOrEqua"), (search.shapes_of(1, 5, 5, 1), "level")):
        keys = db.search().filter(condition).keys()
        plan = keys._jdf.queryExecution().toString()
        assert not any(name in plan for name in docs) and pushed in plan.split("PushedFilters", 1)[1]
        assert "Python" not in plan or condition.__class__ is search.ShapeBoxOf
        assert keys.count() >= 1


def test_cells_hold_every_box(spark):
    rng = random.Random(5)
    points = [(str(i), rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)] + [("e1", 180.0, 90.0), ("e2", -180.0, -90.0), ("e3", 0.0, 0.0)]
    size = lambda: rng.choice([0.001, 1, 30, 170])
    made = []
    for i in range(150):
        x, y, w, h = rng.uniform(-180, 180), rng.uniform(-90, 90), size(), size()
        box = [x, y, min(180.0, x + w), min(90.0, y + h)]
        made.append((f"s{i}", box, f"POLYGON (({box[0]} {box[1]}, {box[2]} {box[1]}, {box[2]} {box[3]}, {box[0]} {box[1]}))"))
    schema = "id string, version bigint, path string, lon double, lat double, gs string, box array<double>"
    leaves = spark.createDataFrame([(i, 1, "p", x, y, None, None) for i, x, y in points] + [(i, 1, "s", None, None, gs, box) for i, box, gs in made], schema)
    table = search.Tables(leaves, cells=cells.rows(leaves).cache())
    assert table.cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    for left, top, right, bottom in [(-10, 10, 10, -10), (-180, 90, 180, -90), (179, 90, 180, 89), (3.25, 7.5, 3.26, 7.4), (-200, 100, -170, 60), (50, 0, 50, 0)] + [tuple(f(v) for f, v in zip((float,) * 4, (x, y + 20, x + 35, y))) for x, y in ((rng.uniform(-180, 140), rng.uniform(-90, 70)) for _ in range(8))]:
        assert {r["id"] for r in search.box_of(left, top, right, bottom).documents(table).collect()} == {i for i, x, y in points if left <= x <= right and bottom <= y <= top}
        want = {i for i, _, gs in made if geo.meets_box(gs, left, bottom, right, top)}
        assert {r["id"] for r in search.shapes_of(left, top, right, bottom).documents(table).collect()} == want
        for level in (0, 3, cells.FINEST):
            assert len(cells.ranges(left, top, right, bottom, level)) <= 4 * cells.RANGES


def test_stabs_against_all_pairs(spark):
    rng = random.Random(6)
    docs = []
    for name in ("a", "b", None):
        for i in range(20):
            cuts = sorted(rng.sample(range(-50, 500), rng.randrange(1, 6)))
            docs += [(name, f"{i}", v, n) for v, n in zip(cuts, [*cuts[1:], rng.choice([None, cuts[-1] + 9])])]
    asked = [(rng.choice(["a", "b", "c"]), rng.randrange(-80, 520)) for _ in range(200)] + [("a", 7), ("a", 7), ("b", None)]
    found = versions.stabbed(spark.createDataFrame(docs, "name string, id string, version bigint, next bigint"), spark.createDataFrame(asked, "name string, at bigint"))
    want = sorted({(name, i, v, n or 0, at) for name, i, v, n in docs for own, at in asked if own == name and at is not None and v <= at and (n is None or at < n)})
    assert sorted((r["name"], r["id"], r["version"], r["next"] or 0, r["at"]) for r in found.collect()) == want
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_rejected_rows_do_not_stop_an_ingest(spark, tmp_path):
    db = database(spark, tmp_path)
    rows = [("a", '{"x": 1}', 1), ("a", "{x", 2), ("b", "[1]", 1), ("c", '"text"', 1), (None, '{"x": 1}', 1), ("d", "", 1), ("e", None, 1), ("f", '{"x": 1}', 1), ("f", "{}", 2), ("g", "NaN", 1)]
    got = db.ingest(spark.createDataFrame(rows, "id string, data string, seq bigint"))
    assert (got.inserted, got.rejected) == (1, 5) and [r["id"] for r in db.records().collect()] == ["a"]
    found = {(r["id"], r["raw"]): r["reason"] for r in db.rejects().collect()}
    assert set(found) == {("a", "{x"), ("b", "[1]"), ("c", '"text"'), (None, '{"x": 1}'), ("g", "NaN")}
    assert found["b", "[1]"] == "no object but list" and found[None, '{"x": 1}'] == "no id" and found["a", "{x"].startswith("malformed JSON")
    again = db.ingest(spark.createDataFrame([("z", "[", 1)], "id string, data string, seq bigint"))
    assert again.rejected == 1 and not again.was_committed and db.rejects().count() == 6


def test_states_are_equal_whatever_the_order_of_keys():
    same = lambda x, y: parsing.parse_placed(x, ParsingOptions())[3] == parsing.parse_placed(y, ParsingOptions())[3]
    assert same({"a": 1, "b": 2, "x": ["", None]}, {"b": 2, "a": 1, "x": [None, ""]})
    assert same({"a": [{"p": 1, "q": "x"}]}, {"a": [{"q": "x", "p": 1}]})
    assert not same({"a": [1, 2]}, {"a": [2, 1]}) and not same({"x": ["a", None]}, {"x": [None, "a"]}) and not same({"a": [{"p": 1}, {"q": 1}]}, {"a": [{"q": 1}, {"p": 1}]})
    assert not same({"a": 1}, {"a": 2}) and not same({"a": [1, None]}, {"a": [1, None, None]}) and not same({"a": None}, {"a": ""})


def test_reordered_states_are_one_version(spark, tmp_path):
    db = database(spark, tmp_path)
    db.ingest(db.frame([("i", {"a": 1, "b": 2, "x": ["", None]})]))
    assert db.ingest(db.frame([("i", {"b": 2, "a": 1, "x": [None, ""]})])).was_committed
    assert db.sync().indexed == 1 and db.search("all").count() == 1


def test_a_lock_left_behind_is_taken_over(spark, tmp_path):
    now = [100.0]
    folder = Folder(spark, f"file://{tmp_path}")
    first, second = (Locks(folder, lease=10, clock=lambda: now[0]) for _ in range(2))
    token = first.acquire("x", who="first")
    with pytest.raises(AlreadyLocked):
        second.acquire("x")
    now[0] += 11
    assert not second.is_locked("x") and second.metadata("x") is None
    second.acquire("x", who="second")
    first.release("x", token)  # no longer its own
    assert second.metadata("x") == {"who": "second"}
    second.release("x")
    assert not second.is_locked("x") and second.acquire("x")


def test_one_state_follows_another(spark, tmp_path):
    one, other = (Folder(spark, f"file://{tmp_path}") for _ in range(2))
    one.publish({**one.manifest(), "a": 1})
    seen = other.manifest()
    one.publish({**one.manifest(), "a": 2})
    with pytest.raises(Conflict):
        other.publish({**seen, "a": 3})
    assert other.manifest()["a"] == 2


def test_pages_of_terms(spark, tmp_path):
    docs = spark.createDataFrame([([f"v{i % 23:02}", "all"],) for i in range(100)], "x array<string>")
    pages = list(profile.TermPages(docs, "x", f"file://{tmp_path}/t", size=5))
    assert [len(p) for p in pages] == [5, 5, 5, 5, 4] and [tuple(r) for p in pages for r in p] == [tuple(r) for r in profile.terms(docs, "x").collect()]
    assert list(profile.TermPages(docs.limit(0), "x", f"file://{tmp_path}/e")) == []


def test_documents_of_a_search_leave_the_latest_tier(spark, tmp_path):
    db = database(spark, tmp_path)
    db.ingest(db.frame([(str(i), {"x": i}) for i in range(10)]))
    db.sync()
    assert db.delete_documents(db.search().filter(search.range_of("x", lt=4))) == 4
    assert db.search().count() == 6 == db._shares()["latest"] and db.records().count() == 10
    db.sync(resync=True)
    assert db.search().count() == 10


def test_changes_at_the_same_time(spark, tmp_path, monkeypatch):
    """A change to other parts of the state goes on top of a newer one; one to the same part is made again."""
    db = database(spark, tmp_path)
    db.ingest(db.frame([("a", {"x": 1})]))
    other = Engine(spark, f"file://{tmp_path}").database("d", lambda: 500)
    write, meanwhile = Folder.write_counted, [other.sync]

    def interrupted(self, df, **counts):
        found = write(self, df, **counts)
        if meanwhile:
            monkeypatch.setattr(Folder, "write_counted", write)
            meanwhile.pop(0)()
            monkeypatch.setattr(Folder, "write_counted", interrupted)
        return found

    monkeypatch.setattr(Folder, "write_counted", interrupted)
    attempts, once = [], type(db)._ingest
    monkeypatch.setattr(type(db), "_ingest", lambda self, *a: (attempts.append(1), once(self, *a))[1])
    assert db.ingest(db.frame([("c", {"x": 3})]), commit=False).inserted == 1 and len(attempts) == 1
    assert db.folder.manifest()["synced"] == 1 and other.search().count() == 1
    meanwhile.append(lambda: other.ingest(other.frame([("b", {"x": 2})]), commit=False))
    assert db.ingest(db.frame([("d", {"x": 4})]), commit=False).inserted == 1 and len(attempts) == 4  # the other's too
    assert {r["id"] for r in db.records().collect()} == {"a", "b", "c", "d"} and db.commit() and db.sync().tiers == {"latest": 4}


def test_histories_from_differences(spark):
    rng = random.Random(8)
    rows = []
    for i in range(12):
        state = {"a": [1, {"b": None}], "c": "é", "n": 0}
        for version in range(rng.randrange(1, 40)):
            state = {**state, "n": version, "a": [*state["a"][: rng.randrange(3)], {"b": version}, "x"]}
            rows.append((str(i), version, json.dumps(state, ensure_ascii=False) if rng.random() < 0.9 else None))
    history = spark.createDataFrame(rows, "id string, version bigint, data string")
    stored = diffing.compressed(history, every=5).cache()
    assert sorted(map(tuple, diffing.restored(stored).collect()), key=repr) == sorted(rows, key=repr)
    assert stored.agg(F.max("place")).first()[0] == 4 and stored.where("ops IS NOT NULL").count() > len(rows) / 2
    assert diffing.restored(stored.limit(0)).count() == 0


def test_states_in_a_store_that_is_no_local_disk(spark, tmp_path):
    """Through a file system that only Spark's readers know, a state still gets its name once."""
    (tmp_path / "shared").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.elsewhere.link./in", f"file://{tmp_path}/shared")
    db = Engine(spark, "viewfs://elsewhere/in").database("d", lambda: 5)
    seen = db.folder.manifest()
    assert db.ingest(db.frame([("a", {"x": 1})])).version == 5 and db.records().count() == 1
    with pytest.raises(Conflict):
        db.folder.publish({**seen, "a": 3})
    with db.locks.lock("sync"), pytest.raises(AlreadyLocked):
        db.locks.acquire("sync")
