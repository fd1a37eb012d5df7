"""What must not grow faster than the input: tasks that read a file, passes over it, and what a worker holds."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest import queries
from palimpsest.operators import ingest, parsing, profile, words
from palimpsest.operators.options import OptionsBuilder


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """Customers in one file of one row group."""
    path = str(tmp_path_factory.mktemp("one"))
    rows = spark.range(1, 301).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    rows.coalesce(1).write.parquet(f"{path}/customer.parquet")
    return path


def tasks(df):
    """Rows in each of the tasks that end a plan."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_one_row_group_is_parsed_by_many_tasks(spark, customers):
    for docs in (queries._squares(spark, customers), queries._nested(spark, customers), queries._wkt_docs(spark, customers)):
        found = tasks(docs)
        assert sum(found) == 300 and len(found) >= spark.sparkContext.defaultParallelism and max(found) < 100


def test_profiles_read_their_documents_once(spark, customers):
    found = profile.fields(queries._nested(spark, customers))
    for df in (found, profile.hierarchy(found), profile.listed(found), profile.described(found)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_profile_of_odd_paths(spark):
    docs = spark.createDataFrame([(["a.#d,#l", "a..#d", "a..x.#i", "b.#s", "b.y.#i", "c.d.#i", ".#d", "..#s"],), (["a.#s", "a..#i"],)], "data_types array<string>")
    found = profile.fields(docs)
    assert {(r["path"], r["tag"]): (r["count"], r["tag_count"]) for r in found.collect()} == {
        ("a", "#d"): (2, 1), ("a", "#l"): (2, 1), ("a", "#s"): (2, 1), ("a.", "#d"): (2, 1), ("a.", "#i"): (2, 1), ("a..x", "#i"): (1, 1), ("b", "#s"): (1, 1), ("b.y", "#i"): (1, 1), ("c.d", "#i"): (1, 1),
        ("", "#d"): (1, 1), (".", "#s"): (1, 1),
    }
    links = {("a", "a."), ("a.", "a..x"), ("", ".")}  # b is no container, c no field
    assert {tuple(r) for r in profile.hierarchy(found).collect()} == links
    assert {(r["parent"], r["path"]) for r in profile.listed(found).where("parent IS NOT NULL").collect()} == links
    rows = {r["path"]: r for r in profile.described(found).collect()}
    assert {(p, c) for p, r in rows.items() for c in r["children"]} == links and len(rows) == 8
    assert rows["a"]["types"] == {"#d": 1, "#l": 1, "#s": 1} and rows["a"]["is_container"] and rows["c.d"]["parent"] is None


def test_a_worker_remembers_few_values():
    options = OptionsBuilder().build()
    forms = parsing._forms(options)
    for n in range(parsing.REMEMBERED + 5):
        parsing.parse_rows({"x": f"v{n}", "y": "long" * 100 + str(n)}, options)
    assert 0 < len(forms) <= parsing.REMEMBERED and not any(len(str(value)) > parsing.SHORT for _, value in forms)


def test_parts_of_a_batch_and_nulls(spark):
    rows = [(n, None if n % 3 == 0 else json.dumps({"a": [n, "x"], "b": {"c": "" if n % 2 else "2020-01-02"}})) for n in range(2500)]
    docs = spark.createDataFrame(rows, "id int, data string").coalesce(1)
    for r in parsing.parse_documents(docs, OptionsBuilder().build(), state="state").collect():
        if r["id"] % 3 == 0:
            assert r["leaves"] is None and r["data_types"] is None and r["state"] is None
        else:
            assert [x["path"] for x in r["leaves"]] == ["a", "a", "b.c"] and r["leaves"][0]["n"] == r["id"] and r["leaves"][2]["d"] == (None if r["id"] % 2 else 1577923200000)
            assert r["data_types"] == ["a.#l", "a..#i,#s", "b.#d", "b.c.#s"] and len(r["state"]) == 32


def test_ingest_checks_rows_in_many_tasks(spark, customers):
    records = spark.read.parquet(f"{customers}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.to_json(F.struct("c_name")).alias("data"), F.col("c_custkey").alias("seq"))
    found = ingest.received(records)
    assert found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Repartition")  # dealt before Python reads a row


def test_small_archives_lie_together(spark, customers):
    db, _, _ = queries._database(spark, customers)
    every = lambda: sorted(map(str, db.search("all").docs.select("id", "version", "next", "data", "tier").collect()))
    before = every()
    result = db.resync_arcs(size=2)
    n = db.search("all").docs.where("tier = 'arc'").count()
    assert result.tiers == {f"arc-{k}": min(2, n - 2 * k) for k in range(-(-n // 2))} and n > 20
    assert {r["arc"]: r["n"] for r in db.search("all").docs.where("tier = 'arc'").groupBy("arc").agg(F.count("*").alias("n")).collect()} == {k: min(2, n - 2 * k) for k in range(-(-n // 2))}
    assert sum(len(t["has"]) for t in db.folder.manifest()["arcs"]) == 1 and every() == before


def test_a_word_has_three_rows_in_the_dictionary(spark):
    known = ["a", "ab", "abc", "license", "x" * 24, "y" * 40]
    table = words.terms(spark.createDataFrame([(x,) for x in [*known, "license"]], "token string"))
    assert table.count() == 3 * len(known)
    assert {r["token"] for r in words.near(table, "b", 2).collect()} == {"a", "ab", "abc"}
    assert {r["token"] for r in words.near(table, "x" * 22 + "zz", 2).collect()} == {"x" * 24} and words.near(table, "abc", 0).count() == 1
