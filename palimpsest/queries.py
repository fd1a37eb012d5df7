"""Queries of the engine's own operators over the sample tables, each with SQL of the same result."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.database import Engine
from palimpsest.functions import geo
from palimpsest.functions.values import clean_text, field_name_column
from palimpsest.operators import cells, ingest, parsing, profile, search, versions, words
from palimpsest.operators.diffing import compressed, diff_flat, diff_json, patch_json, restored
from palimpsest.operators.options import OptionsBuilder
from palimpsest.plans import tiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPTIONS = OptionsBuilder().with_true_value("click").with_true_value("O").with_false_value("view").with_false_value("F").build()
#: A moment within the events, in milliseconds.
MOMENT = 1_704_500_000_000


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as records whose state is their last event; of one moment the last event counts. Few events share a moment, so they
    are dealt by id at once and not first by id and moment: one shuffle."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), _millis("ts").alias("version"), "event_id", "event_type", "value")
    rows = events.repartition("id").groupBy("id", "version").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("x"))
    return versions.intervals(rows.select("id", "version", "x.event_type", "x.value"))


_EVENTS = """WITH e AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS version, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
d AS (SELECT *, lead(version) OVER (PARTITION BY id ORDER BY version) AS next FROM e) """


@query(_EVENTS + "SELECT id, version, next, event_type, value FROM d")
def version_intervals(spark, sf_dir):
    return _events(spark, sf_dir).select("id", "version", "next", "event_type", "value")


@query(_EVENTS + f"SELECT event_type, count(*) AS n FROM d WHERE version <= {MOMENT} AND (next IS NULL OR next > {MOMENT}) GROUP BY 1")
def as_of_snapshot(spark, sf_dir):
    return versions.as_of(_events(spark, sf_dir), MOMENT).groupBy("event_type").agg(F.count("*").alias("n"))


@query(_EVENTS + "SELECT id, version, event_type FROM d WHERE next IS NULL")
def latest_snapshot(spark, sf_dir):
    return versions.latest(_events(spark, sf_dir)).select("id", "version", "event_type")


@query(_EVENTS + "SELECT id, count(*) AS n FROM d GROUP BY 1")
def all_versions_count(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))


@query(_EVENTS + f"SELECT 'a' AS name, count(*) AS n FROM d WHERE version <= {MOMENT} AND (next IS NULL OR next > {MOMENT}) UNION ALL SELECT 'b', count(*) FROM d WHERE version <= {MOMENT + 10**9} AND (next IS NULL OR next > {MOMENT + 10**9})")
def multi_index_versions(spark, sf_dir):
    docs = _events(spark, sf_dir)
    return versions.of_versions({"a": (docs, MOMENT), "b": (docs, MOMENT + 10**9)}).groupBy("name").agg(F.count("*").alias("n"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), _millis("o_orderdate").alias("version"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.repartition("id").groupBy("id", "version").agg(F.max_by(F.struct("o_orderstatus", "o_totalprice"), "o_orderkey").alias("x")).select("id", "version", "x.*")


_OPTIONS = [(0, 100000), (800_000_000_000, 200000), (850_000_000_000, 50000)]
_FOLD = """WITH RECURSIVE o AS (SELECT o_custkey AS id, epoch_ms(o_orderdate) AS version, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2),
h AS (SELECT id, version, CASE WHEN {alive} THEN price END AS data FROM o),
opt(version, lim) AS (VALUES (0, 100000), (800000000000, 200000), (850000000000, 50000)),
f AS (SELECT id, min(version) AS first FROM h GROUP BY 1),
g AS (SELECT id, version FROM h UNION SELECT id, opt.version FROM f, opt WHERE opt.version >= first),
j AS (SELECT g.id, g.version, CASE WHEN h.id IS NULL THEN NULL ELSE {{'v': h.data}} END AS s, opt.lim AS o FROM g LEFT JOIN h ON g.id = h.id AND g.version = h.version LEFT JOIN opt ON g.version = opt.version),
c AS (SELECT id, version, last_value(s IGNORE NULLS) OVER w AS s, coalesce(last_value(o IGNORE NULLS) OVER w, 100000) AS o FROM j WINDOW w AS (PARTITION BY id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT id, version, CASE WHEN s.v IS NOT NULL THEN (s.v >= o)::INT END AS parsed FROM c),
k AS (SELECT *, row_number() OVER w AS n, lag(parsed) OVER w AS before FROM p WINDOW w AS (PARTITION BY id ORDER BY version)),
q AS (SELECT id, version, parsed, lead(version) OVER (PARTITION BY id ORDER BY version) AS next FROM k WHERE n = 1 OR parsed IS DISTINCT FROM before)
SELECT id, version, next, parsed FROM q WHERE parsed IS NOT NULL"""


def _folded(spark, history):
    options = spark.createDataFrame(_OPTIONS, "version bigint, option int")
    parse = lambda df: df.withColumn("parsed", (F.col("data") >= F.col("option")).cast("int"))
    return versions.fold(history, options, parse).select("id", "version", "next", "parsed")


@query(_FOLD.format(alive="true"))
def options_fold(spark, sf_dir):
    return _folded(spark, _orders(spark, sf_dir).select("id", "version", F.col("o_totalprice").alias("data")))


@query(_FOLD.format(alive="status <> 'F'"))
def delete_fold(spark, sf_dir):
    return _folded(spark, _orders(spark, sf_dir).select("id", "version", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("data")))


def _batches(spark, sf_dir):
    """Two states of customers as JSON records: a third new, some deleted, some changed, some only in their time."""
    c = _table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("string"))
    old = c.where("c_custkey % 3 <> 0").select("id", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("1").alias("modified"))).alias("data"))
    gone, moved = F.col("c_custkey") % 11 == 0, (F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).alias("nation")
    stamp = F.when(F.col("c_custkey") % 5 == 0, "2").otherwise("1").alias("modified")
    new = c.select("id", F.when(~gone, F.to_json(F.struct(F.col("c_name").alias("name"), moved, stamp))).alias("data"))
    make = lambda df: df.select("id", ingest.prepared("id", "data").alias("x")).select("id", "x.data", "x.same")
    return make(new), make(old)


_INGEST = """WITH c AS (SELECT c_custkey::VARCHAR AS id, c_custkey % 3 <> 0 AS has_old, c_custkey % 11 = 0 AS gone, c_custkey % 7 = 0 AS moved, c_custkey % 5 = 0 AS stamped FROM customer)
SELECT id, CASE WHEN has_old THEN 'update' ELSE 'insert' END AS op FROM c WHERE CASE WHEN has_old THEN gone OR moved {stamped} ELSE NOT gone END"""


@query(_INGEST.format(stamped="OR stamped"))
def ingest_ops(spark, sf_dir):
    new, old = _batches(spark, sf_dir)
    return ingest.classify(new, old, old.limit(0)).select("id", "op")


@query(_INGEST.format(stamped=""))
def ingest_modified_field(spark, sf_dir):
    new, old = _batches(spark, sf_dir)
    return ingest.classify(new, old, old.limit(0), "modified").select("id", "op")


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS id, c_custkey % 3 <> 0 AS has_old, c_custkey % 2 = 0 AS has_staged, c_custkey // 6 % 4 AS k FROM customer), o AS (
SELECT id, CASE WHEN has_old AND k = 2 THEN CASE WHEN has_staged THEN 'revert' END WHEN has_old THEN 'update'
WHEN has_staged THEN CASE k WHEN 0 THEN 'delete' WHEN 1 THEN NULL ELSE 'update' END WHEN k <> 0 THEN 'insert' END AS op FROM c)
SELECT * FROM o WHERE op IS NOT NULL""")
def ingest_staged(spark, sf_dir):
    """A batch over committed and uncommitted states: deletions, what is staged already, what was before, and new data."""
    c = _table(spark, sf_dir, "customer").withColumns({"id": F.col("c_custkey").cast("string"), "k": F.expr("c_custkey div 6 % 4")})
    data = lambda more: F.to_json(F.struct(F.col("c_name").alias("name"), (F.col("c_nationkey") + more).alias("nation")))
    new = F.when(F.col("k") == 1, data(100)).when(F.col("k") == 2, data(0)).when(F.col("k") == 3, data(200))
    make = lambda df, x: df.select("id", ingest.prepared("id", x).alias("x")).select("id", "x.data", "x.same")
    return ingest.classify(make(c, new), make(c.where("c_custkey % 3 <> 0"), data(0)), make(c.where("c_custkey % 2 = 0"), data(100))).select("id", "op")


@query("SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def last_wins_dedupe(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    return ingest.last_wins(orders)


@query(r"SELECT doc_id, regexp_replace(text, '[^\n\r\t\PC]', '', 'g') AS text FROM documents")
def sanitize_strings(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


@query(r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '_id' WHEN 1 THEN ' _id' WHEN 2 THEN '_id' || chr(7) WHEN 3 THEN '__' || p_name
WHEN 4 THEN chr(9) || chr(160) || p_name || '.x' || chr(8195) ELSE chr(7) || ' ' END AS raw FROM part),
c AS (SELECT *, regexp_replace(replace(regexp_replace(raw, '\p{C}', '', 'g'), '.', '_'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS n FROM r)
SELECT p_partkey, CASE WHEN raw = '_id' THEN raw WHEN n = '' THEN '-' ELSE regexp_replace(n, '^_', '-') END AS name FROM c""")
def field_names(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_partkey") % 6
    forms = ["_id", " _id", "_id\x07", F.concat(F.lit("__"), name), F.concat(F.lit("\t\xa0"), name, F.lit(".x "))]
    raw = F.lit("\x07 ")
    for k, form in enumerate(forms):
        raw = F.when(kind == k, form).otherwise(raw)
    return _table(spark, sf_dir, "part").select("p_partkey", field_name_column(raw).alias("name"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n FROM events")
def parse_number(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", parsing.number_of(F.get_json_object("props", "$.k")).alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS b FROM orders")
def parse_boolean(spark, sf_dir):
    options = OptionsBuilder().with_true_value("o").with_false_value("f").build()
    return _table(spark, sf_dir, "orders").select("o_orderkey", parsing.boolean_of(F.col("o_orderstatus"), options).cast("int").alias("b"))


@query("SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) AS d FROM orders")
def parse_date(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _table(spark, sf_dir, "orders").select("o_orderkey", parsing.date_by_options(text, OPTIONS).alias("d"))


@query("SELECT doc_id, substr(text, 1, 40) AS k FROM documents")
def keyword_trunc(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    options = OptionsBuilder().with_keyword_length(40).build()
    return docs.select("doc_id", parsing.leaf("text", F.col("text"), "string", options)["k"].alias("k"))


def _leaves(spark, sf_dir, table: str, key: str, columns: list[str]) -> DataFrame:
    """The table of leaves of some columns: what conditions are looked up in."""
    return parsing.flat_leaf_rows(_table(spark, sf_dir, table), key, columns, OPTIONS)


def _found(leaves: DataFrame, condition: search.Condition) -> DataFrame:
    return leaves.where(condition.of_row()).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE lower(c_mktsegment) = 'building'")
def term_keyword_ci(spark, sf_dir):
    return _found(_leaves(spark, sf_dir, "customer", "c_custkey", ["c_mktsegment", "c_name"]), search.term_of("c_mktsegment", "Building"))


@query("SELECT p_partkey AS id FROM part WHERE p_size = 7")
def term_number(spark, sf_dir):
    return _found(_leaves(spark, sf_dir, "part", "p_partkey", ["p_size", "p_brand"]), search.term_of("p_size", 7))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def range_number(spark, sf_dir):
    return _found(_leaves(spark, sf_dir, "orders", "o_orderkey", ["o_totalprice", "o_orderstatus"]), search.range_of("o_totalprice", gte=100000, lt=200000))


@query("SELECT o_orderkey AS id FROM orders WHERE epoch_ms(o_orderdate) >= 820454400000")
def range_date(spark, sf_dir):
    asked = search.range_of("o_orderdate", gte=820454400000, kind="_d")
    orders = _table(spark, sf_dir, "orders")
    return _found(parsing.flat_leaf_rows(orders, "o_orderkey", ["o_orderdate", "o_orderstatus"], OPTIONS, asked.times), asked)


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity >= 4 AND l_quantity < 6")
def range_multivalue(spark, sf_dir):
    """Orders whose lines' quantities are the values of one path: the leaves are filtered before they are grouped."""
    return _found(_leaves(spark, sf_dir, "lineitem", "l_orderkey", ["l_quantity", "l_tax"]), search.range_of("l_quantity", gte=4, lt=6)).distinct()


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def exists_field(spark, sf_dir):
    return _events_json(spark, sf_dir).where(search.exists("props.k")).select("id")


def _events_data(spark, sf_dir) -> DataFrame:
    """Events as nested JSON."""
    data = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), data.alias("data"))


def _events_json(spark, sf_dir) -> DataFrame:
    return parsing.parse_documents(_events_data(spark, sf_dir), OPTIONS)


def _events_kinds(spark, sf_dir) -> DataFrame:
    """Equal events are parsed once, with their number: a profile needs no more."""
    return parsing.parse_documents(_events_data(spark, sf_dir).groupBy("data").agg(F.count("*").alias("n")), OPTIONS)


@query(r"SELECT doc_id AS id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}_]+(?:[\x27.]\p{L}+)*'), 'license') OR list_contains(regexp_extract_all(lower(text), '\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}_]+(?:[\x27.]\p{L}+)*'), 'nicht')")
def match_all_text(spark, sf_dir):
    return _leaves(spark, sf_dir, "documents", "doc_id", ["text"]).where(search.match_words(search.tokens(F.col("t")), "License nicht")).select("id")


@query(r"SELECT doc_id AS id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}_]+(?:[\x27.]\p{L}+)*'), ['und', 'nicht'])")
def match_field_and(spark, sf_dir):
    leaves = _leaves(spark, sf_dir, "documents", "doc_id", ["text", "source"]).where("path = 'text'")
    return leaves.where(search.match_words(search.tokens(F.col("t")), "Und NICHT", "and")).select("id")


@query(r"SELECT p_partkey AS id FROM part WHERE len(list_filter(regexp_extract_all(lower(p_type), '[\p{L}\p{N}_]+'), lambda w: levenshtein(w, 'mediam') <= 1)) > 0")
def match_fuzzy(spark, sf_dir):
    data = F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size")))
    docs = parsing.parse_documents(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), data.alias("data")), OPTIONS)
    return docs.where(search.match("MEDIAM", "type", fuzziness=1)).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE epoch_ms(o_orderdate) = (SELECT min(epoch_ms(o_orderdate)) FROM orders WHERE epoch_ms(o_orderdate) >= 820454400000)")
def term_date(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    first = orders.where(_millis("o_orderdate") >= 820454400000).agg(F.min(_millis("o_orderdate"))).first()[0]
    return _found(_leaves(spark, sf_dir, "orders", "o_orderkey", ["o_orderdate", "o_orderstatus"]), search.term_of("o_orderdate", first, "_d"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'")
def term_boolean(spark, sf_dir):
    return _found(_leaves(spark, sf_dir, "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"]), search.term_of("o_orderstatus", False))


@query("SELECT c_name AS id, c_nationkey FROM customer WHERE lower(c_name) = (SELECT lower(max(c_name)) FROM customer)")
def id_query(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), "c_nationkey")
    return customers.where(search.id_is(customers.agg(F.max("id")).first()[0].upper()))


@query("""WITH n AS (SELECT count(*) AS n FROM events), k AS (SELECT json_type(props, '$.k') AS t, count(*) AS n FROM events GROUP BY 1)
SELECT 'type' AS path, '#s' AS tag, n AS "count", n AS tag_count FROM n UNION ALL SELECT 'props', '#d', n, n FROM n
UNION ALL SELECT 'props.k', CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN '#i' WHEN t = 'DOUBLE' THEN '#f' ELSE '#s' END, (SELECT sum(n)::BIGINT FROM k WHERE t IS NOT NULL), n FROM k WHERE t IS NOT NULL""")
def data_fields(spark, sf_dir):
    return profile.fields(_events_kinds(spark, sf_dir), weight="n")


@query("""WITH t AS (SELECT event_type IN ('click', 'view') AS b FROM events), k AS (SELECT count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)
SELECT 'type' AS path, tag, (SELECT count(*) FROM t) AS "count", count(*) AS tag_count FROM t, (VALUES ('_t'), ('_k'), ('_u')) x(tag) GROUP BY tag
UNION ALL SELECT 'type', '_b', (SELECT count(*) FROM t), count(*) FROM t WHERE b HAVING count(*) > 0
UNION ALL SELECT 'props.k', tag, n, n FROM k, (VALUES ('_t'), ('_k'), ('_u'), ('_n')) x(tag)""")
def parsed_fields(spark, sf_dir):
    return profile.fields(_events_kinds(spark, sf_dir), "parsed_types", "n")


def _nested(spark, sf_dir) -> DataFrame:
    """Customers as nested objects with keys of their own and lists of objects, through the parsing kernel."""
    c = _table(spark, sf_dir, "customer")
    deep = F.format_string('{"o": {"k%d": {"v": %d}}, "l": [{"a": 1}, %d], "e": [], "n": null}', F.col("c_custkey") % 3, "c_custkey", "c_nationkey")
    return parsing.parse_documents(parsing.spread(c.select(F.col("c_custkey").alias("id"), deep.alias("data"))), OPTIONS)


@query("""SELECT DISTINCT 'o' AS parent, 'o.k' || c_custkey % 3 AS child FROM customer UNION ALL SELECT DISTINCT 'o.k' || c_custkey % 3, 'o.k' || c_custkey % 3 || '.v' FROM customer
UNION ALL SELECT DISTINCT 'l', 'l.' FROM customer UNION ALL SELECT DISTINCT 'l.', 'l..a' FROM customer""")
def field_hierarchy(spark, sf_dir):
    return profile.hierarchy(profile.fields(_nested(spark, sf_dir)))


@query("""WITH n AS (SELECT count(*) AS n FROM customer), k AS (SELECT 'o.k' || c_custkey % 3 AS p, count(*) AS n FROM customer GROUP BY 1)
SELECT 'o' AS path, n AS "count", '#d=' || n AS types, NULL AS parent FROM n UNION ALL SELECT 'l', n, '#l=' || n, NULL FROM n UNION ALL SELECT 'e', n, '#l=' || n, NULL FROM n
UNION ALL SELECT 'n', n, '#n=' || n, NULL FROM n UNION ALL SELECT 'l.', n, '#d=' || n || ',#i=' || n, 'l' FROM n UNION ALL SELECT 'l..a', n, '#i=' || n, 'l.' FROM n
UNION ALL SELECT p, n, '#d=' || n, 'o' FROM k UNION ALL SELECT p || '.v', n, '#i=' || n, p FROM k""")
def fields_listed(spark, sf_dir):
    listed = profile.listed(profile.fields(_nested(spark, sf_dir)))
    types = F.array_join(F.transform(F.map_entries("types"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return listed.select("path", "count", types.alias("types"), "parent")


@query("""SELECT * FROM (VALUES ('o', 'o', false, true, 'o.k0,o.k1,o.k2'), ('l', 'l', false, true, 'l.'), ('e', 'e', false, true, ''), ('n', 'n', false, false, ''), ('l.', 'l', true, true, 'l..a'), ('l..a', 'l.a', false, false, ''))
t(path, parsed_path, is_list_element, is_container, children) UNION ALL SELECT DISTINCT 'o.k' || c_custkey % 3, 'o.k' || c_custkey % 3, false, true, 'o.k' || c_custkey % 3 || '.v' FROM customer
UNION ALL SELECT DISTINCT 'o.k' || c_custkey % 3 || '.v', 'o.k' || c_custkey % 3 || '.v', false, false, '' FROM customer""")
def fields_described(spark, sf_dir):
    """What each field is, and the fields within it."""
    found = profile.described(profile.fields(_nested(spark, sf_dir)))
    return found.select("path", "parsed_path", "is_list_element", "is_container", F.array_join("children", ",").alias("children"))


@query("SELECT l_returnflag AS value, count(DISTINCT l_orderkey) AS \"count\" FROM lineitem GROUP BY 1")
def terms_of_lists(spark, sf_dir):
    lists = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return profile.terms(lists, "flags")


@query('SELECT event_type AS value, count(*) AS "count" FROM events GROUP BY 1')
def terms_composite(spark, sf_dir):
    return profile.terms(_table(spark, sf_dir, "events"), "event_type")


@query(_EVENTS + 'SELECT coalesce(a.version, b.version) AS version, coalesce(b.n, a.n) AS "count" FROM (SELECT version, count(*) AS n FROM d GROUP BY 1) a FULL JOIN (SELECT next AS version, count(*) AS n FROM d WHERE next IS NOT NULL GROUP BY 1) b ON a.version = b.version')
def version_changed_counts(spark, sf_dir):
    return profile.changed_counts(_events(spark, sf_dir))


@query(_EVENTS + 'SELECT version, count(DISTINCT id) AS "count" FROM d GROUP BY 1')
def version_changed_counts_exact(spark, sf_dir):
    return profile.changed_counts(_events(spark, sf_dir), exact=True)


@query(_EVENTS + "SELECT DISTINCT version FROM d")
def versions_list(spark, sf_dir):
    return profile.versions(_events(spark, sf_dir))


@query(_EVENTS + f"SELECT max(version) AS version FROM d WHERE version <= {MOMENT}")
def rounded_version(spark, sf_dir):
    return profile.rounded(_events(spark, sf_dir), MOMENT)


@query(_EVENTS + "SELECT max(version) AS version FROM d")
def indexed_version(spark, sf_dir):
    return profile.indexed_version(_events(spark, sf_dir))


@query(_EVENTS + "SELECT arc, least(1000, n - greatest(0, arc * 1000 - 400)) - CASE WHEN arc = 0 THEN greatest(0, least(1000, n) - 400) ELSE 0 END AS n FROM (SELECT count(*) AS n FROM d WHERE next IS NOT NULL) c, unnest(range(0, 1 + (n + 599) // 1000)) t(arc) WHERE arc = 0 OR n > 400 + (arc - 1) * 1000".replace("least(1000, n - greatest(0, arc * 1000 - 400)) - CASE WHEN arc = 0 THEN greatest(0, least(1000, n) - 400) ELSE 0 END", "CASE WHEN arc = 0 THEN least(400, n) ELSE least(1000, n - 400 - (arc - 1) * 1000) END"))
def arc_assignment(spark, sf_dir):
    """Archives of 1000 documents, the first of which holds 600 already."""
    closed = _events(spark, sf_dir).where("next IS NOT NULL")
    return tiers.assign(closed, 1000, 0, 600).groupBy("arc").agg(F.count("*").alias("n"))


@query(_EVENTS + f"SELECT 'index' AS op, id, version, next FROM d WHERE version > {MOMENT} OR next > {MOMENT}")
def incremental_sync(spark, sf_dir):
    return versions.changed_since(_events(spark, sf_dir), MOMENT)


@query(_EVENTS + f""", o AS (SELECT * FROM d WHERE next IS NOT NULL OR id % 3 <> 0), t AS (SELECT * FROM o WHERE version > {MOMENT} OR next > {MOMENT})
SELECT 'index' AS op, id, version, next FROM t
UNION ALL SELECT 'delete', id, max(next), NULL FROM t GROUP BY id HAVING bool_and(next IS NOT NULL) AND min(version) <= {MOMENT}""")
def sync_deletions(spark, sf_dir):
    """Every third user is deleted at the last moment: those that were open at the sync before leave the latest tier."""
    return versions.changed_since(_events(spark, sf_dir).where("next IS NOT NULL OR id % 3 <> 0"), MOMENT)


@query(_EVENTS + """SELECT id, version, '{"index":{"_index":"data-users-latest","_id":"' || id || ':' || version || '"}}' || chr(10) || '{"id":"' || id || '","version":' || version || ',"data":{"type":"' || event_type || '"}}' AS line FROM d""")
def index_lines(spark, sf_dir):
    ops = _events(spark, sf_dir).select(F.lit("index").alias("op"), F.col("id").cast("string").alias("id"), "version", F.to_json(F.struct(F.col("event_type").alias("type"))).alias("data"))
    return versions.serialised(ops, tiers.index_names("users")["latest"]).withColumn("id", F.col("id").cast("bigint"))


@query(_EVENTS + f""", o AS (SELECT * FROM d WHERE next IS NOT NULL OR id % 3 <> 0), g AS (SELECT id, max(next) AS version FROM o WHERE version > {MOMENT} OR next > {MOMENT} GROUP BY id HAVING bool_and(next IS NOT NULL) AND min(version) <= {MOMENT})
SELECT id, version, '{{"delete":{{"_index":"data-users-latest","_id":"' || id || ':' || version || '"}}}}' AS line FROM g""")
def delete_lines(spark, sf_dir):
    """The lines for users that leave the latest tier."""
    ops = versions.changed_since(_events(spark, sf_dir).where("next IS NOT NULL OR id % 3 <> 0"), MOMENT).where("op = 'delete'")
    ops = ops.select("op", F.col("id").cast("string").alias("id"), "version", F.lit(None).cast("string").alias("data"))
    return versions.serialised(ops, tiers.index_names("users")["latest"]).withColumn("id", F.col("id").cast("bigint"))


def _scratch(spark) -> str:
    """A folder in the one that all executors share. Those of an application lie together, so that ``clear_scratch`` finds them; a
    local session without a shared folder gets one of its own, which goes when Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    path = _scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _database(spark, sf_dir):
    """Customers as a database in the shared folder: all but every fifth, then changes, deletions and the others. Each commit is
    synced; the clock shows 1000 and 2000. Returns it and the results of both."""
    moments = iter(range(1000, 10**9, 1000))
    db = Engine(spark, _scratch(spark)).database("customers", lambda: next(moments))
    c = _table(spark, sf_dir, "customer").withColumns({"id": F.col("c_custkey").cast("string"), "seq": F.col("c_custkey")})
    data = lambda more: F.to_json(F.struct(F.col("c_name").alias("name"), (F.col("c_nationkey") + more).alias("nation")))
    first = db.ingest(c.where("c_custkey % 5 <> 0").select("id", data(0).alias("data"), "seq"))
    synced = [db.sync()]
    more = F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)
    second = db.ingest(c.select("id", F.when(F.col("c_custkey") % 11 != 0, data(more)).alias("data"), "seq"))
    return db, [first, second], [*synced, db.sync()]


_DATABASE = """WITH c AS (SELECT c_custkey::VARCHAR AS id, c_nationkey AS nation, c_custkey % 5 <> 0 AS old, c_custkey % 11 = 0 AS gone, c_custkey % 7 = 0 AS moved FROM customer),
h AS (SELECT id, 1000 AS version, nation FROM c WHERE old UNION ALL SELECT id, 2000, CASE WHEN gone THEN NULL ELSE nation + moved::INT END FROM c WHERE CASE WHEN old THEN gone OR moved ELSE NOT gone END),
d AS (SELECT id, version, lead(version) OVER (PARTITION BY id ORDER BY version) AS next, nation FROM h), t AS (SELECT *, CASE WHEN next IS NULL THEN 'latest' ELSE 'arc' END AS tier FROM d WHERE nation IS NOT NULL) """


@query(_DATABASE + "SELECT id, version::BIGINT AS version, next::BIGINT AS next, nation::BIGINT AS nation, tier FROM t")
def sync_tiers(spark, sf_dir):
    """All documents after two commits, the second synced on top of the first."""
    db, _, _ = _database(spark, sf_dir)
    return db.search("all").docs.select("id", "version", "next", F.get_json_object("data", "$.nation").cast("bigint").alias("nation"), "tier")


@query(_DATABASE + "SELECT id, version::BIGINT AS version, nation IS NULL AS gone FROM h")
def record_history(spark, sf_dir):
    db, _, _ = _database(spark, sf_dir)
    return db.history().select("id", "version", F.col("data").isNull().alias("gone"))


@query(_DATABASE + "SELECT id FROM t WHERE next IS NULL AND nation >= 10 AND nation < 15")
def leaf_lookup(spark, sf_dir):
    """A condition that is looked up in the database's table of leaves."""
    db, _, _ = _database(spark, sf_dir)
    return db.search().filter(search.range_of("nation", gte=10, lt=15)).docs.select("id")


@query(_DATABASE + ", n AS (SELECT count(*) AS n FROM t WHERE next IS NOT NULL) SELECT arc::INT AS arc, least(10, n - arc * 10) AS n FROM n, unnest(range(0, (n + 9) // 10)) a(arc)")
def resynced_arcs(spark, sf_dir):
    """Archives of ten documents, written anew."""
    db, _, _ = _database(spark, sf_dir)
    db.resync_arcs(size=10)
    return db.search("all").docs.where("tier = 'arc'").groupBy("arc").agg(F.count("*").alias("n"))


@query(_DATABASE + """SELECT 'first inserted' AS name, count(*) AS n FROM c WHERE old UNION ALL SELECT 'second inserted', count(*) FROM c WHERE NOT old AND NOT gone
UNION ALL SELECT 'second updated', count(*) FROM c WHERE old AND (gone OR moved) UNION ALL SELECT 'second deleted', 0
UNION ALL SELECT 'second indexed', count(*) FROM t WHERE version > 1000 OR next > 1000 UNION ALL SELECT 'second gone from latest', count(*) FROM c WHERE old AND gone
UNION ALL SELECT 'in archives', count(*) FROM t WHERE next IS NOT NULL UNION ALL SELECT 'last archive', 0 UNION ALL SELECT 'committed version', 2000 UNION ALL SELECT 'indexed version', 2000
UNION ALL SELECT 'new records', 1 UNION ALL SELECT 'uncommitted', 1 UNION ALL SELECT 'rolled back', 1 UNION ALL SELECT 'uncommitted then', 0 UNION ALL SELECT 'options taken back', 1
UNION ALL SELECT 'options version', 3000 UNION ALL SELECT 'same options', 0 UNION ALL SELECT 'locked', 1 UNION ALL SELECT 'locked then', 0 UNION ALL SELECT 'indices', 2
UNION ALL SELECT 'current records', count(*) FROM t WHERE next IS NULL UNION ALL SELECT 'has data', 1 UNION ALL SELECT 'has options', 1""")
def database_state(spark, sf_dir):
    """Counts and probes of a database while records and options come, are taken back and committed."""
    db, (first, second), (_, synced) = _database(spark, sf_dir)
    out = {"first inserted": first.inserted, "second inserted": second.inserted, "second updated": second.updated, "second deleted": second.deleted}
    out |= {"second indexed": synced.indexed, "second gone from latest": synced.deleted, "in archives": db.arc_status()[1], "last archive": db.arc_status()[0]}
    out |= {"committed version": db.committed_version(), "indexed version": db.indexed_version(), "indices": len(db.current_indices())}
    out["new records"] = db.ingest(db.frame([("new", {"x": 1}), ("other", None)]), commit=False).inserted
    out["uncommitted"] = int(db.has_uncommitted_data())
    out |= {"rolled back": db.rollback_records(), "uncommitted then": int(db.has_uncommitted_data())}
    options = OptionsBuilder().with_keyword_length(5).build()
    db.update_options(options, commit=False)
    out["options taken back"] = db.rollback_options()
    out |= {"options version": db.update_options(options), "same options": int(db.update_options(options) is not None)}
    with db.locks.lock("sync", why="probe"):
        out["locked"] = int(db.locks.is_locked("sync") and db.locks.metadata("sync") == {"why": "probe"})
    out |= {"locked then": int(db.locks.is_locked("sync")), "current records": db.records().where("data IS NOT NULL").count(), "has data": int(db.has_data()), "has options": int(db.has_options())}
    return spark.createDataFrame(list(out.items()), "name string, n bigint")


@query(_DATABASE + """, m AS (SELECT *, gone AND NOT old AS never FROM c), v AS (SELECT * FROM h UNION ALL SELECT id, 3000, nation + 100 FROM c WHERE id::INT % 200 = 1 AND NOT (gone AND NOT old)),
e AS (SELECT id, version, lead(version) OVER (PARTITION BY id ORDER BY version) AS next, nation FROM v)
SELECT id, version::BIGINT AS version, next::BIGINT AS next, nation::BIGINT AS nation, CASE WHEN next IS NULL THEN 'latest' ELSE 'arc' END AS tier FROM e WHERE nation IS NOT NULL""")
def layered_syncs(spark, sf_dir):
    """A third sync of every 200th customer, which writes those alone, and a compaction."""
    db, _, _ = _database(spark, sf_dir)
    c = _table(spark, sf_dir, "customer").where("c_custkey % 200 = 1 AND NOT (c_custkey % 11 = 0 AND c_custkey % 5 = 0)")
    data = F.to_json(F.struct(F.col("c_name").alias("name"), (F.col("c_nationkey") + 100).alias("nation")))
    db.ingest(c.select(F.col("c_custkey").cast("string").alias("id"), data.alias("data"), F.col("c_custkey").alias("seq")))
    db.sync()
    db.compact()
    return db.search("all").docs.select("id", "version", "next", F.get_json_object("data", "$.nation").cast("bigint").alias("nation"), "tier")


@query(_DATABASE + """, w(moment) AS (VALUES (1000), (2000)), n AS (SELECT moment, count(*) AS n FROM w, t WHERE version <= moment AND (next IS NULL OR next > moment) GROUP BY 1)
SELECT 'path' AS what, moment::BIGINT AS moment, path, tag, n AS "count", n AS other FROM n, (VALUES ('_id', '#s'), ('name', '#s'), ('nation', '#i')) p(path, tag)
UNION ALL SELECT 'changes', version, '', '', count(*) FILTER (version = 1000 OR (is_end AND NOT start_only)), count(DISTINCT id) FROM (
  SELECT id, version, false AS is_end, false AS start_only FROM t UNION ALL SELECT id, next, true, false FROM t WHERE next IS NOT NULL) GROUP BY version""")
def kept_sums(spark, sf_dir):
    """Fields as of both versions, and how many records changed at each (by ends of validity, and by ids), from the sums that the
    syncs have kept: no document is read."""
    db, _, _ = _database(spark, sf_dir)
    fields = [db.data_fields(at).select(F.lit("path").alias("what"), F.lit(at).cast("bigint").alias("moment"), "path", "tag", "count", F.col("tag_count").alias("other")) for at in (1000, 2000)]
    both = profile.summed_changes(db._sums()).join(profile.summed_changes(db._sums(), exact=True).withColumnRenamed("count", "other"), "version")
    return fields[0].unionByName(fields[1]).unionByName(both.select(F.lit("changes").alias("what"), F.col("version").alias("moment"), F.lit("").alias("path"), F.lit("").alias("tag"), "count", "other"))


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 = 0 THEN 'malformed JSON' WHEN c_custkey % 10 = 1 THEN 'no object but list' END AS reason, c_custkey % 10 > 1 AS landed FROM customer""")
def rejected_rows(spark, sf_dir):
    """An ingest with malformed rows and lists: the others land, these are listed with their reasons."""
    db = Engine(spark, _scratch(spark)).database("customers", lambda: 1000)
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("seq"), F.to_json(F.struct("c_name")).alias("data"))
    bad = F.when(F.col("seq") % 10 == 0, F.concat("data", F.lit(","))).when(F.col("seq") % 10 == 1, F.concat(F.lit("["), "data", F.lit("]"))).otherwise(F.col("data"))
    db.ingest(c.select("id", bad.alias("data"), "seq"))
    bad_rows = db.rejects().select("id", F.when(F.col("reason").startswith("malformed JSON"), "malformed JSON").otherwise(F.col("reason")).alias("reason"), F.lit(False).alias("landed"))
    return bad_rows.unionByName(db.records().select("id", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("landed")))


_WORDS = r"'\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}_]+(?:[\x27.]\p{L}+)*'"


@query(rf"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), {_WORDS}) AS found FROM documents)
SELECT 'or' AS how, id FROM w WHERE list_has_any(found, ['license', 'nicht']) UNION ALL SELECT 'and', id FROM w WHERE list_has_all(found, ['und', 'nicht'])
UNION ALL SELECT 'near', id FROM w WHERE len(list_filter(found, lambda x: levenshtein(x, 'licenze') <= 2)) > 0""")
def match_index(spark, sf_dir):
    """Words of documents through postings sorted by word; with edits through the dictionary of words."""
    leaves = _leaves(spark, sf_dir, "documents", "doc_id", ["text"]).select("path", F.col("id").cast("string").alias("id"), F.lit(1).cast("bigint").alias("version"), "t")
    posted = _written(words.by_token(words.postings(leaves)))
    tables = search.Tables(leaves, posted, terms=lambda: _written(words.by_piece(words.terms(posted))))
    asked = {"or": search.match_of("License nicht"), "and": search.match_of("Und NICHT", "text", "and"), "near": search.match_of("LICENZE", fuzziness=2)}
    parts = [c.documents(tables).select(F.lit(how).alias("how"), F.col("id").cast("bigint").alias("id")) for how, c in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(r"""WITH w AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_type || ' ' || p_name), '[\p{L}\p{N}_]+') AS found FROM part), q AS (SELECT * FROM (VALUES ('mediam', 1), ('mediam', 2), ('stel', 2), ('plted', 1), ('anodised', 3)) q(word, edits))
SELECT word, edits, id FROM q, w WHERE len(list_filter(found, lambda x: levenshtein(x, word) <= edits)) > 0""")
def near_words(spark, sf_dir):
    """Parts with a word some edits away, by pieces of words that edits leave."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    leaves = parsing.flat_leaf_rows(part, "id", ["text"], OPTIONS).select("path", F.col("id").cast("string").alias("id"), F.lit(1).cast("bigint").alias("version"), "t")
    posted = _written(words.by_token(words.postings(leaves)))
    known = _written(words.by_piece(words.terms(posted)))
    out = None
    for word, edits in (("mediam", 1), ("mediam", 2), ("stel", 2), ("plted", 1), ("anodised", 3)):
        own = words.documents(posted, lambda: known, search.Asked(word, fuzziness=edits)).select(F.lit(word).alias("word"), F.lit(edits).alias("edits"), F.col("id").cast("bigint").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


@query(rf"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), {_WORDS}) AS found FROM documents),
n AS (SELECT id, found, list_contains(found, 'license')::INT + list_contains(found, 'nicht')::INT + list_contains(found, 'und')::INT + list_contains(found, 'the')::INT AS hits FROM w)
SELECT 'two' AS how, id FROM n WHERE hits >= 2 UNION ALL SELECT 'one missing', id FROM n WHERE hits >= 3 UNION ALL SELECT 'share', id FROM n WHERE hits >= 3
UNION ALL SELECT 'auto', id FROM w WHERE list_contains(found, 'zu') AND len(list_filter(found, lambda x: levenshtein(x, 'unt') <= 1)) > 0 AND len(list_filter(found, lambda x: levenshtein(x, 'licenze') <= 2)) > 0
UNION ALL SELECT 'prefix', id FROM w WHERE len(list_filter(found, lambda x: levenshtein(x, 'licenze') <= 2 AND starts_with(x, 'lic'))) > 0
UNION ALL SELECT 'swaps', id FROM w WHERE len(list_filter(found, lambda x: damerau_levenshtein(x, 'ilcesne') <= 2)) > 0 OR len(list_filter(found, lambda x: damerau_levenshtein(x, 'nihct') <= 2)) > 0
UNION ALL SELECT 'all', id FROM w""")
def match_options(spark, sf_dir):
    """Options of text queries, through postings and the dictionary: how many words must occur, edits by a word's length, prefixes
    without edits, exchanges of neighbours as one edit, queries without words."""
    docs = _leaves(spark, sf_dir, "documents", "doc_id", ["text"]).select("path", F.col("id").cast("string").alias("id"), F.lit(1).cast("bigint").alias("version"), "t")
    posted = _written(words.by_token(words.postings(docs)))
    known = _written(words.by_piece(words.terms(posted)))
    tables = search.Tables(docs, posted, terms=lambda: known)
    four = "License nicht UND the"
    asked = {
        "two": search.match_of(four, minimum_should_match=2),
        "one missing": search.match_of(four, "text", minimum_should_match=-1),
        "share": search.match_of(four, minimum_should_match="75%"),
        "auto": search.match_of("zu unt licenze", "text", "and", "AUTO"),
        "prefix": search.match_of("licenze", fuzziness=2, prefix_length=3),
        "swaps": search.match_of("ilcesne nihct", fuzziness=2, fuzzy_transpositions=True),
        "all": search.match_of("...", zero_terms_query="all"),
    }
    out = None
    for how, condition in asked.items():
        own = (condition.documents(tables) if condition.looked_up else docs.where(condition.on_leaves())).select(F.lit(how).alias("how"), F.col("id").cast("bigint").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


def _stab_asked(name: str, table: str, moment: str) -> str:
    return f"SELECT '{name}' AS name, (lo + (hi - lo) * k // 250)::BIGINT AS moment FROM (SELECT min(epoch_us({moment}) // 1000) AS lo, max(epoch_us({moment}) // 1000) AS hi FROM {table}), range(251) r(k)"


@query(_EVENTS + f""", o AS (SELECT o_custkey AS id, epoch_us(o_orderdate) // 1000 AS version FROM orders GROUP BY 1, 2), p AS (SELECT 'users' AS name, id, version, next FROM d
UNION ALL SELECT 'customers', id, version, lead(version) OVER (PARTITION BY id ORDER BY version) FROM o),
a AS ({_stab_asked("users", "events", "ts")} UNION {_stab_asked("customers", "orders", "o_orderdate")})
SELECT a.name, moment, count(*) AS n, sum(p.version)::DOUBLE AS versions FROM a JOIN p ON a.name = p.name AND version <= moment AND (next IS NULL OR moment < next) GROUP BY 1, 2""")
def stabbed_versions(spark, sf_dir):
    """Two databases, each as of 251 versions, by one join of bins."""
    users = _events(spark, sf_dir).select(F.lit("users").alias("name"), "id", "version", "next")
    orders = versions.intervals(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), _millis("o_orderdate").alias("version")).distinct())
    docs = users.unionByName(orders.select(F.lit("customers").alias("name"), "id", "version", "next"))
    asked = None
    for name, table, moment in (("users", "events", "ts"), ("customers", "orders", "o_orderdate")):
        ends = _table(spark, sf_dir, table).agg(F.min(_millis(moment)).alias("lo"), F.max(_millis(moment)).alias("hi"))
        own = ends.select(F.lit(name).alias("name"), "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(250))).alias("k")).select("name", F.expr("lo + (hi - lo) * k div 250").alias("at"))
        asked = own if asked is None else asked.unionByName(own)
    return versions.stabbed(docs, asked).groupBy("name", F.col("at").alias("moment")).agg(F.count("*").alias("n"), F.sum("version").cast("double").alias("versions"))


@query("SELECT c_custkey::VARCHAR AS id, 1::BIGINT AS version, CASE WHEN c_custkey % 2 = 1 THEN 2 END::BIGINT AS next FROM customer UNION ALL SELECT c_custkey::VARCHAR, 2, NULL FROM customer WHERE c_custkey % 2 = 1")
def reordered_keys(spark, sf_dir):
    """A state with other blanks in a list and its keys in another order is the same version; with a swapped list, of odd customers,
    it is not."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    first = F.format_string('{"a": %d, "b": {"c": "x", "d": 2}, "x": ["", null, 1, 2]}', "n")
    second = F.when(F.col("k") % 2 == 0, F.format_string('{"x": [null, "", 1, 2], "b": {"d": 2, "c": "x"}, "a": %d}', "n")).otherwise(F.format_string('{"x": [null, "", 2, 1], "b": {"d": 2, "c": "x"}, "a": %d}', "n"))
    history = c.select("id", F.lit(1).cast("bigint").alias("version"), first.alias("data")).unionByName(c.select("id", F.lit(2).cast("bigint").alias("version"), second.alias("data")))
    options = spark.createDataFrame([(1, json.dumps(OPTIONS.to_doc()))], "version bigint, option string")
    parse = lambda rows: parsing.parse_documents(rows, state="state").withColumn("parsed", F.struct("data_types", "parsed_types", "leaves"))
    return versions.fold(history, options, parse).select("id", "version", "next")


@query("""SELECT o_orderkey AS id FROM orders WHERE lower(o_orderstatus) <> 'f' AND (o_totalprice < 50000 OR o_orderpriority = '1-URGENT' OR list_contains(regexp_extract_all(lower(o_orderpriority), '[a-z]+'), 'low'))""")
def must_not_should(spark, sf_dir):
    """Conditions on leaves that must not hold, and some of which at least one has to, all looked up."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice", "o_orderpriority", F.lit(1).cast("bigint").alias("version"))
    leaves = parsing.flat_leaf_rows(orders, "id", ["o_orderstatus", "o_totalprice", "o_orderpriority"], OPTIONS).withColumn("version", F.lit(1).cast("bigint"))
    found = search.Search(orders.select("id", "version"), leaves).must_not(search.term_of("o_orderstatus", "f"))
    return found.should(search.range_of("o_totalprice", lt=50000), search.term_of("o_orderpriority", "1-urgent"), search.match_of("LOW", "o_orderpriority")).docs.select("id")


@query('SELECT c_nationkey AS value, count(*) AS "count", (row_number() OVER (ORDER BY c_nationkey) - 1) // 7 AS page FROM customer GROUP BY 1')
def term_pages(spark, sf_dir):
    """The terms of a column in pages of seven, each asked for behind the last key of the one before."""
    pages = profile.TermPages(_table(spark, sf_dir, "customer"), "c_nationkey", _scratch(spark), size=7)
    rows = [(r["value"], r["count"], n) for n, page in enumerate(pages) for r in page]
    return spark.createDataFrame(rows, "value int, count bigint, page bigint")


@query("""WITH o AS (SELECT o_custkey AS id, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_totalprice, o_orderstatus FROM orders)
SELECT id, version, '{"n": ' || n || ', "status": "' || o_orderstatus || '", "more": {"odd": [' || n % 2 || ', 7]}}' AS data FROM o WHERE n % 9 <> 0 UNION ALL SELECT id, version, NULL FROM o WHERE n % 9 = 0""")
def delta_history(spark, sf_dir):
    """Customers' orders as states of a record, every ninth a deletion: stored as differences, written, and rebuilt."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("version"), "o_orderstatus")
    rows = orders.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("version")))
    data = F.format_string('{"n": %d, "status": "%s", "more": {"odd": [%d, 7]}}', F.col("n"), F.col("o_orderstatus"), F.col("n") % 2)
    stored = _written(compressed(rows.select("id", "version", F.when(F.col("n") % 9 != 0, data).alias("data")), every=4))
    return restored(stored).select(F.col("id").cast("bigint").alias("id"), "version", "data")


def _states(spark, sf_dir):
    """Customers before and after, as maps of texts."""
    c = _table(spark, sf_dir, "customer")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    base = F.map_from_entries(F.array(entry("name", F.col("c_name")), entry("nation", F.col("c_nationkey")), entry("old", F.col("c_mktsegment"))))
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.upper("c_mktsegment"))
    new = F.map_from_entries(F.array(entry("name", name), entry("nation", F.col("c_nationkey")), entry("new", F.col("c_acctbal"))))
    return c.select(F.col("c_custkey").alias("id"), base.alias("base"), new.alias("new"))


@query("SELECT c_custkey AS id, 'new' AS dn, 'old' AS dd, CASE WHEN c_custkey % 2 = 0 OR c_name = upper(c_mktsegment) THEN '' ELSE 'name' END AS dc FROM customer")
def diff_flat_fields(spark, sf_dir):
    d = diff_flat(F.col("base"), F.col("new"))
    return _states(spark, sf_dir).select("id", *[F.array_join(d[k], ",").alias(k) for k in ("dn", "dd", "dc")])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_mktsegment) END AS name, c_nationkey AS nation, NULL::VARCHAR AS old, true AS has_new FROM customer")
def patch_roundtrip(spark, sf_dir):
    """The older state with the differences applied: what it holds then."""
    states = _states(spark, sf_dir).select("id", F.to_json("base").alias("base"), F.to_json("new").alias("new"))
    back = patch_json(F.col("base"), diff_json(F.col("base"), F.col("new")))
    of = lambda k: F.get_json_object("back", f"$.{k}")
    return states.withColumn("back", back).select("id", of("name").alias("name"), of("nation").cast("bigint").alias("nation"), of("old").alias("old"), of("new").eqNullSafe(F.get_json_object("new", "$.new")).alias("has_new"))


@query("""WITH q AS (SELECT l_orderkey AS id, count(*) AS n, list_sort(list({'n': l_linenumber, 'q': l_quantity::BIGINT}))[1].q AS first FROM lineitem GROUP BY 1)
SELECT id, first + 1 AS changed, CASE WHEN n > 3 THEN n - 1 END AS cut, CASE WHEN n <= 3 THEN n END AS added FROM q""")
def diff_lists(spark, sf_dir):
    """An order's quantities in two states: the first is one more; of more than three the last has gone, else one came."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))).alias("x"))
    base = F.transform("x", lambda x: x["q"])
    n = F.size("base")
    new = F.concat(F.array(F.col("base")[0] + 1), F.when(n > 3, F.slice("base", 2, n - 2)).otherwise(F.concat(F.slice("base", 2, n), F.array(n.cast("bigint")))))
    states = lines.select("id", base.alias("base")).select("id", F.to_json(F.struct(F.col("base").alias("q"))).alias("base"), F.to_json(F.struct(new.alias("q"))).alias("new"))
    of = lambda path: F.get_json_object("d", f"$[0][1].{path}").cast("bigint")
    return states.select("id", diff_json("base", "new").alias("d")).select("id", of("lc[0][1]").alias("changed"), of("ld").alias("cut"), of("ln[0]").alias("added"))


@query("""SELECT l_orderkey AS id, count(*) AS n, sum(l_quantity)::DOUBLE AS total, 'q.#l,q..#i' AS types FROM lineitem GROUP BY 1""")
def list_leaves(spark, sf_dir):
    """The values of a list are leaves at the list's own path."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(F.col("l_quantity").cast("bigint")).alias("q"))).alias("data"))
    docs = parsing.parse_documents(lines, OPTIONS).withColumn("own", F.filter("leaves", lambda x: x["path"] == "q"))
    total = F.aggregate("own", F.lit(0.0), lambda a, x: a + x["n"])
    return docs.select("id", F.size("own").cast("bigint").alias("n"), total.alias("total"), F.array_join("data_types", ",").alias("types"))


@query("SELECT l_orderkey, l_linenumber, printf('%.15g', l_discount::DOUBLE) AS discount, printf('%.15g', l_extendedprice::DOUBLE) AS price, CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END AS large FROM lineitem")
def text_forms(spark, sf_dir):
    """Floats and booleans as the texts that the kernel gives them."""
    of = lambda column, kind: parsing.text_of(column.cast(kind), kind, OPTIONS)
    large = of(F.col("l_quantity") > 25, "boolean")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", of(F.col("l_discount"), "double").alias("discount"), of(F.col("l_extendedprice"), "double").alias("price"), large.alias("large"))


@query("SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 13 * 3600000 + 45 * 60000 END AS d FROM orders")
def parse_date_formats(spark, sf_dir):
    """Dates in two forms of the options; the other three are tried too."""
    options = OptionsBuilder().with_date_format("%d/%m/%Y").with_date_format("%Y.%m.%d %H:%M").build()
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(" 13:45")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", parsing.date_by_options(text, options).alias("d"))


@query("""SELECT c_custkey AS id, '{"name": "' || c_name || '", "tags": [null, ' || c_nationkey || ', null, "x"], "deep": {}}' AS data FROM customer""")
def rebuild_data(spark, sf_dir):
    """What can be rebuilt: empty containers go, and within lists empty texts too."""

    @F.pandas_udf(T.StringType())
    def rebuilt(data):
        import json

        return data.map(lambda x: json.dumps(parsing.rebuild(json.loads(x))))

    raw = F.format_string('{"name": "%s", "tags": ["", %d, {}, "x"], "none": [], "deep": {"x": {}}}', "c_name", "c_nationkey")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), rebuilt(raw).alias("data"))


_LAT, _LON = "(c_custkey * 37 % 20000) / 100.0 - 100", "(c_custkey * 91 % 36000) / 100.0 - 180"


def _points(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    lat, lon = F.expr(_LAT).cast("double"), F.expr(_LON).cast("double")
    return c.select(F.col("c_custkey").alias("id"), parsing.geo_point(lat, lon).alias("p"), lat.alias("lat"), lon.alias("lon"))


@query(f"SELECT c_custkey AS id, round({_LAT}, 4)::DOUBLE AS lat, round({_LON}, 4)::DOUBLE AS lon FROM customer WHERE {_LAT} BETWEEN -90 AND 90")
def geo_hint_points(spark, sf_dir):
    return _points(spark, sf_dir).where("p IS NOT NULL").select("id", F.round("p.lat", 4).alias("lat"), F.round("p.lon", 4).alias("lon"))


def _wkt_docs(spark, sf_dir):
    """Customers with their points as WKT texts, through the parsing kernel."""
    points = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey * 37 % 200 - 100").alias("lat"), F.expr("c_custkey * 91 % 360 - 180").alias("lon"))
    return parsing.parse_documents(parsing.spread(points.select("id", F.format_string('{"where": "POINT (%d %d)"}', "lon", "lat").alias("data"))), OPTIONS)


@query("SELECT c_custkey AS id, format('POINT ({} {})', c_custkey * 91 % 360 - 180, c_custkey * 37 % 200 - 100) AS gp FROM customer WHERE c_custkey * 37 % 200 - 100 BETWEEN -90 AND 90")
def wkt_points(spark, sf_dir):
    return _wkt_docs(spark, sf_dir).select("id", F.col("leaves")[0]["gp"].alias("gp")).where("gp IS NOT NULL")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey * 37 % 200 - 100 BETWEEN -90 AND 90")
def has_geo(spark, sf_dir):
    return _wkt_docs(spark, sf_dir).where(search.has_geo()).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey * 37 % 200 - 100 BETWEEN 10 AND 50 AND c_custkey * 91 % 360 - 180 BETWEEN -20 AND 60")
def geo_bbox_points(spark, sf_dir):
    return _wkt_docs(spark, sf_dir).where(search.points_in_box(-20, 50, 60, 10)).select("id")


def _cells(docs: DataFrame) -> search.Tables:
    leaves = search.leaf_rows(docs.select(F.col("id").cast("string").alias("id"), F.lit(1).cast("bigint").alias("version"), "leaves"))
    return search.Tables(leaves, cells=_written(cells.by_cell(cells.rows(leaves))))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey * 37 % 200 - 100 BETWEEN 10 AND 50 AND c_custkey * 91 % 360 - 180 BETWEEN -20 AND 60")
def cells_of_points(spark, sf_dir):
    """Points in a box, through ranges of cells of a sorted table."""
    return search.box_of(-20, 50, 60, 10).documents(_cells(_wkt_docs(spark, sf_dir))).select(F.col("id").cast("bigint").alias("id"))


_X, _Y = "(c_custkey * 91 % 350 - 175)", "(c_custkey * 37 % 170 - 85)"


def _shapes(spark, sf_dir, form: str, *parts: str) -> DataFrame:
    """Customers with a shape at a place of their own, through the parsing kernel."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string(form, *[F.expr(x).cast("int") for x in parts]).alias("data"))
    return parsing.parse_documents(parsing.spread(c), OPTIONS)


@query(f"SELECT c_custkey AS id, {_X} + 1.0::DOUBLE AS lon, {_Y}::DOUBLE AS lat, format('LINESTRING ({{}} {{}}, {{}} {{}})', {_X}, {_Y}, {_X} + 2, {_Y}) AS gs FROM customer")
def wkt_lines(spark, sf_dir):
    docs = _shapes(spark, sf_dir, '{"way": "lineString (%d %d, %d %d)"}', _X, _Y, f"{_X} + 2", _Y)
    return docs.select("id", F.col("leaves")[0]["lon"].alias("lon"), F.col("leaves")[0]["lat"].alias("lat"), F.col("leaves")[0]["gs"].alias("gs"))


def _squares(spark, sf_dir) -> DataFrame:
    """GeoJSON squares; those of even customers wind as the standard asks, those of odd ones the other way."""
    x, y = (_X, f"{_X} + 2"), (_Y, f"{_Y} + 2")
    first, second = (f"CASE WHEN c_custkey % 2 = 0 THEN {a} ELSE {b} END" for a, b in ((x[1], x[0]), (y[0], y[1])))
    third, fourth = (f"CASE WHEN c_custkey % 2 = 0 THEN {a} ELSE {b} END" for a, b in ((x[0], x[1]), (y[1], y[0])))
    form = '{"area": {"type": "Polygon", "coordinates": [[[%d, %d], [%d, %d], [%d, %d], [%d, %d], [%d, %d]]]}}'
    return _shapes(spark, sf_dir, form, x[0], y[0], first, second, x[1], y[1], third, fourth, x[0], y[0])


@query(f"SELECT c_custkey AS id, {_X} + 1.0::DOUBLE AS lon, {_Y} + 1.0::DOUBLE AS lat FROM customer WHERE c_custkey % 2 = 0")
def geojson_winding(spark, sf_dir):
    own = F.filter("leaves", lambda x: (x["path"] == "area") & x["gs"].isNotNull())
    return _squares(spark, sf_dir).where(search.has_geo()).select("id", F.round(own[0]["lon"], 6).alias("lon"), F.round(own[0]["lat"], 6).alias("lat"))


@query(f"SELECT c_custkey AS id FROM customer WHERE {_X} <= 30 AND {_X} + 4 >= -40 AND {_Y} <= 20 AND {_Y} + 4 >= -10 AND greatest({_X}, -40) - {_X} + greatest({_Y}, -10) - {_Y} <= 4")
def geo_bbox_shapes(spark, sf_dir):
    """Triangles that meet a box: where only their bounds do, they are no hit."""
    docs = _shapes(spark, sf_dir, '{"area": "POLYGON ((%d %d, %d %d, %d %d, %d %d))"}', _X, _Y, f"{_X} + 4", _Y, _X, f"{_Y} + 4", _X, _Y)
    return docs.where(search.shapes_in_box(-40, 20, 30, -10)).select("id")


@query(f"SELECT c_custkey AS id FROM customer WHERE {_X} <= 30 AND {_X} + 4 >= -40 AND {_Y} <= 20 AND {_Y} + 4 >= -10 AND greatest({_X}, -40) - {_X} + greatest({_Y}, -10) - {_Y} <= 4")
def cells_of_shapes(spark, sf_dir):
    """Triangles that meet a box, through ranges of cells on each level."""
    docs = _shapes(spark, sf_dir, '{"area": "POLYGON ((%d %d, %d %d, %d %d, %d %d))"}', _X, _Y, f"{_X} + 4", _Y, _X, f"{_Y} + 4", _X, _Y)
    return search.shapes_of(-40, 20, 30, -10).documents(_cells(docs)).select(F.col("id").cast("bigint").alias("id"))


@query(f"""WITH r AS (SELECT s_suppkey AS id, s_suppkey * 37 % 240 - 120 AS lat, s_suppkey * 91 % 300 - 150 AS lon, s_suppkey % 3 AS k FROM supplier)
SELECT id, lon::DOUBLE AS lon, lat::DOUBLE AS lat, k = 2 AND lat BETWEEN -89 AND 89 AS round FROM r WHERE lat BETWEEN -90 AND 90""")
def geo_hint_shapes(spark, sf_dir):
    """Hints of the options: numbers or numeric texts in range are a point, with a positive radius a circle around it."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.format_string('{"lat": %d, "lon": "%d", "rad": %s}', F.expr("s_suppkey * 37 % 240 - 120").cast("int"), F.expr("s_suppkey * 91 % 300 - 150").cast("int"), F.expr("element_at(array('0', '-5', '12.5'), cast(s_suppkey % 3 + 1 as int))")).alias("data"))
    docs = parsing.parse_documents(s, OptionsBuilder().with_geo_hint("lat", "lon", "rad").build())
    own = F.filter("leaves", lambda x: x["path"] == "lat")[0]
    return docs.where(search.has_geo()).select("id", own["lon"].alias("lon"), own["lat"].alias("lat"), own["gs"].startswith("POLYGON").alias("round"))


@query()
def geo_circles(spark, sf_dir):
    """A circle around each supplier's point; SQL has no geodesic, tests hold its radius."""

    @F.pandas_udf(T.StringType())
    def ring(lat, lon, radius):
        import pandas as pd

        return pd.Series([geo.wkt("polygon", [geo.circle(a, b, r, 8)]) for a, b, r in zip(lat, lon, radius)])

    s = _table(spark, sf_dir, "supplier").withColumns({"lat": F.expr("(s_suppkey * 37 % 120) - 60.0").cast("double"), "lon": F.expr("(s_suppkey * 91 % 300) - 150.0").cast("double")})
    return s.select(F.col("s_suppkey").alias("id"), ring("lat", "lon", F.lit(1000.0)).alias("circle"))


@query("SELECT s_suppkey AS id, k::INT AS place, 1000.0::DOUBLE AS metres, ((450 - 11.25 * k) % 360)::DOUBLE AS bearing FROM supplier, range(33) r(k)")
def circle_vertices(spark, sf_dir):
    """How far from its middle, and in which direction, each vertex of the circles of ``geo_circles`` lies: measured in space, between
    points of the ellipsoid. At this radius a chord is a micrometre shorter than the way on the ground."""
    squeezed = geo.FLAT * (2 - geo.FLAT)

    def in_space(lon, lat):
        lon, lat = F.radians(lon), F.radians(lat)
        across = F.lit(geo.AXIS) / F.sqrt(1 - squeezed * F.sin(lat) ** 2)
        return across * F.cos(lat) * F.cos(lon), across * F.cos(lat) * F.sin(lon), across * (1 - squeezed) * F.sin(lat)

    middle = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("(s_suppkey * 37 % 120) - 60.0").cast("double").alias("lat"), F.expr("(s_suppkey * 91 % 300) - 150.0").cast("double").alias("lon"))
    ring = F.split(F.regexp_extract("circle", r"POLYGON \(\((.*)\)\)", 1), ", ")
    vertices = geo_circles(spark, sf_dir).select("id", F.posexplode(ring).alias("place", "vertex")).join(middle, "id")
    own, other = in_space(F.col("lon"), F.col("lat")), in_space(*(F.split("vertex", " ")[i].cast("double") for i in (0, 1)))
    x, y, z = (b - a for a, b in zip(own, other))
    lon, lat = F.radians("lon"), F.radians("lat")
    east, north = y * F.cos(lon) - x * F.sin(lon), z * F.cos(lat) - F.sin(lat) * (x * F.cos(lon) + y * F.sin(lon))
    bearing = F.pmod(F.round(F.degrees(F.atan2(east, north)), 2), F.lit(360.0)) + F.lit(0.0)
    return vertices.select("id", "place", F.round(F.sqrt(x**2 + y**2 + z**2), 3).alias("metres"), bearing.alias("bearing"))
