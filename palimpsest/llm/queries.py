"""The queries of the training-data operators, with their production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, bpe, codes, html, langid, lm, media, minhash, packing, quality, trie, turns, urls
from palimpsest.llm.common import read

#: The host and path rules of op5, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The tables have no block list, so op5 lists the canonical URLs of advertising hosts: those with a label that begins so.
ADS = r"(^|\.)ads[^.]*\."


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(read(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, pages.where(urls.host_of(F.col("url")).rlike(ADS)), RULES)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(read(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(read(spark, sf_dir, "conversations"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.encode(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_pseudo_likelihood, op3_nearest, op4_html_text, op5_url_filter, op6_media, op7_quality, op8_bpe, op9_packing, op10_language, op11_codes, op12_turns, op13_word_bpe)
}


def _codes_sql() -> str:
    """Six rounds over exploded parts, each a nearest entry by ``arg_min`` and floored means."""
    nearest = """
        a{r} AS (SELECT id, p, x, best.e AS e, best.d AS d FROM (
            SELECT id, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS best FROM (
                SELECT q.id, q.p, q.x, c.e, list_sum([(q.x[i] - c.x[i]) * (q.x[i] - c.x[i]) for i in range(1, len(q.x) + 1)])::BIGINT AS d FROM parts q JOIN c{r} c ON q.p = c.p)
            GROUP BY id, p))"""
    means = """
        c{n} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
            SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i)::BIGINT[] AS x FROM (
                SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, 1 + (SELECT max(len(x)) FROM parts)) t(i) GROUP BY p, e, i)
            GROUP BY p, e) m ON c.p = m.p AND c.e = m.e)"""
    rounds = ",".join(x.format(r=r, n=r + 1) for r in range(codes.ROUNDS) for x in (nearest, means))
    return f"""
        WITH kept AS (
            SELECT vec_id AS id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), parts AS (
            SELECT id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) t(p)
        ), c0 AS (
            SELECT p, (row_number() OVER (PARTITION BY p ORDER BY id) - 1)::BIGINT AS e, x FROM parts QUALIFY e < 16
        ), {rounds}, {nearest.format(r=codes.ROUNDS)},
        coded AS (
            SELECT id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY id
        ), books AS (
            SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{codes.ROUNDS}
        )
        SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), books
    """


ORACLE_SQL: dict[str, str] = {
    "op11_codes": _codes_sql(),
    # One recursion over the turns of all conversations; the record's letters, then those of the rows that stay, are read off its states.
    "op12_turns": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        ), kinds AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::UBIGINT, list_reduce(
                list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
                lambda c, b: xor(c >> 8, t[(xor(c, b) % 256)::INT + 1]))) % 20 AS kind
            FROM conversations, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged
        ), looked AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN n > min(n) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' END AS fault,
                   coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] NOT IN ('su', 'ua', 'au'), false) AS odd
            FROM numbered
        ), inserted(src, mid, letters, cost) AS (
            VALUES ('-', '-', '', 0), ('s', 's', '', 0), ('u', 'u', '', 0), ('a', 'a', '', 0), ('-', 'u', 'I', 5), ('s', 'u', 'I', 5), ('u', 'a', 'I', 5), ('a', 'u', 'I', 5),
                   ('-', 'a', 'II', 10), ('s', 'a', 'II', 10)
        ), follows(mid, dst) AS (
            VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
        ), steps AS (
            SELECT conv_id, n, src, mid AS dst, letters || 'D' AS letters, cost + 2 AS cost, false AS stays, false AS same FROM looked, inserted
            UNION ALL
            SELECT conv_id, n, src, dst, letters || CASE WHEN role[1] = dst THEN 'K' ELSE 'R' END, cost + CASE WHEN role[1] = dst THEN 0 ELSE 1 END + CASE WHEN fault IS NULL THEN 0 ELSE 5 END, true, role[1] = dst
            FROM looked, inserted JOIN follows USING (mid) WHERE fault IS NULL OR fault = 'truncated'
        ), possible AS (
            SELECT * FROM steps WHERE NOT stays OR same OR dst <> 's'
        ), ways AS (
            SELECT conv_id, 0::BIGINT AS n, '-' AS state, 0 AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, n, dst, best.cost, best.audit FROM (
                SELECT w.conv_id, s.n, s.dst, min({'cost': w.cost + s.cost, 'audit': w.audit || s.letters}) AS best
                FROM ways w JOIN possible s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.n = w.n + 1 AND s.src = w.state GROUP BY ALL)
        ), sums AS (
            SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal
            FROM looked GROUP BY conv_id
        ), cheapest AS (
            SELECT w.conv_id, min({'cost': w.cost + i.cost, 'audit': w.audit || i.letters}) AS best
            FROM ways w JOIN inserted i ON i.src = w.state AND i.mid IN ('-', 'a') LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
            WHERE w.n = coalesce(s.n, 0) GROUP BY w.conv_id
        ), letters AS (
            SELECT conv_id, i, best.audit[i] AS letter, i - length(replace(best.audit[:i], 'I', '')) AS inserts FROM cheapest, range(1, length(best.audit) + 1) t(i)
        ), stays AS (
            SELECT l.conv_id, l.i, l.letter, r.role, CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS text,
                   row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) AS place,
                   (row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) = 1 AND l.letter = 'K' AND r.role[1] = 's')::INT AS system
            FROM letters l LEFT JOIN looked r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.letter <> 'I' AND r.n = l.i - l.inserts
            WHERE l.letter <> 'D'
        ), texts AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole
            FROM (SELECT *, max(system) OVER (PARTITION BY conv_id) AS led FROM stays) GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
               coalesce(s.illegal, 0) AS illegal, c.best.cost::BIGINT AS cost, c.best.audit AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
        FROM cheapest c LEFT JOIN sums s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
    """,
    # A canonical URL keeps its host, so it is listed exactly if the host is one of those listed.
    "op5_url_filter": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), ruled AS (
            SELECT page_id, host, path, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN regexp_matches(host, '(^|\.)ads[^.]*\.') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
}
