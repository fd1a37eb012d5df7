"""URL filters: host and path rules, then a blocked Bloom filter with an exact join behind it. DataFrame functions only.

A listed canonical URL sets one bit in each of the four 64-bit words of its block; blocks are rows of a table. A page whose
bits are all set is a possible hit, and the hash join of possible hits with the list removes the false ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import broadcast_if_small, materialise

#: Bits of the filter for each listed URL.
BITS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that canonical URLs leave out.
TRACKING = r"^(utm_.*|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host and path without its last ``/``, then the parameters in order without those that track; null for an empty host."""
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    plain = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host_of(url) != "", F.when(F.size(kept) > 0, F.concat_ws("?", plain, F.array_join(kept, "&"))).otherwise(plain))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def listed_hits(pages: DataFrame, listed: DataFrame, bits: int = BITS) -> DataFrame:
    """``pages`` (with a column canonical) and a boolean ``listed``; ``listed`` has distinct non-null canonical."""
    names = materialise(listed.where("canonical IS NOT NULL").select("canonical").distinct())
    blocks = max(-(-names.count() * bits // 256), 1)
    words = [f"w{k}" for k in range(4)]
    bloom = names.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(*[F.bit_or(m).alias(w) for m, w in zip(_masks(F.col("canonical")), words)])
    bloom = materialise(bloom)
    keys = pages.where("canonical IS NOT NULL").select("canonical").distinct()
    near = keys.withColumn("block", _block(F.col("canonical"), blocks)).join(broadcast_if_small(bloom, 64), "block")
    for m, w in zip(_masks(F.col("canonical")), words):
        near = near.where(F.col(w).bitwiseAND(m) == m)
    hits = materialise(near.select("canonical").join(broadcast_if_small(names, 32, "canonical"), "canonical", "left_semi"))
    return pages.join(broadcast_if_small(hits.withColumn("listed", F.lit(True)), 32, "canonical"), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of (page_id, url).

    ``rules`` holds (allow or block, host, path); a rule fits its host and all hosts below it, if the path starts with the
    rule's, and the longest wins. Without a rule, a page is blocked if its canonical URL is among ``listed`` (url).
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    own = listed_hits(own, listed.select(canonical(F.col("url")).alias("canonical")))
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def first(value) -> Column:
        return F.coalesce(*[F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.lit(value(action, host, path))) for action, host, path in order], F.lit(None).cast("string"))

    verdict = F.coalesce(first(lambda a, h, p: a), F.when(F.col("listed"), "block").otherwise("allow"))
    return own.select("page_id", "host", "path", first(lambda a, h, p: h + p).alias("rule"), verdict.alias("verdict"))
