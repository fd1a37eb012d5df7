"""An inverted index over the texts of leaves, and a dictionary that finds words a few edits away.

Postings are sorted by word, so a lookup reads those of the words asked for. The dictionary holds every distinct word by each of its
three pieces: two edits leave one of them as it is, at most two characters from its place, so a lookup by what the word asked for has
there finds all candidates, and the distance itself then decides. No text is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.operators.search import tokens

POSTINGS = "token string, path string, id string, version bigint, n bigint, first int"
WORDS = "token string"
TERMS = "piece string, size int, token string"
#: Edits that the dictionary's pieces cover: one less than a word has pieces.
EDITS = 2
#: Words of a fuzzy lookup that are handed to the scan of the postings as values; more are joined.
FEW = 1000


def postings(leaves: DataFrame) -> DataFrame:
    """(token, path, id, version, n, first) of (id, version, path, t): how often a word occurs in a document's texts at a path,
    and where first."""
    rows = leaves.where("t IS NOT NULL").select("path", "id", "version", F.posexplode(tokens(F.col("t"))).alias("at", "token"))
    return rows.groupBy("token", "path", "id", "version").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def by_token(rows: DataFrame) -> DataFrame:
    """Postings in the order of words; those of a frequent word are dealt to several files by id."""
    return rows.repartitionByRange("token", "id").sortWithinPartitions("token", "path", "id")


def _starts(size):
    """Where each piece of a word of this size begins, and where the last one ends; the later ones are the longer ones. Of an integer,
    or of a column."""
    return [(k * size - k * size % (EDITS + 1)) / (EDITS + 1) for k in range(EDITS + 2)]


def terms(found: DataFrame) -> DataFrame:
    """(piece, size, token) of distinct words: size is the word's length; a piece is said with size and place."""
    words = found.select("token").distinct().withColumn("size", F.length("token"))
    ends = [x.cast("int") for x in _starts(F.col("size"))]
    pieces = [F.concat("size", F.lit(f".{k}."), F.substr("token", a + 1, b - a)) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
    return words.select(F.explode(F.array(*pieces)).alias("piece"), "size", "token")


def by_word(rows: DataFrame) -> DataFrame:
    return rows.distinct().repartitionByRange("token").sortWithinPartitions("token")


def by_piece(rows: DataFrame) -> DataFrame:
    """The dictionary in files sorted by piece. A word may come again with a later sync's; dealing by hash saves the second run over
    all words that finding ranges would take, and within its file a piece is found by the statistics of row groups. Words are dealt
    with their pieces, as many have a short piece."""
    return rows.repartition("piece", "token").sortWithinPartitions("piece")


def pieces_of(word: str, edits: int) -> set[str]:
    """The pieces of which any word within so many edits has one: of words of each size, as many more pieces as edits, the last ones,
    with what ``word`` holds at most so many characters from their places."""
    out = set()
    for size in range(max(len(word) - edits, 1), len(word) + edits + 1):
        starts = [int(x) for x in _starts(size)]
        for k in range(EDITS - edits, EDITS + 1):
            length = starts[k + 1] - starts[k]
            out |= {f"{size}.{k}.{word[at : at + length]}" for at in range(max(starts[k] - edits, 0), min(starts[k] + edits, len(word) - length) + 1)}
    return out


def near(dictionary: DataFrame, word: str, edits: int, prefix: int = 0, swaps: bool = False) -> DataFrame:
    """(token) of the words within so many edits of ``word`` that begin with the same ``prefix`` characters; ``swaps`` as of
    ``search.near``, which compares with exchanged words too: their pieces are looked up as well."""
    if edits <= EDITS:
        wanted = pieces_of(word, edits)
        for other, rest in search.exchanged(word, edits).items() if swaps else ():
            wanted |= pieces_of(other, rest)
        fits = F.col("piece").isin(sorted(wanted))
    else:  # beyond what the pieces cover, words of like lengths are compared
        fits = F.col("size").between(len(word) - edits, len(word) + edits)
    return dictionary.where(fits).select("token").distinct().where(search.near(F.col("token"), word, edits, prefix, swaps))


def documents(found: DataFrame, dictionary: Callable[[], DataFrame] | None, asked: search.Asked, field: str | None = None) -> DataFrame:
    """(id, version) of the documents that hold as many as needed of the words asked for, at a path or anywhere."""
    if field is not None:
        found = found.where(F.col("path") == field)
    wanted = asked.words
    if not wanted or asked.needed > len(wanted):
        return found.where("false").select("id", "version")
    if any(wanted.values()):
        known, hits = dictionary() if dictionary else terms(found), None
        for word, edits in wanted.items():
            own = near(known, word, edits, asked.prefix_length, asked.fuzzy_transpositions).select("token", F.lit(word).alias("asked"))
            hits = own if hits is None else hits.unionByName(own)
        few = hits.limit(FEW + 1).collect()
        if len(few) <= FEW:
            pairs = F.array(*[F.struct(F.lit(r["token"]).alias("token"), F.lit(r["asked"]).alias("asked")) for r in few]) if few else F.array().cast("array<struct<token:string,asked:string>>")
            rows = found.where(F.col("token").isin(sorted({r["token"] for r in few})))
            rows = rows.select("id", "version", F.explode(F.filter(pairs, lambda x: x["token"] == F.col("token"))["asked"]).alias("asked"))
        else:
            rows = found.join(hits, "token").select("id", "version", "asked")
    else:
        rows = found.where(F.col("token").isin(list(wanted))).select("id", "version", F.col("token").alias("asked"))
    if asked.needed == 1:
        return rows.select("id", "version").distinct()
    return rows.distinct().groupBy("id", "version").agg(F.count("*").alias("n")).where(F.col("n") >= asked.needed).select("id", "version")
