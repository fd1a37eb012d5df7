"""Predicates over the leaves of parsed documents, and a small search builder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import geo
from palimpsest.functions.values import BOOLEAN, DATE, KEYWORD, NUMBER, TEXT, infer_kind, to_timestamp
from palimpsest.operators import cells

_FIELD = {KEYWORD: "k", NUMBER: "n", DATE: "d", BOOLEAN: "b", TEXT: "t"}
#: Words of a text: numbers with inner marks, words with inner apostrophes or dots.
WORD = r"\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}_]+(?:[\x27.]\p{L}+)*"


def _value(value):
    return to_timestamp(value) if isinstance(value, date) else value


Test = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Tables:
    """What conditions are looked up in: leaves by path and value, postings, cells, the ends of documents' validity (id, version,
    next), and the dictionary of words, which is asked for when words may differ."""

    leaves: DataFrame
    postings: DataFrame | None = None
    cells: DataFrame | None = None
    ends: DataFrame | None = None
    terms: Callable[[], DataFrame] | None = None


class Condition:
    """A condition that one leaf of a document has to fulfil: over the array of its leaves, or over a table of leaves.

    ``on_leaves()`` is a column over documents; ``of_row()`` one over rows of leaves, which a scan can take; ``documents()``
    looks up (id, version) in tables.
    """

    #: Whether tables can tell its documents.
    looked_up = True

    #: A path and the least and greatest value (or None) that it asks for, if it is a range of times.
    times: tuple[str, int | None, int | None] | None = None

    def __init__(self, test: Test):
        self.test = test

    def documents(self, tables: Tables) -> DataFrame:
        return documents_of(tables.leaves, self)

    def on_leaves(self, leaves: str = "leaves") -> Column:
        return F.coalesce(F.exists(leaves, lambda x: self.test(lambda name: x[name])), F.lit(False))

    def of_row(self) -> Column:
        return self.test(F.col)


def term_of(field: str, value, kind: str | None = None) -> Condition:
    kind = kind or infer_kind(value)
    if kind == KEYWORD:
        return Condition(lambda x: (x("path") == field) & (F.lower(x("k")) == str(value).lower()))
    return Condition(lambda x: (x("path") == field) & (x(_FIELD[kind]) == F.lit(_value(value))))


def term(field: str, value, kind: str | None = None) -> Column:
    """Some value at the path equals ``value``; keywords whatever their case."""
    return term_of(field, value, kind).on_leaves()


def range_of(field: str, gte=None, lt=None, gt=None, lte=None, kind: str | None = None) -> Condition:
    given = [v for v in (gte, lt, gt, lte) if v is not None]
    if not given:
        raise ValueError("a range needs a bound")
    name = _FIELD[kind or infer_kind(given[0])]

    def test(x) -> Column:
        out = x("path") == field
        for bound, compare in ((gte, "__ge__"), (lt, "__lt__"), (gt, "__gt__"), (lte, "__le__")):
            if bound is not None:
                out = out & getattr(x(name), compare)(F.lit(_value(bound)))
        return out

    out = Condition(test)
    if name == "d":
        least, most = ([int(_value(v)) for v in x if v is not None] for x in ((gte, gt), (lt, lte)))
        out.times = (field, max(least, default=None), min(most, default=None))
    return out


def between(field: str, gte=None, lt=None, gt=None, lte=None, kind: str | None = None) -> Column:
    """Some one value at the path fulfils all the bounds."""
    return range_of(field, gte, lt, gt, lte, kind).on_leaves()


def exists_of(field: str) -> Condition:
    return Condition(lambda x: ((x("path") == field) | x("path").startswith(field + ".")) & (x("t").isNotNull() | x("gp").isNotNull()))


def exists(field: str) -> Column:
    """The path, or one below it, has a value that is not null or empty."""
    return exists_of(field).on_leaves()


def has_geo_of() -> Condition:
    return Condition(lambda x: x("lon").isNotNull())


def has_geo() -> Column:
    return has_geo_of().on_leaves()


def id_is(value: str) -> Column:
    """The record's id, whatever its case."""
    return F.lower(F.col("id").cast("string")) == value.lower()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words_of(query: str) -> list[str]:
    """The distinct words of a query, in order; as ``tokens`` finds them in a text."""
    return list(dict.fromkeys(regex.findall(WORD, query.lower())))


def _swaps(word: str) -> set[str]:
    """The word with two neighbouring characters exchanged, at each place."""
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word}


def exchanged(word: str, edits: int) -> dict[str, int]:
    """The words that stand for one with neighbours exchanged, and how many edits each allows beside."""
    exact = _swaps(word) if edits else set()
    if edits < 2:
        return dict.fromkeys(exact, 0)
    twice = set().union(*map(_swaps, {*exact, *(word[:i] + word[i + 1 :] for i in range(len(word)))}))
    return {**dict.fromkeys(twice, 0), **dict.fromkeys(exact, 1)}


def near(found: Column, word: str, edits: int, prefix: int = 0, swaps: bool = False) -> Column:
    """Whether a word is within so many edits of ``word`` and begins with the same ``prefix`` characters.

    With ``swaps`` an exchange of neighbours is one edit. The exchanges of the word asked for are known when the plan is made. An
    edit beside an exchange may come after it, or be a deletion before it; others give what plain edits or that order give.
    """
    if not edits:
        return found == word
    out = F.levenshtein(found, F.lit(word), edits) >= 0
    if swaps:
        others = exchanged(word, edits)
        for other in sorted(x for x, n in others.items() if n):
            out = out | (F.levenshtein(found, F.lit(other), 1) >= 0)
        exact = sorted(x for x, n in others.items() if not n)
        out = out | (found.isin(exact) if exact else F.lit(False))
    return out & found.startswith(word[:prefix]) if prefix else out


@dataclass(frozen=True)
class Asked:
    """What a text query asks for.

    ``fuzziness`` is a number of edits, or ``AUTO`` or ``AUTO:low,high``: none for words shorter than low (3), one for those shorter
    than high (6), else two. ``minimum_should_match`` is how many of an ``or`` query's distinct words must occur, one at least: a
    number or a share like ``75%``, rounded down; negative ones say how many may be missing. ``prefix_length`` characters of a
    word allow no edit, ``fuzzy_transpositions`` makes an exchange of neighbours one edit instead of two (for up to two edits), and
    ``zero_terms_query`` says whether a query without words finds ``none`` or ``all``.
    """

    query: str
    operator: str = "or"
    fuzziness: int | str = 0
    minimum_should_match: int | str | None = None
    prefix_length: int = 0
    fuzzy_transpositions: bool = False
    zero_terms_query: str = "none"

    def __post_init__(self):
        if self.operator.lower() not in ("or", "and") or self.zero_terms_query not in ("none", "all"):
            raise ValueError("an operator is or, and; zero_terms_query is none, all")
        if self.fuzzy_transpositions and any(n > 2 for n in self.words.values()):
            raise ValueError("exchanges are found among two edits at most")

    @property
    def words(self) -> dict[str, int]:
        """The distinct words of the query, in order, and how many edits each allows."""
        return {word: self._edits(word) for word in words_of(self.query)}

    def _edits(self, word: str) -> int:
        form = str(self.fuzziness).upper()
        if not form.startswith("AUTO"):
            return int(self.fuzziness)
        low, high = map(int, form[5:].split(",")) if form[4:] else (3, 6)
        return (len(word) >= low) + (len(word) >= high)

    @property
    def needed(self) -> int:
        """How many of the words must occur; more than there are if that can't be."""
        n = len(self.words)
        if self.operator.lower() == "and" or self.minimum_should_match is None:
            return n if self.operator.lower() == "and" else 1
        text = str(self.minimum_should_match).strip()
        size = int(n * abs(int(text[:-1])) / 100) if text.endswith("%") else abs(int(text))
        return max(n - size if text.startswith("-") else size, 1)

    @property
    def everything(self) -> bool:
        return self.zero_terms_query == "all" and not self.words

    def within(self, found: Column) -> Column:
        """Whether ``found``, the words of a text, holds as many of the words as needed."""
        words, needed = self.words, self.needed
        if not words:
            return F.lit(self.everything)
        if any(words.values()):
            like = lambda q, n: lambda w: near(w, q, n, self.prefix_length, self.fuzzy_transpositions)
            hits = [F.exists(found, like(q, n)) for q, n in words.items()]
            count = hits[0].cast("int")
            for x in hits[1:]:
                count = count + x.cast("int")
            return count >= needed
        wanted = F.array(*map(F.lit, words))
        return F.arrays_overlap(found, wanted) if needed == 1 else F.size(F.array_intersect(wanted, found)) >= needed


def match_words(found: Column, query: str, operator: str = "or", fuzziness: int | str = 0, **options) -> Column:
    """Whether ``found``, the words of a text, holds one of the query's words, or with ``and`` all of them.

    With ``fuzziness`` a word may differ by so many edits; ``options`` are those of ``Asked``.
    """
    return Asked(query, operator, fuzziness, **options).within(found)


def match(query: str, field: str | None = None, operator: str = "or", fuzziness: int | str = 0, **options) -> Column:
    """Words of the query occur in the texts at the path, or in any texts: one of them, or with ``and`` all; see ``Asked``."""
    asked = Asked(query, operator, fuzziness, **options)
    if asked.everything:
        return F.lit(True)
    here = lambda x: x["t"].isNotNull() & ((x["path"] == field) if field else F.lit(True))
    # One text, so that its words are found once; a line end is within no word.
    texts = F.array_join(F.transform(F.filter("leaves", here), lambda x: x["t"]), "\n")
    return F.coalesce(asked.within(tokens(texts)), F.lit(False))


class MatchOf(Condition):
    """Words of a query in the texts at a path, or in any: looked up in postings, with edits through the dictionary."""

    def __init__(self, query: str, field: str | None = None, operator: str = "or", fuzziness: int | str = 0, **options):
        self.asked, self.field, self.options = Asked(query, operator, fuzziness, **options), field, (query, field, operator, fuzziness, options)
        self.looked_up = not self.asked.everything

    def on_leaves(self, leaves: str = "leaves") -> Column:
        *given, options = self.options
        return match(*given, **options)

    def of_row(self) -> Column:
        """For one word, or any word, of the query: all words of an ``and`` may be in several rows."""
        if self.asked.needed > 1:
            raise ValueError("words of several leaves are no condition on one")
        here = F.coalesce(self.asked.within(tokens(F.col("t"))), F.lit(False))
        return here & (F.col("path") == self.field) if self.field else here

    def documents(self, tables: Tables) -> DataFrame:
        from palimpsest.operators import words

        if tables.postings is None:
            return tables.leaves.groupBy("id", "version").agg(F.collect_list(F.struct("path", "t")).alias("leaves")).where(self.on_leaves()).select("id", "version")
        return words.documents(tables.postings, tables.terms, self.asked, self.field)


class BoxOf(Condition):
    """A point in a box: looked up by cells."""

    def __init__(self, left: float, top: float, right: float, bottom: float):
        super().__init__(lambda x: x("lon").between(left, right) & x("lat").between(bottom, top))
        self.box = (left, top, right, bottom)

    def documents(self, tables: Tables) -> DataFrame:
        if tables.cells is None:
            return super().documents(tables)
        return cells.points_in(tables.cells, *self.box).select("id", "version").distinct()


class ShapeBoxOf(Condition):
    """A shape that meets a box: looked up by cells, then exactly."""

    def __init__(self, left: float, top: float, right: float, bottom: float):
        self.box = (left, top, right, bottom)

    def on_leaves(self, leaves: str = "leaves") -> Column:
        return shapes_in_box(*self.box)

    def of_row(self) -> Column:
        left, top, right, bottom = self.box
        box = F.col("box")
        near = box.isNotNull() & (box[0] <= right) & (box[2] >= left) & (box[1] <= top) & (box[3] >= bottom)
        inside = (box[0] >= left) & (box[2] <= right) & (box[1] >= bottom) & (box[3] <= top)
        return near & (inside | F.when(near & ~inside, _meets(F.array("gs"), *map(F.lit, map(float, self.box)))).otherwise(False))

    def documents(self, tables: Tables) -> DataFrame:
        if tables.cells is None:
            return super().documents(tables)
        found = cells.shapes_near(tables.cells, *self.box).dropDuplicates(["id", "version", "path", "gs"])
        return found.where(self.of_row()).select("id", "version").distinct()


def match_of(query: str, field: str | None = None, operator: str = "or", fuzziness: int | str = 0, **options) -> Condition:
    return MatchOf(query, field, operator, fuzziness, **options)


def shapes_of(left: float, top: float, right: float, bottom: float) -> Condition:
    return ShapeBoxOf(left, top, right, bottom)


def box_of(left: float, top: float, right: float, bottom: float) -> Condition:
    return BoxOf(left, top, right, bottom)


def points_in_box(left: float, top: float, right: float, bottom: float) -> Column:
    """A point of the document lies in the box."""
    return box_of(left, top, right, bottom).on_leaves()


@F.pandas_udf(T.BooleanType())
def _meets(shapes: pd.Series, left: pd.Series, top: pd.Series, right: pd.Series, bottom: pd.Series) -> pd.Series:
    return pd.Series([any(geo.meets_box(x, *box) for x in own) for own, *box in zip(shapes, left, bottom, right, top)])


def shapes_in_box(left: float, top: float, right: float, bottom: float) -> Column:
    """A shape of the document meets the box: by its bounds first, then, of those whose bounds reach out of it, exactly."""
    near = lambda x: x["box"].isNotNull() & (x["box"][0] <= right) & (x["box"][2] >= left) & (x["box"][1] <= top) & (x["box"][3] >= bottom)
    inside = lambda x: (x["box"][0] >= left) & (x["box"][2] <= right) & (x["box"][1] >= bottom) & (x["box"][3] <= top)
    found = F.filter("leaves", near)
    exact = _meets(F.transform(found, lambda x: x["gs"]), *map(F.lit, map(float, (left, top, right, bottom))))
    return F.coalesce(F.when(F.size(found) == 0, False).when(F.exists(found, inside), True).otherwise(exact), F.lit(False))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(id, version, and the forms of a value) for each leaf of documents: the table that conditions are looked up in."""
    return docs.select("id", "version", F.explode("leaves").alias("x")).select("id", "version", "x.*")


def documents_of(leaves: DataFrame, condition: Condition) -> DataFrame:
    """(id, version) of the documents one of whose leaves fulfils the condition."""
    return leaves.where(condition.of_row()).select("id", "version").distinct()


class Search:
    """Conditions on documents, gathered and then run as one plan.

    With tables at hand, a ``Condition`` is looked up there; a scan of their sorted files reads what is asked for. Columns, and
    conditions without tables, are tested on each document. ``keys()`` are the documents found by looking up alone: without the
    documents themselves, validity as of ``at`` (None: now; ``all``: no matter) comes from the ends of their intervals.
    """

    def __init__(self, docs: DataFrame, tables: Tables | DataFrame | None = None, at: int | str | None = None, found: tuple[tuple[str, DataFrame] | None, ...] = ()):
        self.docs = docs
        self.tables = Tables(tables) if isinstance(tables, DataFrame) else tables
        self.at, self.found = at, found

    @property
    def leaves(self) -> DataFrame | None:
        return self.tables.leaves if self.tables else None

    def _with(self, docs: DataFrame, *found: tuple[str, DataFrame] | None) -> Search:
        return Search(docs, self.tables, self.at, (*self.found, *found))

    def _looked_up(self, condition: Column | Condition) -> bool:
        return isinstance(condition, Condition) and condition.looked_up and self.tables is not None

    def _tested(self, condition: Column | Condition) -> Column:
        return condition.on_leaves() if isinstance(condition, Condition) else condition

    def filter(self, condition: Column | Condition) -> Search:
        if not self._looked_up(condition):
            return self._with(self.docs.where(self._tested(condition)), None)
        keys = condition.documents(self.tables)
        return self._with(self.docs.join(keys, ["id", "version"], "left_semi"), ("left_semi", keys))

    must = query = filter

    def must_not(self, condition: Column | Condition) -> Search:
        if not self._looked_up(condition):
            return self._with(self.docs.where(~F.coalesce(self._tested(condition), F.lit(False))), None)
        keys = condition.documents(self.tables)
        return self._with(self.docs.join(keys, ["id", "version"], "left_anti"), ("left_anti", keys))

    def should(self, *conditions: Column | Condition) -> Search:
        """One of the conditions at least. Conditions on one leaf are one lookup together; with a column among them each document
        is tested."""
        if not conditions:
            return self
        if not all(map(self._looked_up, conditions)):
            some = F.lit(False)
            for c in conditions:
                some = some | F.coalesce(self._tested(c), F.lit(False))
            return self._with(self.docs.where(some), None)
        plain = [c for c in conditions if type(c) is Condition]
        parts = [c.documents(self.tables) for c in conditions if type(c) is not Condition]
        if plain:
            row = plain[0].of_row()
            for c in plain[1:]:
                row = row | c.of_row()
            parts.append(self.tables.leaves.where(row).select("id", "version"))
        keys = parts[0]
        for x in parts[1:]:
            keys = keys.unionByName(x)
        keys = keys.distinct()
        return self._with(self.docs.join(keys, ["id", "version"], "left_semi"), ("left_semi", keys))

    def keys(self) -> DataFrame:
        """(id, version) of what is found; the documents are read only if a condition had to be tested on them."""
        if None in self.found or not self.found or self.found[0][0] != "left_semi" or self.tables is None or self.tables.ends is None:
            return self.docs.select("id", "version")
        out = self.found[0][1]
        for how, keys in self.found[1:]:
            out = out.join(keys, ["id", "version"], how)
        if self.at == "all":
            return out
        ended = self.tables.ends
        if self.at is not None:
            out, ended = out.where(F.col("version") <= self.at), ended.where(F.col("next") <= self.at)
        return out.join(ended.select("id", "version"), ["id", "version"], "left_anti")

    def source(self, *columns: str) -> Search:
        return Search(self.docs.select(*columns))

    def sort(self, *columns) -> Search:
        return Search(self.docs.orderBy(*columns))

    def __getitem__(self, part: slice) -> Search:
        start, stop = part.start or 0, part.stop
        docs = self.docs.limit(stop) if stop is not None else self.docs
        return Search(docs.offset(start) if start else docs)

    def count(self) -> int:
        return self.docs.count()

    def execute(self) -> DataFrame:
        return self.docs

    def maximum(self, column: str):
        return self.docs.agg(F.max(column)).first()[0]

    def terms(self, column: str) -> DataFrame:
        from palimpsest.operators.profile import terms

        return terms(self.docs, column)
