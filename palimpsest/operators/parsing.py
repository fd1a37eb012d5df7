"""Typing of leaf values on reading: every value as text, keyword, number, date, boolean and geometry at once.

A parsed document has its leaves in one array, so that a predicate on a path holds if any value at that path fulfils it.
Nested JSON goes through a kernel in Arrow batches; flat columns are typed by native expressions.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import geo
from palimpsest.functions.values import BOOLEAN, DATE, KEYWORD, NUMBER, ORIGINAL, POINT, SHAPE, TEXT, parse_to_timestamp, tag
from palimpsest.operators.options import ParsingOptions

LEAF = "struct<path:string,u:string,u_type:string,t:string,k:string,n:double,d:bigint,b:boolean,lon:double,lat:double,gp:string,gs:string,box:array<double>>"
PARSED = f"data_types array<string>, parsed_types array<string>, leaves array<{LEAF}>"
_KEYS = ("path", "u", "u_type", "t", "k", "n", "d", "b", "lon", "lat", "gp", "gs", "box")
#: What counts as a number in a text; the casts of Spark and Python accept more.
NUMERIC = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
_NUMERIC = re.compile(r"\s*" + NUMERIC + r"\s*")


#: Values whose forms a worker remembers, and the longest text among them: longer ones hardly come again.
REMEMBERED, SHORT = 20_000, 200
#: What a leaf holds beside its path and its original: all from the typed forms on.
_NONE = (None,) * 10
_TAGS = {str: "#s", int: "#i", float: "#f", bool: "#b", list: "#l", dict: "#d", type(None): "#n"}
_JSON = json.JSONEncoder(ensure_ascii=False).encode


def _geo(found: dict) -> tuple:
    return found["lon"], found["lat"], found["point"], found["shape"], list(found["box"])


def _kinds(forms: tuple) -> tuple[str, ...]:
    """The kinds that a leaf (u, u_type, .., as ``_KEYS`` without the path) holds."""
    _, _, t, k, n, d, b, _, _, gp, gs, _ = forms
    found = tuple(name for x, name in ((n, NUMBER), (d, DATE), (b, BOOLEAN), (t, TEXT), (k, KEYWORD), (gp, POINT), (gs, SHAPE)) if x is not None)
    return (*found, ORIGINAL) if found and forms[0] is not None else found


class _Forms(dict):
    """(forms, kinds) of values by (type, value), under one set of options."""

    def __init__(self, options: ParsingOptions):
        super().__init__()
        self.options = options
        #: The forms of dates in their order, and whether a text must begin with four digits and a hyphen to fit.
        self.dates = [(form, form.startswith("%Y-")) for form in sorted(options.date_formats)]

    def __missing__(self, key: tuple) -> tuple[tuple, tuple[str, ...]]:
        value = key[1]
        found = self.made(value)
        if not isinstance(value, str) or len(value) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found

    def made(self, value) -> tuple[tuple, tuple[str, ...]]:
        """Of one value that is neither null nor empty."""
        options, number, when, boolean, place = self.options, None, None, None, (None,) * 5
        text = options.float_format.format(value) if isinstance(value, float) else str(value)
        if isinstance(value, str) and (found := geo.match_wkt(value)):
            place = _geo(found)
        low = text.lower()
        if isinstance(value, bool):
            boolean = value
        elif low in options.true_values or low in options.false_values:
            boolean = low in options.true_values
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            number = geo.number_of(value)  # none if it is no finite double, as a very large integer
        elif _NUMERIC.fullmatch(text):
            number = geo.number_of(text)
        year = text[4:5] == "-" and text[:4].isdecimal()
        for form, dashed in self.dates:
            if year or not dashed:
                try:
                    when = parse_to_timestamp(text, form)
                    break
                except ValueError:
                    continue
        forms = (_JSON(value), tag(value), text, text[: options.keyword_length], number, when, boolean, *place)
        return forms, _kinds(forms)


@lru_cache(maxsize=100)
def _forms(options: ParsingOptions) -> _Forms:
    return _Forms(options)


@lru_cache(maxsize=1000)
def _listed(pairs: tuple[tuple[str, str | tuple[str, ...]], ...]) -> list[str]:
    """``path.tag,tag`` of (path, tag or tags) in order."""
    every: dict[str, set] = {}
    for path, x in pairs:
        every.setdefault(path, set()).update((x,) if isinstance(x, str) else x)
    return sorted(f"{path}.{','.join(sorted(x))}" for path, x in every.items())


def _types(pairs: dict) -> list[str]:
    return (_listed if len(pairs) <= 50 else _listed.__wrapped__)(tuple(pairs))  # most documents have a form that others have too


def parse_value(value, options: ParsingOptions) -> dict:
    """The typed forms of one value that is neither null nor empty."""
    return {k: x for k, x in zip(_KEYS[1:], _forms(options).made(value)[0]) if x is not None}


def parse(data: dict, options: ParsingOptions) -> tuple[list[str], list[str], list[dict]]:
    """(data types, parsed types, leaves): types as ``path.tag,tag``, in source paths with an empty part for each list."""
    return parse_placed(data, options, False)[:3]


def parse_placed(data: dict, options: ParsingOptions, digest: bool = True) -> tuple[list[str], list[str], list[dict], str | None]:
    """What ``parse`` gives, and a digest of the parsed state."""
    tags, kinds, leaves, state = parse_rows(data, options, digest)
    return tags, kinds, [{k: x for k, x in zip(_KEYS, leaf) if x is not None} for leaf in leaves], state


def parse_rows(data: dict, options: ParsingOptions, digest: bool = True) -> tuple[list[str], list[str], list[tuple], str | None]:
    """(data types, parsed types, leaves, digest): leaves as tuples in the order of ``_KEYS``. The digest is of every leaf with its
    place, whatever the order of keys. Blanks have a place in their list and no leaf, so which blank it is makes no difference."""
    tags: dict[tuple, None] = {}
    leaves: list[tuple] = []
    places: list[tuple] = []
    lengths: list[tuple] = []
    forms, hints = _forms(options), sorted(options.geo_hints)

    def values(source: str, path: str, value, place: tuple) -> int | None:
        """The number of the leaf, if it is one."""
        if isinstance(value, dict):
            return objects(source, path, value, True, place)
        if isinstance(value, list):
            source += "."
            for n, x in enumerate(value):
                tags[source, _TAGS.get(type(x)) or tag(x)] = None
                if x is not None and x != "":
                    values(source, path, x, (*place, n) if digest else place)
            if value:  # a list as long as another with blanks at its end is another one
                lengths.append((place, len(value)))
            return None
        if value is None or value == "":
            leaves.append((path, _JSON(value), tag(value), *_NONE))
        elif value == 0 and isinstance(value, float):  # the memo takes both zeros for one
            leaves.append((path, *forms.made(value)[0]))
        else:
            leaves.append((path, *forms[type(value), value][0]))
        places.append(place)
        return len(leaves) - 1

    def objects(source: str, path: str, value: dict, within: bool, place: tuple) -> None:
        if within:
            if found := geo.match_geojson(value):
                leaves.append((path, None, None, *_NONE[5:], *_geo(found)))
                places.append(place)
            source, path = source + ".", path + "."
        own = {}
        for key, x in value.items():
            name = source + key
            tags[name, _TAGS.get(type(x)) or tag(x)] = None
            own[key] = values(name, path + key, x, (*place, key) if digest else place)
        for hint in hints:
            found = geo.match_hint(value, hint.lat_field, hint.lon_field, hint.radius_field, hint.segments) if own.get(hint.lat_field) is not None else None
            if found:
                leaves[own[hint.lat_field]] = (*leaves[own[hint.lat_field]][:8], *_geo(found))

    objects("", "", data, False, ())
    kinds = {(leaf[0], found): None for leaf in leaves if (found := _kinds(leaf[1:]))}
    lists = _types(tags), _types(kinds)
    if not digest:
        return *lists, leaves, None
    # No two leaves have one place, and parts that differ first are both keys of an object or both places in a list.
    state = (lists, sorted(lengths), sorted(zip(places, leaves), key=lambda x: x[0]))
    return *lists, leaves, hashlib.md5(repr(state).encode("utf-8", "surrogatepass")).hexdigest()


def rebuild(data):
    """What typed trees can give back: empty containers vanish from objects and are null in lists, as are empty texts there."""
    if isinstance(data, dict):
        return {k: rebuild(v) for k, v in data.items() if v not in ({}, [])}
    if isinstance(data, list):
        return [None if v in ("", {}, []) else rebuild(v) for v in data]
    return data


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to twice as many tasks as run at once, before Python works on them: a file is read by as many tasks as it has
    row groups, which hold a million small rows, and all others would wait for these."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


#: Rows, and bytes of their data, about, that are parsed at a time.
PART, PART_BYTES = 1000, 1 << 20


@lru_cache(maxsize=1000)
def _options(doc: str) -> ParsingOptions:
    return ParsingOptions.from_doc(json.loads(doc))


def parse_documents(docs: DataFrame, options: ParsingOptions | None = None, data: str = "data", option: str = "option", state: str | None = None) -> DataFrame:
    """``docs`` with data_types, parsed_types and leaves of its JSON column, and in ``state`` a digest by which equal parsed states
    are known; null data gives null.

    Without ``options``, each row has its own as JSON in the column ``option``: rows under different options are one pass.
    """
    at = docs.columns.index(data)
    types = [T.DataType.fromDDL(x) for x in ("array<string>", "array<string>", f"array<{LEAF}>")]
    own = docs.columns.index(option) if options is None else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        fields = [pa.field(k, {"n": pa.float64(), "d": pa.int64(), "b": pa.bool_(), "lon": pa.float64(), "lat": pa.float64(), "box": pa.list_(pa.float64())}.get(k, pa.string())) for k in _KEYS]
        for whole in batches:
            # Leaves take many times the place of their data: a part of the batch at a time.
            step = max(1, min(PART, PART_BYTES * whole.num_rows // max(whole.column(at).nbytes, 1)))
            for batch in (whole.slice(start, step) for start in range(0, whole.num_rows, step)):
                given = [options] * batch.num_rows if options is not None else [_options(x) if x else None for x in batch.column(own).to_pylist()]
                found = [parse_rows(json.loads(x), o, state is not None) if x else (None,) * 4 for x, o in zip(batch.column(at).to_pylist(), given)]
                leaves = [leaf for x in found for leaf in x[2] or ()]
                ends = list(accumulate((len(x[2] or ()) for x in found), initial=0))
                parts = [pa.array(x, f.type) for x, f in zip(zip(*leaves) if leaves else [()] * len(fields), fields)]
                offsets = pa.array([None if x[2] is None else end for x, end in zip(found, ends)] + ends[-1:], pa.int32())
                columns = [pa.array([x[0] for x in found], strings), pa.array([x[1] for x in found], strings), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=fields))]
                if state:
                    columns.append(pa.array([x[3] for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    names = ["data_types", "parsed_types", "leaves", *([state] if state else [])]
    types.append(T.StringType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, types))]))


def number_of(text: Column) -> Column:
    """A text as a finite number, or null."""
    value = F.when(text.rlike(rf"^\s*{NUMERIC}\s*$"), F.regexp_replace(text, r"\s", "").try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def boolean_of(text: Column, options: ParsingOptions) -> Column:
    low = F.lower(text)
    isin = lambda values: low.isin(*sorted(values)) if values else F.lit(False)
    return F.when(isin(options.true_values), True).when(isin(options.false_values), False)


def date_of(text: Column, forms: list[str]) -> Column:
    """Milliseconds of a text in the first fitting form of Spark's date patterns, or null."""
    return F.unix_millis(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]))


#: Spark's patterns of the default dates.
SPARK_FORMATS = ["y-M-d", "y-M-d'T'H:m:s.SSSSSS", "y-M-d'T'H:m:s.SSSSSSXXX"]
#: What stands for a directive of ``strptime`` in a Java pattern, and in the options' dates.
DIRECTIVES = {
    "Y": (r"(\d{4})", "year"), "m": (r"(1[0-2]|0?[1-9])", "month"), "d": (r"(3[01]|[12]\d|0?[1-9]| [1-9])", "day"), "H": (r"(2[0-3]|[01]?\d)", "hour"), "M": (r"([0-5]?\d)", "minute"), "S": (r"(6[01]|[0-5]?\d)", "second"),
    "f": (r"(\d{1,6})", "fraction"), "z": (r"(Z|[+-]\d{2}:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?)", "zone"),
}


def date_by_form(text: Column, form: str) -> Column | None:
    """Milliseconds of a text in a form of ``strptime``, natively; None for a form with other directives than the above."""
    pattern, names, at = "", [], 0
    while at < len(form):
        if form[at] == "%":
            if at + 1 == len(form) or form[at + 1] not in DIRECTIVES:
                return None
            found, name = DIRECTIVES[form[at + 1]]
            if name in names:
                return None
            pattern, names, at = pattern + found, [*names, name], at + 2
        else:
            pattern, at = pattern + (r"\s+" if form[at].isspace() else re.sub(r"([^\w])", r"\\\1", form[at])), at + 1
    whole = f"^(?i:{pattern})$"
    part = lambda name, default: F.regexp_extract(text, whole, names.index(name) + 1) if name in names else F.lit(default)
    digits = lambda name, default: F.trim(part(name, default)).try_cast("int")
    day = F.concat_ws("-", part("year", "1900"), F.trim(part("month", "1")), F.trim(part("day", "1"))).try_cast("date")
    micros = F.rpad(part("fraction", "0"), 6, "0").try_cast("bigint")
    zone = F.regexp_replace(part("zone", "Z"), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(F.upper(zone) == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60 + F.coalesce(F.substring(zone, 6, 2).try_cast("int"), F.lit(0))))
    second = digits("second", "0")
    seconds = F.unix_date(day).cast("bigint") * 86400 + digits("hour", "0") * 3600 + digits("minute", "0") * 60 + second - offset
    # Python's dates begin with the year 1 and know no leap second.
    fits = text.rlike(whole) & (digits("year", "1900") >= 1) & (second <= 59)
    return F.when(fits, F.when(seconds < 0, F.ceil((seconds * 1_000_000 + micros) / 1000)).otherwise(seconds * 1000 + F.floor(micros / 1000)).cast("bigint"))


@F.pandas_udf(T.LongType())
def _dates(text: pd.Series, forms: pd.Series) -> pd.Series:
    def first(x, every):
        for form in every:
            try:
                return parse_to_timestamp(x, form)
            except ValueError:
                continue
        return None

    return pd.Series([None if x is None else first(x, every) for x, every in zip(text, forms)], dtype="Int64")


def date_by_options(text: Column, options: ParsingOptions) -> Column:
    """Milliseconds of a text in the first fitting one of the options' forms in their order, or null: natively if all of them
    can be, else through Python."""
    forms = sorted(options.date_formats)
    found = [date_by_form(text, x) for x in forms]
    if any(x is None for x in found):
        return _dates(text, F.array(*map(F.lit, forms)))
    return F.coalesce(*found, F.lit(None).cast("bigint"))


@F.pandas_udf(T.StringType())
def _float_text(value: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else f.format(x) for x, f in zip(value, form)], dtype=object)


def text_of(column: Column, kind: str, options: ParsingOptions) -> Column:
    """A flat value as the text that the kernel gives it. A float that is whole and has at most 15 digits has these digits in
    the default form; other floats are formatted by Python, as Java rounds and writes them otherwise."""
    if kind == "boolean":
        return F.when(column, "True").when(~column, "False")
    if kind in ("double", "float"):
        wide = column.cast("double")
        formatted = _float_text(wide, F.lit(options.float_format))
        if options.float_format != ParsingOptions().float_format:
            return formatted
        plain = (wide == F.floor(wide)) & (F.abs(wide) < 1e15) & ((wide != 0) | (F.concat(wide.cast("string")) == "0.0"))
        return F.when(plain, F.floor(wide).cast("string")).otherwise(formatted)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if kind == "date":
        return F.date_format(column, "yyyy-MM-dd")
    return column.cast("string")


def _json_text(text: Column) -> Column:
    """A text as a JSON literal, with the escapes of Python's writer."""
    return F.substring(F.to_json(F.array(text)), 2, F.length(F.to_json(F.array(text))) - 2)


def leaf(path: str, column: Column, kind: str, options: ParsingOptions, finite: bool | None = None) -> Column:
    """The leaf of one flat column, natively but for floats that are not whole. ``kind`` is its Spark type; times are the texts
    that records hold for them, decimals are texts too. ``finite`` says whether a column of floats holds finite numbers alone or
    none, if that is known."""
    text = text_of(column, kind, options)
    whole, real = kind in ("int", "bigint", "smallint", "tinyint"), kind in ("double", "float")
    letter = "#i" if whole else "#f" if real else "#b" if kind == "boolean" else "#s"
    wide = column.cast("double")
    number = wide if whole or (real and finite) else F.when(F.abs(wide) < float("inf"), wide) if real else number_of(text)
    number = F.lit(None).cast("double") if real and finite is False else number
    day, moment = kind == "date", kind in ("timestamp", "timestamp_ntz")
    if (day or moment) and options.date_formats == ParsingOptions().date_formats:
        micros = F.unix_micros(column.cast("timestamp"))
        when = F.unix_date(column).cast("bigint") * 86_400_000 if day else F.call_function("div", micros, F.lit(1000))
    else:
        when = date_by_options(text, options)
    original = _json_text(text) if letter == "#s" else F.lower(text) if letter == "#b" else column.cast("string")
    fields = {"path": F.lit(path), "u": F.when(column.isNull(), "null").otherwise(original), "u_type": F.when(column.isNull(), "#n").otherwise(letter)}
    typed = {"t": text, "k": F.substring(text, 1, options.keyword_length), "n": number, "d": when, "b": column if kind == "boolean" else boolean_of(text, options)}
    fields |= {k: F.when(text != "", v) if kind == "string" else v for k, v in typed.items()}
    rest = {"lon": "double", "lat": "double", "gp": "string", "gs": "string", "box": "array<double>"}
    fields |= {k: F.lit(None).cast(t) for k, t in rest.items()}
    return F.struct(*[fields[k].alias(k) for k in _KEYS])


def flat_leaves(df: DataFrame, columns: list[str], options: ParsingOptions | None = None) -> Column:
    """The leaves of some columns of a flat table."""
    kinds = dict(df.dtypes)
    return F.array(*[leaf(c, F.col(c), kinds[c], options or ParsingOptions()) for c in columns])


#: Milliseconds by which bounds on a column of times are wider than those asked for: a part of one that is cut off, or what a clock
#: change and a time zone can shift a time without zone by.
_WIDER = {"timestamp": 1, "timestamp_ntz": 2 * 86_400_000}


def _about(df: DataFrame, column: str, kind: str, times: tuple[str, int | None, int | None] | None) -> DataFrame:
    """Rows that a range of times at the column may find: its bounds as ones of the column, which a scan can take."""
    if kind in _WIDER and times and times[0] == column:
        for bound, way, compare in ((times[1], -1, "__ge__"), (times[2], 1, "__le__")):
            if bound is not None:
                moment = F.timestamp_millis(F.lit(bound + way * _WIDER[kind])).cast(kind)
                df = df.where(getattr(F.col(column), compare)(moment))
    return df


def flat_leaf_rows(df: DataFrame, key: str, columns: list[str], options: ParsingOptions | None = None, times: tuple[str, int | None, int | None] | None = None) -> DataFrame:
    """A row (id, path and forms of a value) for each value of some columns of a flat table.

    A condition on path and value leaves the one column that it is about, and reaches the table's scan. Milliseconds of a column of
    times are no bounds that a scan knows: with the ``times`` of the condition asked for, rows that it can't find are left out.
    """
    kinds = dict(df.dtypes)
    out = None
    if (options or ParsingOptions()).date_formats != ParsingOptions().date_formats:
        times = None  # a time's text may be read as another time
    for c in columns:
        parts = [(_about(df, c, kinds[c], times), None)]
        if kinds[c] in ("double", "float"):  # apart, so that a bound on finite numbers is one on the column
            finite = F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(True))
            parts = [(df.where(finite), True), (df.where(~finite), False)]
        for part, finite in parts:
            rows = part.select(F.col(key).alias("id"), leaf(c, F.col(c), kinds[c], options or ParsingOptions(), finite).alias("x")).select("id", "x.*")
            out = rows if out is None else out.unionAll(rows)
    return out


def geo_point(lat: Column, lon: Column) -> Column:
    """(lon, lat, wkt) of two number columns in range, or null."""
    fits = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(fits, F.struct(lon.alias("lon"), lat.alias("lat")))
