"""Sanitising of values and names, type tags, times and paths: a small kernel, and columns that do the same natively."""

from __future__ import annotations

import json
import math
import time
import unicodedata
from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of what is stripped from texts: Unicode class C without line ends and tabs.
CONTROL = r"[\p{C}&&[^\n\r\t]]"
#: Keys of the typed forms of a value.
ORIGINAL, NUMBER, DATE, BOOLEAN, TEXT, KEYWORD, POINT, SHAPE = "_u", "_n", "_d", "_b", "_t", "_k", "_gp", "_gs"


def clean(text: str, keep: str = "\n\r\t") -> str:
    return text if text.isprintable() else "".join(c for c in text if c in keep or unicodedata.category(c)[0] != "C")


def clean_text(column: Column) -> Column:
    return F.regexp_replace(column, CONTROL, "")


#: White space at the ends of a name, as Python strips it, after class C has gone.
SPACE = r"\s\p{Z}"


def field_name(name) -> str:
    """A name without control characters, dots and white space at its ends; never empty. A leading underscore becomes a hyphen,
    but for the very name ``_id``."""
    if name == "_id":
        return name
    text = clean(str(name), keep="").replace(".", "_").strip()
    if not text:
        return "-"
    return "-" + text[1:] if text.startswith("_") else text


def field_name_column(column: Column) -> Column:
    plain = F.replace(F.regexp_replace(column, r"\p{C}", ""), F.lit("."), F.lit("_"))
    plain = F.regexp_replace(plain, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(column == "_id", column).when(plain == "", "-").otherwise(F.regexp_replace(plain, "^_", "-"))


def prepare(value):
    """A value that JSON can hold: texts stripped, names mended, times as ISO texts, anything else as its text."""
    if value is None or isinstance(value, (bool, int, float)):
        return value
    if isinstance(value, str):
        return clean(value)
    if isinstance(value, dict):
        return {field_name(k): prepare(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [prepare(v) for v in value]
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.%f%z")
    return value.strftime("%Y-%m-%d") if isinstance(value, date) else str(value)


def tag(value) -> str:
    """``#`` and the first letter of the value's type."""
    for kind, letter in ((bool, "b"), (int, "i"), (float, "f"), (str, "s"), (list, "l"), (dict, "d")):
        if isinstance(value, kind):
            return "#" + letter
    if value is None:
        return "#n"
    raise TypeError(f"no tag for {type(value)}")


_SORTED = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode


def identity(value) -> str | None:
    """Text that is equal for equal values: numbers and booleans by value, keys in order; None if a NaN is within."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, bool):
            return int(x)
        if isinstance(x, float):
            if math.isnan(x):
                raise ValueError
            return int(x) if math.isfinite(x) and x == int(x) else x
        return x

    try:
        return _SORTED(plain(value))
    except ValueError:
        return None


def now() -> int:
    return int(time.time() * 1000)


def to_timestamp(moment: datetime | date) -> int:
    """Milliseconds of the epoch; moments without a zone are UTC."""
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp() * 1000)


def parse_to_timestamp(text: str, form: str) -> int:
    return to_timestamp(datetime.strptime(text, form))


def parsed_path(field: str, kind: str | None = None, full: bool = True) -> str:
    """``data.<field>.<kind>``, without the first part if not full."""
    return ".".join(([("data")] if full else []) + [field] + ([kind] if kind else []))


def text(field: str, full: bool = True) -> str:
    """Path of a field's texts."""
    return parsed_path(field, TEXT, full)


def keyword(field: str, full: bool = True) -> str:
    return parsed_path(field, KEYWORD, full)


def number(field: str, full: bool = True) -> str:
    return parsed_path(field, NUMBER, full)


def boolean(field: str, full: bool = True) -> str:
    return parsed_path(field, BOOLEAN, full)


def moment(field: str, full: bool = True) -> str:
    return parsed_path(field, DATE, full)


def point(field: str, full: bool = True) -> str:
    return parsed_path(field, POINT, full)


def shape(field: str, full: bool = True) -> str:
    return parsed_path(field, SHAPE, full)


def infer_kind(value) -> str:
    """The typed form that a search value of this type is compared with."""
    for kinds, out in ((str, KEYWORD), (bool, BOOLEAN), ((int, float), NUMBER), ((datetime, date), DATE)):
        if isinstance(value, kinds):
            return out
    raise ValueError(f"no parsed type for {type(value)}")
