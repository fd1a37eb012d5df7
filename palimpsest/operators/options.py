"""Options of parsing, and a builder for them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

#: The formats of dates that are tried by default.
DATE_FORMATS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f%z")
#: Fixed value: the longest keyword that may be asked for.
LONGEST = 32766


@dataclass(frozen=True, order=True)
class GeoHint:
    lat_field: str
    lon_field: str
    radius_field: str | None = None
    segments: int = 16


@dataclass(frozen=True)
class ParsingOptions:
    keyword_length: int = 8191
    float_format: str = "{0:.15g}"
    true_values: frozenset[str] = frozenset()
    false_values: frozenset[str] = frozenset()
    date_formats: frozenset[str] = frozenset(DATE_FORMATS)
    geo_hints: frozenset[GeoHint] = field(default_factory=frozenset)

    def to_doc(self) -> dict:
        out = asdict(self)
        out["geo_hints"] = [asdict(h) for h in sorted(self.geo_hints, key=lambda h: h.lat_field)]
        return out | {k: sorted(out[k]) for k in ("true_values", "false_values", "date_formats")}

    @classmethod
    def from_doc(cls, doc: dict) -> ParsingOptions:
        sets = {k: frozenset(doc[k]) for k in ("true_values", "false_values", "date_formats")}
        return cls(doc["keyword_length"], doc["float_format"], **sets, geo_hints=frozenset(GeoHint(**h) for h in doc["geo_hints"]))


class OptionsBuilder:
    def __init__(self, based_on: ParsingOptions | None = None):
        self._options = based_on or ParsingOptions()

    def _with(self, **changes) -> OptionsBuilder:
        self._options = replace(self._options, **changes)
        return self

    def build(self) -> ParsingOptions:
        return self._options

    def with_keyword_length(self, length: int) -> OptionsBuilder:
        if not 1 <= length <= LONGEST:
            raise ValueError(f"a keyword has 1 to {LONGEST} characters")
        return self._with(keyword_length=length)

    def with_float_format(self, form: str) -> OptionsBuilder:
        return self._with(float_format=form)

    def with_true_value(self, value: str) -> OptionsBuilder:
        return self._with(true_values=self._options.true_values | {value.lower()})

    def with_false_value(self, value: str) -> OptionsBuilder:
        return self._with(false_values=self._options.false_values | {value.lower()})

    def with_date_format(self, form: str) -> OptionsBuilder:
        return self._with(date_formats=self._options.date_formats | {form})

    def with_geo_hint(self, lat: str, lon: str, radius: str | None = None, segments: int = 16) -> OptionsBuilder:
        """One hint for each latitude field; a later one replaces it."""
        others = {h for h in self._options.geo_hints if h.lat_field != lat}
        return self._with(geo_hints=frozenset(others | {GeoHint(lat, lon, radius, segments)}))

    def clear_true_values(self) -> OptionsBuilder:
        return self._with(true_values=frozenset())

    def clear_false_values(self) -> OptionsBuilder:
        return self._with(false_values=frozenset())

    def clear_date_formats(self) -> OptionsBuilder:
        return self._with(date_formats=frozenset())

    def reset_date_formats(self) -> OptionsBuilder:
        return self._with(date_formats=frozenset(DATE_FORMATS))

    def clear_geo_hints(self) -> OptionsBuilder:
        return self._with(geo_hints=frozenset())
