"""Metadata filters, given as dictionaries, compiled to one boolean column.

A predicate on a key holds only for rows that have the key. Dictionaries of the
AND filter are conjunctions, within and among each other; all keys of all OR
dictionaries are alternatives; the exclude filter drops rows that equal any of
its values. Two bindings say how keys are read: Columns takes typed columns, so
that predicates reach the scan, and Tagged takes a map of tagged values, which
has Python's comparison rules between types.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Filter = Mapping[str, Any] | Sequence[Mapping[str, Any]] | None

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
OPERATORS = (*_COMPARE, "$ne", "$in")


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return "num"
    if isinstance(value, str):
        return "str"
    if isinstance(value, (datetime, date)):
        return "ts"
    if isinstance(value, (list, tuple)):
        return "list"
    return "dict" if isinstance(value, Mapping) else "other"


def canonical(value: Any) -> str:
    """A string that is equal for two values exactly where Python's == is."""
    kind = kind_of(value)
    if kind == "num":
        whole = isinstance(value, float) and value.is_integer()
        return f"n:{int(value) if whole or not isinstance(value, float) else repr(value)}"
    if kind == "list":
        inner = [canonical(v) for v in value]
        return f"{'u' if isinstance(value, tuple) else 'l'}:" + "".join(f"{len(c)}:{c}" for c in inner)
    if kind == "dict":
        pairs = sorted((canonical(k), canonical(v)) for k, v in value.items())
        return "d:" + "".join(f"{len(c)}:{c}" for pair in pairs for c in pair)
    if kind == "ts":
        return f"t:{value.isoformat()}"
    return {"null": "z:", "str": f"s:{value}"}.get(kind, f"o:{value!r}")


#: A tagged metadata value.
TAGGED = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("str", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("canon", T.StringType()),
])
METADATA = T.MapType(T.StringType(), TAGGED)


def encode_metadata(metadata: Mapping[str, Any] | None) -> dict[str, tuple]:
    """A metadata dictionary as a map of tagged values."""
    out = {}
    for key, value in (metadata or {}).items():
        kind = kind_of(value)
        stamp = datetime(value.year, value.month, value.day) if kind == "ts" and not isinstance(value, datetime) else value
        items = [canonical(v) for v in value] if kind in ("list", "dict") else None
        name = value if kind == "str" else type(value).__name__ if kind == "num" else None  # of a number its type, which a bool would lose
        out[key] = (kind, float(value) if kind == "num" else None, name, stamp if kind == "ts" else None, items, canonical(value))
    return out


@F.pandas_udf(T.StringType())
def _canonical_fractions(values: pd.Series) -> pd.Series:
    return values.map(canonical)


def tagged(rows: DataFrame, columns: Sequence[str]) -> Column:
    """Typed columns (text, numbers, timestamps and dates) as one map of tagged values, as encode_metadata gives them; nulls have no entry."""

    def value(name: str) -> Column:
        kind, own = rows.schema[name].dataType, F.col(name)
        none = {f.name: F.lit(None).cast(f.dataType) for f in TAGGED.fields}
        if isinstance(kind, T.StringType):
            own = none | {"kind": F.lit("str"), "str": own, "canon": F.concat(F.lit("s:"), own)}
        elif isinstance(kind, T.IntegralType):
            own = none | {"kind": F.lit("num"), "num": own.cast("double"), "str": F.lit("int"), "canon": F.concat(F.lit("n:"), own.cast("string"))}
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            own = none | {"kind": F.lit("num"), "num": own.cast("double"), "str": F.lit("float"), "canon": _canonical_fractions(own.cast("double"))}
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            stamp = own.cast("timestamp_ntz")
            whole = "yyyy-MM-dd" if isinstance(kind, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss"
            fraction = F.when(F.date_format(stamp, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(stamp, "SSSSSS"))).otherwise("")
            own = none | {"kind": F.lit("ts"), "ts": stamp, "canon": F.concat(F.lit("t:"), F.date_format(stamp, whole), fraction)}
        else:
            raise TypeError(f"{name}: {kind.simpleString()} has no tagged form")
        return F.struct(F.lit(name).alias("key"), F.when(F.col(name).isNotNull(), F.struct(*[own[f.name].alias(f.name) for f in TAGGED.fields])).alias("value"))

    entries = F.filter(F.array(*[value(c) for c in columns]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries).cast(METADATA)


def _parts(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        colon = text.index(":", at)
        end = colon + 1 + int(text[at:colon])
        out.append(text[colon + 1 : end])
        at = end
    return out


def from_canonical(text: str) -> Any:
    """The value of a canonical string; bools come back as numbers, other objects as their text."""
    kind, _, rest = text.partition(":")
    if kind == "n":
        return int(rest) if rest.lstrip("-").isdigit() else float(rest)
    if kind in ("l", "u"):
        inner = [from_canonical(p) for p in _parts(rest)]
        return tuple(inner) if kind == "u" else inner
    if kind == "d":
        inner = [from_canonical(p) for p in _parts(rest)]
        return dict(zip(inner[::2], inner[1::2], strict=True))
    if kind == "t":
        return datetime.fromisoformat(rest) if "T" in rest else date.fromisoformat(rest)
    return None if kind == "z" else rest


def decode_metadata(tagged: Mapping[str, Any] | None) -> dict[str, Any]:
    """The metadata dictionary of a map of tagged values."""
    kinds = {"bool": bool, "float": float}
    values = {key: (from_canonical(v["canon"]), v) for key, v in (tagged or {}).items()}
    return {key: kinds[v["str"]](value) if v["kind"] == "num" and v["str"] in kinds else value for key, (value, v) in values.items()}


class Binding(Protocol):
    def present(self, key: str) -> Column: ...
    def equals(self, key: str, value: Any) -> Column: ...
    def compares(self, key: str, operator: str, value: Any, strict: bool) -> Column: ...
    def contains(self, key: str, value: Any, strict: bool) -> Column: ...


def _mismatch(strict: bool, present: Column, text: str) -> Column:
    """What a comparison without an order gives on rows that have the key."""
    return F.when(present, F.raise_error(F.lit(f"TypeError: {text}")).cast("boolean")).otherwise(F.lit(False)) if strict else F.lit(False)


class Columns:
    """Keys are columns of a schema; a null is a missing key."""

    def __init__(self, schema: T.StructType, names: Mapping[str, str] | None = None) -> None:
        self.names = dict(names or {f.name: f.name for f in schema.fields})
        self.types = {key: schema[name].dataType for key, name in self.names.items()}

    def _kind(self, key: str) -> str:
        kind = self.types[key]
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            return "num"
        if isinstance(kind, T.StringType):
            return "str"
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "ts"
        return "list" if isinstance(kind, T.ArrayType) else "dict" if isinstance(kind, (T.MapType, T.StructType)) else "other"

    def _column(self, key: str) -> Column:
        column = F.col(self.names[key])
        return column.cast("int") if isinstance(self.types[key], T.BooleanType) else column

    @staticmethod
    def _value(value: Any) -> Column:
        return F.lit(int(value)) if isinstance(value, bool) else F.lit(value)

    def present(self, key: str) -> Column:
        return F.col(self.names[key]).isNotNull() if key in self.names else F.lit(False)

    def equals(self, key: str, value: Any) -> Column:
        if key not in self.names or kind_of(value) != self._kind(key) or _is_nan(value) or isinstance(value, (Mapping, tuple)):
            return F.lit(False)
        if isinstance(value, list):
            inner = Columns(T.StructType([T.StructField("e", self.types[key].elementType)]))._kind("e")
            if any(kind_of(v) != inner for v in value):
                return F.lit(False)
            return self._column(key) == F.array(*[self._value(v) for v in value]).cast(self.types[key])
        return self._column(key) == self._value(value)

    def compares(self, key: str, operator: str, value: Any, strict: bool) -> Column:
        if key not in self.names:
            return F.lit(False)
        kind = kind_of(value)
        if kind != self._kind(key) or kind not in ("num", "str", "ts"):
            return _mismatch(strict, self.present(key), f"{operator} between {self._kind(key)} and {kind}")
        if _is_nan(value):
            return F.lit(False)
        column = self._column(key)
        out = _COMPARE[operator](column, self._value(value))
        return out & ~F.isnan(column) if isinstance(self.types[key], (T.DoubleType, T.FloatType)) else out

    def contains(self, key: str, value: Any, strict: bool) -> Column:
        if key not in self.names:
            return F.lit(False)
        kind = self._kind(key)
        if kind == "str" and isinstance(value, str):
            return F.contains(self._column(key), F.lit(value))
        if kind == "list":
            element = self.types[key].elementType
            same = kind_of(value) == Columns(T.StructType([T.StructField("e", element)]))._kind("e")
            return F.array_contains(self._column(key), self._value(value)) if same else F.lit(False)
        if isinstance(self.types[key], T.MapType) and isinstance(value, str):
            return F.map_contains_key(self._column(key), F.lit(value))
        return _mismatch(strict, self.present(key), f"$in on {kind}")


def _is_nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)


class Tagged:
    """Keys are entries of a map column of tagged values (METADATA); an entry may hold a null value."""

    def __init__(self, column: str = "metadata") -> None:
        self.column = column

    def _entry(self, key: str) -> Column:
        return F.try_element_at(F.col(self.column), F.lit(key))

    def present(self, key: str) -> Column:
        return F.coalesce(F.map_contains_key(F.col(self.column), F.lit(key)), F.lit(False))

    def equals(self, key: str, value: Any) -> Column:
        return F.lit(False) if _is_nan(value) else self._entry(key)["canon"] == F.lit(canonical(value))

    def compares(self, key: str, operator: str, value: Any, strict: bool) -> Column:
        kind = kind_of(value)
        if kind not in ("num", "str", "ts"):
            return _mismatch(strict, self.present(key), f"{operator} with {kind}")
        entry = self._entry(key)
        literal = F.lit(float(value)) if kind == "num" else F.lit(value).cast("timestamp_ntz") if kind == "ts" else F.lit(value)
        out = F.lit(False) if _is_nan(value) else _COMPARE[operator](entry[kind], literal)
        if kind == "num":
            out = out & ~F.isnan(entry["num"])
        return F.when(entry["kind"] == kind, out).otherwise(_mismatch(strict, self.present(key), f"{operator} with {kind}"))

    def contains(self, key: str, value: Any, strict: bool) -> Column:
        entry = self._entry(key)
        inside = F.contains(entry["str"], F.lit(value)) if isinstance(value, str) else _mismatch(strict, self.present(key), "$in on str needs a str")
        items = F.lit(False) if _is_nan(value) else F.array_contains(entry["items"], F.lit(canonical(value)))
        return F.when(entry["kind"] == "str", inside).when(entry["kind"].isin("list", "dict"), items).otherwise(_mismatch(strict, self.present(key), "$in needs a container"))


def _dicts(given: Filter) -> list[Mapping[str, Any]]:
    if not given:
        return []
    return [given] if isinstance(given, Mapping) else list(given)


def _predicate(binding: Binding, key: str, wanted: Any, multi_op: str, strict: bool) -> Column:
    """Whether a row has the key and its value is as wanted; plain comparisons, so that they reach the scan."""
    if not isinstance(wanted, Mapping):
        test = binding.equals(key, wanted)
    else:
        if not wanted:
            raise ValueError("an operator dictionary needs an operator")
        for operator in wanted:
            if operator not in OPERATORS:
                raise ValueError(f"Invalid operator: {operator}")
        used = list(wanted.items())
        if multi_op == "first" and len(used) > 1:
            logging.getLogger(__name__).warning("only the first operator of %s on %r is used; put further ones in a dictionary of their own", list(wanted), key)
            used = used[:1]
        test = reduce(lambda a, b: a & b, [_operation(binding, key, o, v, strict) for o, v in used])
    return binding.present(key) & test


def _operation(binding: Binding, key: str, operator: str, value: Any, strict: bool) -> Column:
    if operator == "$ne":
        return ~binding.equals(key, value)
    if operator == "$in":
        return binding.contains(key, value, strict)
    return binding.compares(key, operator, value, strict)


def compile_filters(binding: Binding, metadata_filter: Filter = None, exclude_filter: Filter = None, or_filters: Filter = None, multi_op: str = "first", strict: bool = True) -> Column:
    """The boolean column of the three filters together.

    multi_op: whether the "first" or "all" operators of one dictionary count.
    strict: a comparison between types that have no order raises; otherwise it is false.
    """
    if multi_op not in ("first", "all"):
        raise ValueError("multi_op is 'first' or 'all'")
    required, excluded = _dicts(metadata_filter), _dicts(exclude_filter)
    alternatives = [d for d in _dicts(or_filters) if d]
    terms = [_predicate(binding, k, v, multi_op, strict) for d in required for k, v in d.items()]
    if required and not terms and not alternatives:
        if any(excluded):
            raise TypeError("an empty AND dictionary can't be combined with an exclude filter alone")
        return F.lit(False)
    if alternatives:
        terms.append(reduce(lambda a, b: a | b, [_predicate(binding, k, v, multi_op, strict) for d in alternatives for k, v in d.items()]))
    for d in excluded:
        terms += [~(binding.present(k) & F.coalesce(binding.equals(k, v), F.lit(False))) for k, v in d.items()]
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)
