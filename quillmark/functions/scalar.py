"""Scalar functions and predicates, as Column expressions that stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"ns": 0.001, "us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}
_NAMES = {"nanosecond": "ns", "microsecond": "us", "millisecond": "ms", "second": "s", "sec": "s", "minute": "m", "min": "m", "hour": "h", "hr": "h", "day": "d", "week": "w"}
RESERVED = frozenset("all and any as asc between by case cast check column create cross default delete desc distinct drop else end exists false from full group having in index inner insert into is join left like limit not null offset on or order outer primary references right select set table then true union unique update user using values view when where with".split())
TYPE_NAMES = {16: "boolean", 17: "bytea", 20: "bigint", 21: "smallint", 23: "integer", 25: "text", 114: "json", 700: "real", 701: "double precision", 1042: "character", 1043: "character varying", 1082: "date", 1083: "time without time zone", 1114: "timestamp without time zone", 1184: "timestamp with time zone", 1700: "numeric", 2950: "uuid", 3802: "jsonb"}
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def micros(width: str) -> int:
    """Microseconds of a duration such as '15 minutes' or '1h'; months and years have no fixed length."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", width)
    if not m:
        raise ValueError(f"not a duration: {width!r}")
    unit = m[2].lower()
    unit = unit if unit in UNITS else _NAMES.get(unit.rstrip("s"), unit)
    if unit not in UNITS:
        raise ValueError(f"a bucket cannot be measured in {m[2]}")
    n = int(m[1]) * UNITS[unit]
    if n < 1:
        raise ValueError("a bucket is a microsecond at least")
    return int(n)


def time_bucket(width: str, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """Start of the fixed-width bucket of a timestamp without zone, counted from ``origin``."""
    w = micros(width)
    at = F.unix_micros(ts.cast("timestamp"))
    o = F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at - o, F.lit(w))).cast("timestamp_ntz")


def like_ci(a: Column, pattern: str) -> Column:
    """LIKE without regard to case, in which % counts at the ends only."""
    p = pattern.lower()
    start, end = p.startswith("%"), p.endswith("%") and len(p) > 1
    inner = F.lit(p[start : len(p) - end])
    x = F.lower(a)
    if start and end:
        return F.contains(x, inner)
    if start:
        return F.endswith(x, inner)
    return F.startswith(x, inner) if end else x == inner


def concat(*parts: Column) -> Column:
    """Concatenation that skips nulls and renders any type."""
    return F.concat_ws("", *(p.cast("string") for p in parts))


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """1-based substring; a start below 1 counts as 1, negative lengths are refused."""
    if length is not None and length < 0:
        raise ValueError("negative length")
    begin = max(start, 1)
    return F.substring(s, F.lit(begin), F.lit(length) if length is not None else F.length(s))


def trim(s: Column) -> Column:
    """Strips Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def truthy(c: Column, kind: str) -> Column:
    """A value of another type as a predicate: 0 and '' are false."""
    if kind == "boolean":
        return c
    return c != F.lit("") if kind == "string" else c != F.lit(0)


def quote_ident(s: Column) -> Column:
    plain = s.rlike("^[a-z_][a-z0-9_]*$") & ~s.isin(*sorted(RESERVED))
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_type(oid: Column, modifier: Column | None = None) -> Column:
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    name = F.coalesce(F.try_element_at(names, oid), F.lit("???"))
    if modifier is None:
        return name
    return F.when(oid.isin(1042, 1043) & (modifier > 4), F.concat(name, F.lit("("), (modifier - 4).cast("string"), F.lit(")"))).otherwise(name)


def cast(c: Column, kind: str) -> Column:
    """CAST by the dialect's type names: lengths, UUIDs and finiteness are checked."""
    kind = kind.strip().lower()
    m = re.fullmatch(r"(char|varchar)(?:\((\d+)\))?", kind)
    if m:
        size = int(m[2]) if m[2] else 1 if m[1] == "char" else None
        s = c.cast("string")
        return s if size is None else F.when(F.length(s) <= size, s).when(s.isNotNull(), F.raise_error(F.lit(f"value too long for {kind}")))
    if kind == "uuid":
        s = c.cast("string")
        return F.when(s.rlike(UUID), F.lower(s)).when(s.isNotNull(), F.raise_error(F.lit("not a uuid")))
    names = {"int2": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "float": "double", "numeric": "double", "decimal": "double", "text": "string", "bool": "boolean", "json": "string", "jsonb": "string", "bytea": "binary", "timestamp": "timestamp_ntz"}
    if kind in ("float", "double", "numeric", "decimal"):
        d = c.cast("double")
        return F.when(d.isNull(), None).when(F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error(F.lit("not a finite number"))).otherwise(d)
    return c.cast(names.get(kind, kind))


def ordering(c: Column, descending: bool = False, nulls: str | None = None) -> Column:
    """Sort key with the dialect's null order: last when ascending, first when descending."""
    first = nulls == "first" if nulls else descending
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()
