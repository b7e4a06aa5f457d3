"""Closed output: rows are rebuilt from declared fields only, texts are masked by schema, and what is left is audited.

A kind says what a field becomes and why it is refused. Null means "not measured" and is never refused. Everything is a
projection of Column expressions, so no row moves and nothing but rows with faults is looked at by an audit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redact import leak, scrubbed

OTHER = "other"


class Kind(NamedTuple):
    """value(c) is what leaves; refused(c) is a word for why the row may not, null where it may."""

    value: Callable[[Column], Column]
    refused: Callable[[Column], Column]


def _same(c: Column) -> Column:
    return c


def _never(c: Column) -> Column:
    return F.lit(None).cast("string")


def number(low: float | None = None, high: float | None = None) -> Kind:
    """A finite number within bounds, which are allowed themselves."""

    def refused(c: Column) -> Column:
        out = F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
        for fails in [c < low] * (low is not None) + [c > high] * (high is not None):
            out = out | fails
        return F.when(out, "number")

    return Kind(_same, refused)


def choice(values: Iterable[str], fold: bool = False) -> Kind:
    """One of the values. Others are refused or, with fold, become 'other'."""
    known = list(values)
    if fold:
        return Kind(lambda c: F.when(c.isNull() | c.isin(known), c).otherwise(OTHER), _never)
    return Kind(_same, lambda c: F.when(~c.isin(known), "enum"))


def token(pattern: str, most: int = 120) -> Kind:
    """A text of at most `most` code points that the pattern matches as a whole."""
    return Kind(_same, lambda c: F.when((F.length(c) > most) | ~c.rlike(rf"\A(?:{pattern})\z"), "token"))


def prose(refuse: Callable[[Column], Column] = leak) -> Kind:
    """A text that becomes empty where refuse(text) is not null; the row stays."""
    return Kind(lambda c: F.when(c.isNull(), c).when(refuse(c).isNotNull(), "").otherwise(c), _never)


def list_of(kind: Kind) -> Kind:
    """Items that the kind refuses go, and so do null and emptied ones; order and repeats stay."""

    def value(c: Column) -> Column:
        kept = F.filter(c, lambda x: x.isNotNull() & kind.refused(x).isNull())
        return F.filter(F.transform(kept, kind.value), lambda x: x.cast("string") != "")

    return Kind(value, _never)


def tally(values: Iterable[str]) -> Kind:
    """A map of counts: unknown names are summed under 'other', names come sorted; null counts are zero."""
    known = F.array(*map(F.lit, values))

    def value(c: Column) -> Column:
        entries = F.transform(F.map_entries(c), lambda e: F.struct(F.when(F.array_contains(known, e["key"]), e["key"]).otherwise(OTHER).alias("name"), F.coalesce(e["value"], F.lit(0)).cast("long").alias("n")))
        names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["name"])))
        return F.map_from_arrays(names, F.transform(names, lambda k: F.aggregate(F.filter(entries, lambda e: e["name"] == k), F.lit(0).cast("long"), lambda a, e: a + e["n"])))

    return Kind(value, lambda c: F.when(F.exists(F.map_values(c), lambda n: n < 0), "count"))


def uncollected(empty: str | None = None) -> Kind:
    """A field that is declared but never filled: it leaves as null or as the given text."""
    return Kind(lambda c: F.lit(empty).cast("string"), _never)


def nested(fields: dict[str, Kind]) -> Kind:
    """A struct of declared fields; members that are not declared go."""

    def value(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct(*(k.value(c[n]).alias(n) for n, k in fields.items())))

    return Kind(value, lambda c: F.coalesce(*(F.when(k.refused(c[n]).isNotNull(), F.concat(F.lit(f"{n}."), k.refused(c[n]))) for n, k in fields.items())))


def enforce(df: DataFrame, fields: dict[str, Kind], violations: str = "violations") -> DataFrame:
    """The declared columns of df rebuilt, in declared order, and violations: array of (field, why), empty for good rows.

    A column that is not declared, or declared and missing, or a name clash with `violations`, is a ValueError. Nulls are
    allowed everywhere, repeated rows stay, an empty df gives no rows.
    """
    undeclared, missing = [c for c in df.columns if c not in fields], [n for n in fields if n not in df.columns]
    if undeclared or missing or violations in fields:
        raise ValueError(f"undeclared columns {undeclared}, missing columns {missing}, reserved name {violations!r}")
    at = {n: F.col(f"`{n}`") for n in fields}
    found = [F.struct(F.lit(n).alias("field"), k.refused(at[n]).alias("why")) for n, k in fields.items()]
    return df.select(*(k.value(at[n]).alias(n) for n, k in fields.items()), F.filter(F.array(*found), lambda v: v["why"].isNotNull()).alias(violations))


def redact_tree(df: DataFrame, identity: Iterable[str] = (), exempt: Iterable[str] = (), declared: Iterable[str] = ()) -> DataFrame:
    """Columns and struct members named in identity go; every string leaf but the exempt is masked, in arrays, structs and maps.

    Map keys stay where declared; others are masked, and of keys that become equal the entry of the smallest stays. Map entries
    whose key is in identity go. Nulls stay null.
    """
    gone, spared, known = set(identity), set(exempt), list(declared)

    def walk(c: Column, kind: T.DataType, name: str) -> Column:
        if name in spared:
            return c
        if isinstance(kind, T.StringType):
            return F.when(c.isNotNull(), scrubbed(c))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, name))
        if isinstance(kind, T.StructType):
            kept = [walk(c[f.name], f.dataType, f.name).alias(f.name) for f in kind if f.name not in gone]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            by_key = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            entries = F.filter(by_key, lambda e: ~e["key"].isin(list(gone)))
            masked = F.transform(entries, lambda e: F.struct(F.when(e["key"].isin(known), e["key"]).otherwise(scrubbed(e["key"])).alias("key"), walk(e["value"], kind.valueType, name).alias("value")))
            names = F.transform(masked, lambda e: e["key"])
            return F.map_from_entries(F.filter(masked, lambda e, i: F.array_position(names, e["key"]) == i + 1))
        return c

    return df.select(*(walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema if f.name not in gone))


def leaks(df: DataFrame, exempt: Iterable[str] = ()) -> DataFrame:
    """Rows of df in which a string leaf outside the exempt fields still shows something, with leak_field and leak_kind."""
    spared = set(exempt)

    def walk(c: Column, kind: T.DataType, name: str) -> Column | None:
        if name in spared:
            return None
        if isinstance(kind, T.StringType):
            return leak(c)
        if isinstance(kind, T.ArrayType):
            return _first(c, kind.elementType, name)
        if isinstance(kind, T.StructType):
            parts = [p for p in (walk(c[f.name], f.dataType, f.name) for f in kind) if p is not None]
            return F.coalesce(*parts) if parts else None
        if isinstance(kind, T.MapType):
            parts = [p for p in (_first(F.map_keys(c), kind.keyType, name), _first(F.map_values(c), kind.valueType, name)) if p is not None]
            return F.coalesce(*parts) if parts else None
        return None

    def _first(c: Column, kind: T.DataType, name: str) -> Column | None:
        if walk(F.lit(None), kind, name) is None:
            return None
        return F.get(F.filter(F.transform(c, lambda x: walk(x, kind, name)), lambda x: x.isNotNull()), 0)

    found = [(f.name, w) for f in df.schema if (w := walk(F.col(f"`{f.name}`"), f.dataType, f.name)) is not None]
    if not found:
        return df.select("*", F.lit(None).cast("string").alias("leak_field"), F.lit(None).cast("string").alias("leak_kind")).where(F.lit(False))
    first = F.coalesce(*(F.when(w.isNotNull(), F.struct(F.lit(n).alias("field"), w.alias("kind"))) for n, w in found))
    marked = df.select("*", first.alias("leak_found")).where("leak_found is not null")
    return marked.select(*(F.col(f"`{c}`") for c in df.columns), F.col("leak_found.field").alias("leak_field"), F.col("leak_found.kind").alias("leak_kind"))


def audit_no_leak(df: DataFrame, exempt: Iterable[str] = ()) -> DataFrame:
    """df itself; a ValueError that names field and kind, never the text, where a row still leaks. Reads until the first one."""
    row = leaks(df, exempt).select("leak_field", "leak_kind").first()
    if row:
        raise ValueError(f"{row['leak_field']} shows {row['leak_kind']}")
    return df
