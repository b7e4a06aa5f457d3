"""Versions as arrays of at most three numbers, and the windows that declared specs allow."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = "array<struct<low:array<int>,high:array<int>>>"

# Names of releases, numbers that bind in a bare pin, words that bind nothing, retired levels, and how specs are
# written: what makes one a range, what a clause is, and the bounds of each sign.
CODENAMES = {
    "argon": 4,
    "boron": 6,
    "carbon": 8,
    "dubnium": 10,
    "erbium": 12,
    "fermium": 14,
    "gallium": 16,
    "hydrogen": 18,
    "iron": 20,
    "jod": 22,
    "krypton": 24,
}
BINDING = {"python": 2, "ruby": 2, "go": 2, "rust": 2, "node": 1, "java": 1, "dotnet": 1}
ANY = ["", "*", "x", "latest", "current", "node", "system", "stable", "default"]
RETIRED = {7: 20, 8: 25}
RANGE = r"[><=^~*|]|\bx\b|\.x"
CLAUSE = r"(>=|<=|==|!=|~=|\^|~|>|<|=)?\s*v?([0-9][0-9.]*[0-9x*]?|\d)"
#: sign -> (where the window opens, where it closes): at the version, past all that begin with so many of its numbers, or open.
ALL, MINOR, CARET = "all", "minor", "caret"
BOUNDS = {
    ">=": ("at", None),
    ">": (ALL, None),
    "<=": (None, ALL),
    "<": (None, "at"),
    "^": ("at", CARET),
    "~": ("at", MINOR),
    "~=": ("at", MINOR),
    "==": ("at", ALL),
    "=": ("at", ALL),
    "": ("at", ALL),
}
# End of the fixed values.


def version(text: Column) -> Column:
    """The first dotted number, of at most three parts; null if there is none."""
    number = F.regexp_extract(text, r"(\d+(?:\.\d+){0,2})", 1)
    return F.when(number != "", F.split(number, r"\.").cast("array<int>"))


def modern_java(v: Column) -> Column:
    """1.N is N."""
    return F.when((F.size(v) > 1) & (v[0] == 1), F.slice(v, 2, 3)).otherwise(v)


def _past(v: Column, keep: Column) -> Column:
    """The version just past all that begin with the first `keep` numbers of v, zeros for what v lacks."""
    full = F.concat(v, F.array(F.lit(0), F.lit(0), F.lit(0)))
    return F.concat(F.slice(full, F.lit(1), keep - 1), F.array(F.element_at(full, keep) + 1))


def _bound(v: Column, kind: str | None) -> Column:
    if kind is None:
        return F.lit(None).cast("array<int>")
    if kind == "at":
        return v
    caret = F.when((v[0] == 0) & (F.size(v) > 1), 2).otherwise(1)
    return _past(v, {ALL: F.size(v), MINOR: F.least(F.lit(2), F.size(v)), CARET: caret}[kind])


def _window(low: Column, high: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def _of_branch(branch: Column) -> Column:
    """The window in which all clauses of a branch hold; null if it has none. Clauses that exclude a version bind nothing."""
    signs, numbers = F.regexp_extract_all(branch, F.lit(CLAUSE), F.lit(1)), F.regexp_extract_all(branch, F.lit(CLAUSE), F.lit(2))
    clauses = F.zip_with(signs, numbers, lambda sign, number: F.struct(sign.alias("sign"), version(number).alias("v")))

    def side(which: int) -> Column:
        def of(c: Column) -> Column:
            out = F.lit(None).cast("array<int>")
            for sign, kinds in BOUNDS.items():
                out = F.when(c["sign"] == sign, _bound(c["v"], kinds[which])).otherwise(out)
            return out

        return F.filter(F.transform(clauses, of), lambda x: x.isNotNull())

    return F.when(F.size(signs) > 0, _window(F.array_max(side(0)), F.array_min(side(1))))


def windows(spec: Column | str, lane: Column | str, floor: Column | str) -> Column:
    """The windows (low inclusive, high exclusive, null open) that a spec allows; none where it binds nothing.

    Null specs, lanes and floors bind as empty, unknown and false. A bare number pins what its lane binds; with floor, it
    only opens the window.
    """
    spec, lane, floor = (F.col(c) if isinstance(c, str) else c for c in (spec, lane, floor))
    text = F.regexp_replace(F.trim(F.coalesce(spec, F.lit(""))), "^[\"']+|[\"']+$", "")
    lane, v = F.coalesce(lane, F.lit("")), version(text)
    name = F.lower(text)
    table = lambda d: F.create_map(*map(F.lit, chain.from_iterable(d.items())))
    release = F.element_at(table(CODENAMES), F.trim(F.replace(name, F.lit("lts/"), F.lit(""))))
    level = F.when((v[0] == 1) & (F.size(v) > 1), v[1]).otherwise(v[0])
    retired = F.element_at(table(RETIRED), F.greatest(level, F.lit(7)))
    java = F.array(_window(F.array(level), F.when(retired.isNotNull(), F.array(retired))))
    ranges = F.filter(F.transform(F.split(text, r"\|\|"), _of_branch), lambda w: w.isNotNull())
    binding = F.coalesce(F.element_at(table(BINDING), lane), F.lit(2))
    keep = F.least(F.size(v), F.greatest(binding, F.when(v[0] == 0, 2).otherwise(1)))
    pin = F.array(_window(F.slice(v, F.lit(1), keep), F.when(~F.coalesce(floor, F.lit(False)), _past(v, keep))))
    none = F.array().cast(WINDOWS)
    cases = [
        (text.isin(ANY), none),
        ((lane == "node") & release.isNotNull(), F.array(_window(F.array(release), F.array(release + 1)))),
        ((lane == "node") & name.startswith("lts"), none),
        ((lane == "java") & v.isNull(), none),
        (lane == "java", java),
        (text.rlike(RANGE), ranges),
        (v.isNull(), none),
    ]
    out = pin.cast(WINDOWS)
    for when, then in reversed(cases):
        out = F.when(when, then.cast(WINDOWS)).otherwise(out)
    return out


def satisfied(v: Column, allowed: Column) -> Column:
    """Whether the version lies in a window, or there is none. Numbers beyond a bound's length are not compared."""

    def holds(w: Column) -> Column:
        above = w["low"].isNull() | (F.slice(v, F.lit(1), F.greatest(F.lit(1), F.size(w["low"]))) >= w["low"])
        below = w["high"].isNull() | (F.slice(v, F.lit(1), F.greatest(F.lit(1), F.size(w["high"]))) < w["high"])
        return above & below

    return (F.size(allowed) == 0) | F.exists(allowed, holds)


def chosen(declared: DataFrame, installed: DataFrame) -> DataFrame:
    """declared (repo_id, lane, windows) with the version of installed (lane, version, is_default) that serves it: the default
    one if it is allowed, else the allowed one nearest the lowest bound, of these the newest; null if none is allowed."""
    pairs = declared.join(installed, "lane", "left").where(F.col("version").isNull() | satisfied(F.col("version"), F.col("windows")))
    head = F.coalesce(F.size(F.get("windows", F.lit(0))["low"]), F.lit(1))
    near = F.slice("version", F.lit(1), F.greatest(F.lit(1), head))
    order = F.struct((~F.coalesce("is_default", F.lit(False))).alias("other"), near.alias("near"), F.transform("version", lambda x: -x).alias("newest"))
    best = pairs.groupBy("repo_id", "lane").agg(F.min_by("version", order).alias("version"))
    return declared.join(best, ["repo_id", "lane"], "left")
