"""Counts out of the logs of test runners. A count that a log does not state is null, never zero.

Each function gives a struct of collected, passed, failed, errored and skipped (bigint).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ("collected", "passed", "failed", "errored", "skipped")
TAIL = 6000


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("bigint")


def _struct(**counts: Column) -> Column:
    return F.struct(*(counts.get(k, F.lit(None)).cast("bigint").alias(k) for k in KEYS))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _total(*counts: Column) -> Column:
    """The sum of the stated counts; null if none is."""
    return F.when(F.coalesce(*counts).isNotNull(), sum((_zero(c) for c in counts[1:]), _zero(counts[0])))


def _pytest(t: Column) -> Column:
    collected = F.coalesce(_number(t, r"(\d+) tests? collected"), _number(t, r"collected (\d+) items?"), F.when(t.rlike("no tests ran|collected 0 items"), 0))
    tail = F.right(t, F.lit(TAIL))
    return _struct(collected=collected, passed=_number(tail, r"(\d+) passed"), failed=_number(tail, r"(\d+) failed"), errored=_number(tail, r"(\d+) errors?"), skipped=_number(tail, r"(\d+) skipped"))


def _jest(t: Column) -> Column:
    row = F.regexp_extract(t, r"(?m)^Tests:\s+(.+)$", 1)
    return _struct(collected=_number(row, r"(\d+) total"), passed=_number(row, r"(\d+) passed"), failed=_number(row, r"(\d+) failed"), skipped=_number(row, r"(\d+) skipped"))


def _vitest(t: Column) -> Column:
    row = F.regexp_extract(t, r"(?m)^\s*Tests\s+(.+?)\s*$", 1)
    n = [_number(row, rf"(\d+) {word}") for word in ("passed", "failed", "skipped")]
    return _struct(collected=_total(*n), passed=n[0], failed=n[1], skipped=n[2])


def _mocha(t: Column) -> Column:
    n = [_number(t, rf"(\d+) {word}") for word in ("passing", "failing", "pending")]
    return _struct(collected=_total(*n), passed=n[0], failed=n[1], skipped=n[2])


def _cargo(t: Column) -> Column:
    pattern = r"test result: \w+\. (\d+) passed; (\d+) failed; (\d+) ignored"

    def added(group: int) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")))

    n = [added(k) for k in (1, 2, 3)]
    return _struct(collected=n[0] + n[1] + n[2], passed=n[0], failed=n[1], skipped=n[2])


def _go(t: Column) -> Column:
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x.startswith("{"))
    named = F.filter(lines, lambda x: F.coalesce(F.get_json_object(x, "$.Test"), F.lit("")) != "")
    actions = F.transform(named, lambda x: F.get_json_object(x, "$.Action"))

    def seen(word: str) -> Column:
        return F.size(F.filter(actions, lambda x: x == word))

    n = [seen(word) for word in ("pass", "fail", "skip")]
    total = n[0] + n[1] + n[2]
    passed, failed, skipped, collected = (F.when(total > 0, c) for c in (*n, total))
    return _struct(collected=collected, passed=passed, failed=failed, skipped=skipped)


def _dotnet(t: Column) -> Column:
    return _struct(collected=_number(t, r"Total:\s+(\d+)"), passed=_number(t, r"Passed!?:\s+(\d+)"), failed=_number(t, r"Failed!?:\s+(\d+)"), skipped=_number(t, r"Skipped!?:\s+(\d+)"))


def _phpunit(t: Column) -> Column:
    green, total = _number(t, r"OK \((\d+) tests?"), _number(t, r"Tests: (\d+)")
    failed, errored, skipped = (_number(t, rf"{word}: (\d+)") for word in ("Failures", "Errors", "Skipped"))
    rest = F.greatest(F.lit(0), total - _zero(failed) - _zero(errored) - _zero(skipped))
    stated = green.isNull() & total.isNotNull()
    return _struct(collected=F.coalesce(green, total), passed=F.coalesce(green, F.when(stated, rest)), failed=F.when(green.isNotNull(), 0).when(stated, failed), errored=F.when(stated, errored), skipped=F.when(stated, skipped))


def _rspec(t: Column) -> Column:
    pattern = r"(\d+) examples?, (\d+) failures?(?:, (\d+) pending)?"
    total, failed, pending = (_number(t, pattern, k) for k in (1, 2, 3))
    skipped = F.when(total.isNotNull(), _zero(pending))
    return _struct(collected=total, passed=F.when(total.isNotNull(), F.greatest(F.lit(0), total - failed - skipped)), failed=failed, skipped=skipped)


RUNNERS: dict[str, Callable[[Column], Column]] = {"pytest": _pytest, "jest": _jest, "vitest": _vitest, "mocha": _mocha, "cargo": _cargo, "go": _go, "dotnet": _dotnet, "phpunit": _phpunit, "rspec": _rspec}

#: The line of a listing that names one unit, for each kind of listing.
LISTINGS = {
    "jest_files": r"(?m)^\s*(?:/|[A-Za-z]:\\).*\.[cm]?[jt]sx?\s*$",
    "cargo_list": r"(?m): test\s*$",
    "go_list": r"(?m)^\s*(?:Test|Example|Fuzz|Benchmark)\w*\s*$",
    "dotnet_list": r"(?m)^    ",
    "phpunit_list": r"(?m)^\s*-\s+\S",
    "gradle_dry": r"(?m)^> Task .*:test\b",
}


def counts(text: Column, runner: Column) -> Column:
    """The counts that the log of a runner states; all null for a runner not known or a null log."""
    out = _struct()
    for name, read in RUNNERS.items():
        out = F.when(runner == name, read(text)).otherwise(out)
    return out


def listed(text: Column, kind: Column) -> Column:
    """Units that a listing names; 0 for a kind not known or a null listing."""
    out = F.when(kind == "rspec_dry", _rspec(text)["collected"])
    for name, pattern in LISTINGS.items():
        out = out.when(kind == name, F.regexp_count(text, F.lit(pattern)))
    return F.coalesce(out.cast("bigint"), F.lit(0))
