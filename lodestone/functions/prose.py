"""Why a line of free text may not leave: what is specific enough to point at somebody's repository. Column expressions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redact import TECHNOLOGIES

# Patterns with the reason each gives, in their order.
REJECTIONS = [
    (r"[/\\]", "it holds a path separator"),
    (r"https?:|\bwww\.", "it holds a URL"),
    (r"@", "it holds an address or a handle"),
    (r"[A-Za-z_]\w*\.[A-Za-z_]", "it holds a dotted identifier or a file name"),
    (r"(?:^|\s)\.[A-Za-z0-9]{1,6}\b", "it names a file extension"),
    (r"[A-Za-z0-9]+_[A-Za-z0-9]+", "it holds a snake_case identifier"),
    (r"\b[a-z]+[A-Z][A-Za-z0-9]*\b", "it holds a camelCase identifier"),
    (r"[\"`]|(?<![A-Za-z])'[^']{1,80}'", "it holds a quoted string"),
    (r"[{}\[\]<>=|*#$]|::|->|=>", "it holds code punctuation"),
    (r"\b[0-9a-f]{7,}\b", "it holds an object hash"),
    (r"\b[A-Z]{2,}[A-Z0-9]*\b", "it holds an acronym or a constant name"),
]
BRACKETS = (r"[()]", "it holds code punctuation")
MOST_WORDS = 40
# End of the fixed values.

_WORD = r"([^A-Za-z]*)([A-Za-z][A-Za-z'’-]*)"


def _name(text: Column) -> Column:
    """The first capitalised word that opens no sentence and is no known technology; null for none."""
    gaps, words = (F.regexp_extract_all(text, F.lit(_WORD), k) for k in (1, 2))
    pairs = F.zip_with(gaps, words, lambda g, w: F.struct(F.regexp_replace(g, r"\s+$", "").alias("gap"), w.alias("word")))
    at = F.transform(pairs, lambda p, i: F.struct(p["word"].alias("word"), F.when(p["gap"] != "", F.right(p["gap"], F.lit(1))).when(i > 0, "x").otherwise("").alias("before")))
    wrong = F.filter(at, lambda p: p["word"].rlike("^[A-Z]") & ~p["word"].isin(TECHNOLOGIES) & (p["before"] != "") & ~p["before"].isin(".", "!", "?"))
    return F.get(wrong, F.lit(0))["word"]


def rejection_reason(text: Column, most_words: int = MOST_WORDS, allow: Iterable[str] = ()) -> Column:
    """A reason why the text is no prose that may leave; null where it may. Null and blank texts are empty.

    Words in allow stand for nothing of anybody's; a text that may hold such words may hold round brackets as well.
    """
    ours = sorted(allow, key=len, reverse=True)
    probe = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), " ")
    words = F.size(F.split(probe, " "))
    bare = probe
    for token in ours:
        bare = F.replace(bare, F.lit(token), F.lit("ok"))
    found = [F.when(bare.rlike(pattern), reason) for pattern, reason in (REJECTIONS if ours else [*REJECTIONS, BRACKETS])]
    name = _name(bare)
    long = F.when(words > most_words, F.concat(F.lit("it runs to "), words, F.lit(f" words, over the limit of {most_words}")))
    named = F.when(name.isNotNull(), F.concat(F.lit("it holds the capitalised name '"), name, F.lit("'")))
    return F.when(probe == "", "it is empty").otherwise(F.coalesce(long, *found, named))
