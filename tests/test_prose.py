"""Reasons why prose may not leave."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import prose

CASES = {
    "parser unavailable; reported unscored": None, "it couldn't start and wasn't tried": None, "One. Two sentences! Three?": None, "uses PostgreSQL and Django": None, "": "it is empty", " \n ": "it is empty",
    "see src/main.py": "it holds a path separator", "go to www.x": "it holds a URL", "ask @me": "it holds an address or a handle", "main.py broke": "it holds a dotted identifier or a file name", "a .toml file": "it names a file extension",
    "max_words here": "it holds a snake_case identifier", "the maxWords": "it holds a camelCase identifier", "a 'quoted name' here": "it holds a quoted string", "a -> b": "it holds code punctuation", "at deadbeef1": "it holds an object hash",
    "the API": "it holds an acronym or a constant name", "we met Acme": "it holds the capitalised name 'Acme'", "we met -Acme": "it holds the capitalised name 'Acme'", "a note (aside)": "it holds code punctuation", " ".join(["w"] * 41): "it runs to 41 words, over the limit of 40",
}


def test_reasons_in_their_order(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string").withColumn("why", prose.rejection_reason(F.col("t")))
    got = {r["t"]: r["why"] for r in df.collect()}
    assert got == CASES | {None: "it is empty"}


@pytest.mark.parametrize("text, why", [("check skipped (mine_disabled)", None), ("check skipped (other_word)", "it holds a snake_case identifier"), ("parser unavailable (ImportError)", None)])
def test_words_of_our_own_are_allowed(spark, text, why):
    row = spark.range(1).select(prose.rejection_reason(F.lit(text), allow=["mine_disabled", "mine", "ImportError"])).first()
    assert row[0] == why
