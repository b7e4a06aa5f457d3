"""Lines that recur across documents, found by a log-template tree.

A line's tokens with a digit become <*>. The tree is of fixed depth: token count, then the leading tokens. A leaf has a list
of templates: its lines, by smallest document (then smallest key), become variants of the first template whose seed they equal
in enough of their parts, their differing fields generalised, or else the seed of a template of their own. The PARTS parts of a
line are runs of tokens that make up all of it (single tokens, some twice, where it has fewer tokens than parts); two lines
have a part in common only if all its tokens are equal, so every token is compared. A template that recurs in enough documents
stays in the smallest of them only.

Scale: only hashes travel, one for each part. Equal lines are counted in each task before the shuffle, so a line that a third of the documents
hold is one row a task; the seeds are grouped minima, in rounds over the lines not yet settled; the flagged lines come back by an equi-join on the line's key, whose
large partitions Spark can split. Texts move once, to meet their flagged lines; a document looks its lines up in buckets of
the flagged ones, so a long one costs its lines times the root of these.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

PARTS = 8
BLANK = r"[ \t\r\f\x0B]"


def _masked(line: Column) -> Column:
    """One space between tokens, none around, <*> for tokens with a digit; the regular expressions run only where needed."""
    odd = line.startswith(" ") | line.endswith(" ")
    for c in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | line.contains(c)
    plain = F.regexp_replace(F.regexp_replace(line, f"^{BLANK}+|{BLANK}+$", ""), f"{BLANK}+", " ")
    line = F.when(odd, plain).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """id, doc (hash of the text), key, leaf and part hashes of each document's distinct lines of min_tokens or more."""

    def described(x: Column) -> Column:
        m, t = x["m"], x["t"]
        n = F.size(t)
        few = n < PARTS
        start = [F.when(few, F.floor(n * (2 * k + 1) / (2 * PARTS))).otherwise(F.floor(n * k / PARTS)).cast("int") for k in range(PARTS)]
        size = [F.when(few, F.lit(1)).otherwise(F.floor(n * (k + 1) / PARTS).cast("int") - start[k]) for k in range(PARTS)]
        at = [F.hash(F.slice(t, start[k] + 1, size[k])).alias(f"s{k}") for k in range(PARTS)]
        return F.struct(n.alias("n"), F.unhex(F.md5(m)).alias("key"), F.xxhash64(n, F.slice(t, 1, depth)).alias("leaf"), *at)

    masked = F.filter(F.transform(F.array_distinct(F.split("text", "\n")), _masked), lambda m: F.length(m) > 0)
    rows = F.transform(F.transform(F.array_distinct(masked), lambda m: F.struct(m.alias("m"), F.split(m, " ").alias("t"))), described)
    return docs.select("id", "doc", F.explode(rows).alias("line")).select("id", "doc", "line.*").where(F.col("n") >= min_tokens).drop("n")


def _grouped(lines: DataFrame, runs: list[tuple[int, ...]]) -> DataFrame:
    """(key, owner, g): a group for each choice of parts; two lines share it if they have the leaf and those parts in common."""
    groups = F.array(*(F.xxhash64(F.lit(k), "leaf", *(f"s{x}" for x in run)) for k, run in enumerate(runs)))
    return lines.select("key", "owner", F.explode(groups).alias("g"))


def _variants(known: DataFrame, least: int) -> DataFrame:
    """(key, template) of the lines that are variants of another line, the seed of their template.

    In each round, a line with no smaller line within the threshold is a seed, and lines whose smallest such line is a seed
    are its variants and go. Seeds stay for the rounds after. That is what going through the lines in order would give.
    """
    lines = known.select("key", "leaf", "owner", *(f"s{k}" for k in range(PARTS)))
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1").select("leaf")
    lines = written(lines.join(leaves, "leaf", "left_semi"), "leaves")
    # Lines that differ in so few parts have one of these choices in common.
    apart = PARTS - least + 1
    rows = _grouped(lines, [tuple(range(PARTS))[k::apart] for k in range(apart)])
    shared = rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    pool = written(lines.join(rows.join(shared, "g", "left_semi").select("key").distinct(), "key", "left_semi"), "pool")
    runs = list(combinations(range(PARTS), least))
    out = None
    while True:
        rows = _grouped(pool, runs)
        smallest = rows.groupBy("g").agg(F.min(F.struct("owner", "key")).alias("o"), F.count("*").alias("m")).where("m > 1").drop("m")
        near = written(rows.join(smallest, "g").groupBy("key").agg(F.min("o").alias("o")).select("key", F.col("o.key").alias("template")), "near")
        seeds = near.where("key = template").select("template")
        rest = near.where("key <> template")
        settled = written(rest.join(seeds, "template", "left_semi").select("key", "template"), "variants")
        out = settled if out is None else out.unionByName(settled)
        if rest.count() == settled.count():
            return out
        pool = written(pool.join(near.select("key"), "key", "left_semi").join(settled.select("key"), "key", "left_anti"), "pool")


def recurring_lines(lines: DataFrame, min_docs: int, least: int) -> DataFrame:
    """(key, owner) of the lines whose template recurs; owner is the smallest document id that holds it."""
    parts = [f"s{k}" for k in range(PARTS)]
    held = [F.count("*").alias("docs"), F.min("id").alias("owner"), F.max("id").alias("last")]
    known = written(lines.groupBy("key", "leaf", *parts).agg(*held), "keys")
    variants = _variants(known, least)
    named = written(variants.unionByName(variants.select(F.col("template").alias("key"), "template").distinct()), "templates")
    several = lines.join(named, "key").select("template", "id", "doc").distinct().groupBy("template").agg(*held)
    found = named.join(several, "template").select("key", "docs", "owner", "last")
    found = found.unionByName(known.join(named, "key", "left_anti").select("key", "docs", "owner", "last"))
    return found.where((F.col("docs") >= min_docs) & (F.col("owner") != F.col("last"))).select("key", "owner")


def without_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, depth: int = 3, similarity: float = 0.75, min_tokens: int = 3, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """df with the recurring lines taken out of text_col; with counts, also n_lines and n_dropped.

    With drop_emptied, documents go whose lines were all taken out (but for white space).

    A template recurs if its lines are held by min_docs documents, by two ids at least; a document counts once, however
    many of its lines fit. Its lines stay in the document of the smallest id. Lines fit if they have the token count, the
    leading `depth` tokens and similarity * PARTS parts in common, so fields may vary in two parts of eight. Lines of fewer
    than min_tokens tokens are never dropped. Null and empty texts stay as they are (n_lines 0 and 1); a null id owns
    nothing, so its recurring lines go. Rows equal in id and text are one document and change alike; all rows stay, and all
    other columns, whatever their names. An empty df stays empty.
    """
    least = -int(-similarity * PARTS // 1)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").withColumn("doc", F.xxhash64("text"))
    lines = written(_lines(docs, depth, min_tokens), "lines")
    found = recurring_lines(lines, min_docs, least)
    drops = lines.select("id", "doc", "key").join(found, "key").where(~F.col("id").eqNullSafe(F.col("owner")))
    drops = drops.groupBy("id", "doc").agg(F.collect_set(F.hex("key")).alias("keys"))
    several = F.floor(F.sqrt(F.size("keys"))).cast("int") + 1
    buckets = F.transform(F.sequence(F.lit(0), several - 1), lambda b: F.filter("keys", lambda k: F.pmod(F.hash(k), several) == b))
    drops = drops.select(F.struct("id", "doc", buckets.alias("keys")).alias("__drop"))
    text = F.col(text_col).cast("string")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")
    joined = df.select(row, F.col(id_col).alias("__id"), F.xxhash64(text).alias("__doc")).join(drops, F.col("__id").eqNullSafe(F.col("__drop.id")) & (F.col("__doc") == F.col("__drop.doc")), "left")
    old = F.col(f"__row.`{text_col}`")
    lines_of = F.split(old, "\n")
    keyed = F.transform(lines_of, lambda x: F.struct(x.alias("x"), F.upper(F.md5(_masked(x))).alias("k")))
    bucket = lambda k: F.get(F.col("__drop.keys"), F.pmod(F.hash(k), F.size("__drop.keys")))
    stay = F.transform(F.filter(keyed, lambda s: ~F.array_contains(bucket(s["k"]), s["k"])), lambda s: s["x"])
    joined = joined.withColumn("__text", F.when(F.col("__drop").isNull(), old).otherwise(F.array_join(stay, "\n")))
    if drop_emptied:
        joined = joined.where(F.col("__drop").isNull() | F.col("__text").rlike(r"[^ \t\r\f\n\x0B]"))
    out = [F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in df.columns]
    if counts:
        n = F.coalesce(F.size(lines_of), F.lit(0))
        kept = F.when(F.col("__drop").isNull(), n).otherwise(F.size(stay))
        out += [F.greatest(n, F.lit(0)).cast("long").alias("n_lines"), F.greatest(n - kept, F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out)
