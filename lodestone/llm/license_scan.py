"""Licences of documents by TF-IDF similarity to templates, inherited from the nearest ancestor directory.

Lines are vectors of binary term frequencies times inverse document frequencies; the frequency of every term is counted over
all documents, so common words outside the templates weigh little, however large the table. A document's own licence is its
best template at a cosine of `threshold` or more over any of its lines. A document without one takes that of the licence file
in the nearest directory at or above its own.

Scale: terms are counted in each task before the shuffle; of the counts, those of the templates' hundred terms are collected.
Lines that cannot reach the threshold by the templates' terms they hold go first. What the other terms of the rest weigh comes
by a join on the term, once for each distinct set of terms. Inheritance joins the distinct directories with their ancestors,
not the documents; a directory that holds a third of all rows is then one row on the joined side, and the join can split it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: The sentences by which licences are commonly named.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at apache.org licenses LICENSE-2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
}
THRESHOLD = 0.6
_SPLIT = "[^a-z0-9]+"


def terms_of(text: str) -> set[str]:
    return {t for t in re.split(_SPLIT, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if t}


def vocabulary() -> list[str]:
    return sorted(set().union(*(terms_of(s) for sentences in TEMPLATES.values() for s in sentences)))


def _tokens(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.array_distinct(F.split(lower, _SPLIT)), "")


def _strong(mass: dict[str, float], least: float) -> set[str]:
    """Terms of which a line within the threshold of a sentence holds one; the lightest others weigh less than least of it."""
    total, light = sum(mass.values()), 0.0
    out = set()
    for t in sorted(mass, key=lambda t: (mass[t], t)):
        light += mass[t]
        if light >= least * total - 1e-9:
            out.add(t)
    return out


def own_licences(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, licence, cosine) of the rows (doc, text) that have one; ties go to the name that sorts first."""
    words = vocabulary()
    found = written(docs.select(F.explode(_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    count = {r["term"]: r["df"] for r in found.where(F.col("term").isin(words)).collect()}
    n = docs.count()
    mass = {w: (math.log((1 + n) / (1 + count.get(w, 0))) + 1) ** 2 for w in words}
    sentences = [(licence, sorted(terms_of(s))) for licence, texts in TEMPLATES.items() for s in texts]
    strong = set().union(*(_strong({t: mass[t] for t in terms}, threshold**2) for _, terms in sentences))
    known, strong = (F.array(*map(F.lit, sorted(x))) for x in (words, strong))
    rows = F.transform(F.array_distinct(F.split("text", "\n")), _tokens)
    lines = docs.select("doc", F.explode(F.filter(rows, lambda t: F.arrays_overlap(t, strong))).alias("t"))

    def held(terms: list[str]) -> Column:
        return sum((F.when(F.array_contains("t", w), mass[w]).otherwise(0.0) for w in terms), F.lit(0.0))

    near = [F.struct((held(terms) / math.sqrt(sum(mass[t] for t in terms))).alias("dot"), F.lit(licence).alias("licence")) for licence, terms in sentences]
    lines = lines.select("doc", F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("key"), held(words).alias("inside"), F.array_except("t", known).alias("others"), F.array(*near).alias("near"))
    # No term weighs less than 1.
    lines = written(lines.where(F.array_max("near.dot") >= threshold * F.sqrt(F.col("inside") + F.size("others")) - 1e-9), "lines")
    weight = F.log((1 + n) / (1 + F.col("df"))) + 1
    others = lines.select("key", "others").where(F.size("others") > 0).dropDuplicates(["key"]).select("key", F.explode("others").alias("term"))
    outside = others.join(found, "term").groupBy("key").agg(F.sum(weight * weight).alias("outside"))
    norm = F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0)))
    lines = lines.drop("others").join(outside, "key", "left").withColumn("norm", norm).where(F.array_max("near.dot") >= threshold * F.col("norm"))
    lines = lines.withColumn("b", F.array_min(F.transform("near", lambda x: F.struct((-F.round(x["dot"] / F.col("norm"), 9)).alias("c"), x["licence"].alias("licence")))))
    best = lines.groupBy("doc").agg(F.min("b").alias("b"))
    return best.select("doc", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def _directory(path: Column) -> Column:
    """Without the last segment; the root is the empty text."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def licences(df: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of df: id_col (if given), path, licence, cosine, how ('own', 'inherited', 'none'), licence_dir.

    Licence files are those whose name starts with LICENSE, LICENCE or COPYING in any case. Several in one directory: the
    highest cosine, then the name that sorts first. Null texts count as empty; a null path counts as a file at the root and
    stays null. Rows equal in path and text are one document and share a result. Other columns of df, whatever their names,
    are not looked at. An empty df gives no rows.
    """
    ids = [F.col(id_col).alias("id")] if id_col else []
    rows = df.select(*ids, F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("path", "text"))
    own = written(own_licences(rows, threshold), "licences")
    place = F.coalesce(F.col("path"), F.lit(""))
    named = rows.drop("text").withColumn("dir", _directory(place)).join(own, "doc", "left")
    named = written(named, "files")
    files = named.where(F.col("licence").isNotNull() & F.element_at(F.split(place, "/"), -1).rlike("(?i)^(licen[cs]e|copying)"))
    by_dir = files.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence"))).alias("f")).select(F.col("dir").alias("licence_dir"), F.col("f.licence").alias("from_dir"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = named.select("dir").distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "licence_dir"))
    near = dirs.join(by_dir, "licence_dir").groupBy("dir").agg(F.max(F.struct("depth", "licence_dir", "from_dir")).alias("g"))
    out = named.join(near, "dir", "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none")
    chosen = [F.col("path").alias(path_col), F.coalesce("licence", "g.from_dir").alias("licence"), "cosine", how.alias("how"), F.when(F.col("licence").isNull(), F.col("g.licence_dir")).alias("licence_dir")]
    return out.select(*([F.col("id").alias(id_col)] if id_col else []), *chosen)
