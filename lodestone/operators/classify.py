"""What a repository mostly is: bounded terms of signals, summed by class, with corroboration by independent terms.

Input is long: signals (repo_id, signal, value), a missing signal being zero. Everything is one join with a constant table
and aggregates by repository, which hold at most seven classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes in their order, and class, term, signal, weight of a unit, ceiling of the signal's part.
CLASSES = "frontend backend ml ai_research data_engineering security infra".split()
TERMS = [
    ("frontend", "dep_keywords", "frontend_frameworks", 1.5, 6.0), ("frontend", "ui_components", "ui_component_files", 0.1, 5.0),
    ("frontend", "css", "css_loc_ratio", 20.0, 3.0), ("frontend", "frameworks", "web_frameworks", 1.0, 3.0),
    ("backend", "dep_keywords", "backend_frameworks", 1.5, 6.0), ("backend", "orm_db", "orm_db", 1.0, 4.0),
    ("backend", "frameworks", "service_frameworks", 1.0, 3.0), ("backend", "project_type", "is_api_service", 3.0, 3.0),
    ("ml", "dep_keywords", "ml_libs", 2.0, 8.0), ("ml", "notebooks", "notebooks", 0.3, 4.0), ("ml", "experiment_tracking", "experiment_tracking", 1.0, 4.0),
    ("ai_research", "experiment_tracking", "experiment_tracking", 2.0, 6.0), ("ai_research", "notebooks", "notebooks", 0.5, 5.0), ("ai_research", "ml_libs", "ml_libs", 1.0, 4.0),
    ("data_engineering", "dep_keywords", "data_eng", 2.5, 9.0), ("data_engineering", "sql_files", "sql_files", 0.3, 4.0),
    ("data_engineering", "sql_loc", "sql_loc", 0.005, 3.0), ("data_engineering", "data_files", "data_files", 0.5, 2.0),
    ("security", "dep_keywords", "security_libs", 3.0, 10.0),
    ("infra", "terraform", "terraform_present", 4.0, 4.0), ("infra", "terraform", "terraform_files", 0.3, 4.0), ("infra", "k8s", "k8s_manifests", 0.5, 4.0),
    ("infra", "helm", "helm_present", 2.0, 2.0), ("infra", "pulumi", "pulumi_present", 2.0, 2.0), ("infra", "ansible", "ansible_present", 2.0, 2.0),
    ("infra", "dep_keywords", "infra_libs", 1.0, 3.0), ("infra", "dockerfiles", "dockerfiles", 0.5, 1.5), ("infra", "iac_share", "iac_share", 8.0, 6.0),
    ("infra", "cloudformation", "cloudformation_files", 0.5, 2.0),
]
SUPPORT, LONE, LEAST, LEAST_EVIDENCE, DETECTED = 0.5, 4.0, 1.0, 1.0, 2.0
WEB_SHARE, CSS_RATIO = 0.10, 0.02
FALLBACK = "backend"
# End of the fixed values.


def terms(signals: DataFrame) -> DataFrame:
    """(repo_id, class, term, value) of every term; dependencies and frameworks of a frontend count only where the tree has
    component files, a tenth of its lines in web languages, or some CSS."""
    spark = signals.sparkSession
    table = spark.createDataFrame([(CLASSES.index(c), c, *rest) for c, *rest in TERMS], "place int, class string, term string, signal string, weight double, ceiling double")
    known = signals.groupBy("repo_id", "signal").agg(F.max(F.col("value").cast("double")).alias("value"))
    shown = known.groupBy("repo_id").agg(F.bool_or(((F.col("signal") == "ui_component_files") & (F.col("value") > 0)) | ((F.col("signal") == "web_loc_share") & (F.col("value") >= WEB_SHARE)) | ((F.col("signal") == "css_loc_ratio") & (F.col("value") >= CSS_RATIO))).alias("shown"))
    part = F.least(F.coalesce(F.col("value"), F.lit(0.0)) * F.col("weight"), F.col("ceiling"))
    every = shown.join(F.broadcast(table)).join(known, ["repo_id", "signal"], "left")
    unreal = (F.col("class") == "frontend") & F.col("term").isin("dep_keywords", "frameworks") & ~F.coalesce("shown", F.lit(False))
    return every.groupBy("repo_id", "place", "class", "term").agg(F.round(F.sum(F.when(unreal, 0.0).otherwise(part)), 3).alias("value"))


def classified(signals: DataFrame, threshold: float = 0.18) -> DataFrame:
    """For each repository: raw_scores and class_confidence (maps), primary_class, suggested_classes, is_monorepo, and
    undecided, where no class had evidence and the primary one is a fallback."""
    scores = terms(signals).groupBy("repo_id", "place", "class").agg(F.round(F.sum("value"), 3).alias("raw"), F.count_if(F.col("value") >= SUPPORT).alias("support"))
    each = F.struct("place", "class", "raw", "support")
    rows = scores.groupBy("repo_id").agg(F.array_sort(F.collect_list(each)).alias("c"), F.sum("raw").alias("evidence"))
    ranked = F.array_sort(F.transform("c", lambda x: F.struct((-x["raw"]).alias("less"), x["place"].alias("place"), x["class"].alias("class"), x["raw"].alias("raw"), x["support"].alias("support"))))
    solid = lambda x: (x["support"] >= 2) | (x["raw"] >= LONE)
    rows = rows.withColumns({"ranked": ranked, "scale": F.greatest("evidence", F.lit(LEAST_EVIDENCE))})
    best = F.filter("ranked", lambda x: (x["raw"] >= LEAST) & solid(x))
    top = F.col("ranked")[0]
    primary = F.when(top["raw"] >= LEAST, F.coalesce(F.get(best, F.lit(0))["class"], top["class"]))
    rows = rows.withColumn("primary", primary)
    kept = F.filter("c", lambda x: ((F.round(x["raw"] / F.col("scale"), 4) >= threshold) & (x["raw"] >= DETECTED) & solid(x)) | (x["class"] == F.col("primary")))
    found = F.transform(kept, lambda x: x["class"])
    suggested = F.when(F.col("primary").isNull(), F.array(F.lit(FALLBACK))).when(found == F.array(F.lit("frontend"), F.lit("backend")), F.array(F.lit("fullstack"))).otherwise(found)
    return rows.select(
        "repo_id",
        F.map_from_entries(F.transform("c", lambda x: F.struct(x["class"], x["raw"]))).alias("raw_scores"),
        F.map_from_entries(F.transform("c", lambda x: F.struct(x["class"], F.round(x["raw"] / F.col("scale"), 4)))).alias("class_confidence"),
        F.coalesce("primary", F.lit(FALLBACK)).alias("primary_class"),
        suggested.alias("suggested_classes"),
        (F.size(suggested) >= 2).alias("is_monorepo"),
        F.col("primary").isNull().alias("undecided"),
    )
