"""History analytics over the lines of a log: commits with their files, classes of commits, repository statistics.

A header line is sha, short sha, name, address, author date and subject with the unit separator between them; the lines
after it, until the next header, are added, deleted and path with tabs between them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import any_of
from . import scans

# Patterns and bounds that decide the results.
SEPARATOR = "\x1f"
BOTS = [
    r"\[bot\]", r"\bdependabot\b", r"\brenovate\b", r"\bsnyk-bot\b", r"\bgithub-actions\b", r"\bactions-user\b", r"\bmergify\b",
    r"\bpre-commit-ci\b", r"\bwhitesource\b", r"\bgreenkeeper\b", r"\bimgbot\b", r"\ballcontributors\b", r"\brestyled\b",
    r"\bscala-steward\b", r"\bpyup-bot\b", r"\bdepfu\b", r"\btravis-ci\b", r"\bcircleci\b", r"\bbuildkite\b", r"\bsemantic-release\b",
    r"\banonymi[sz]er\b", r"\bjenkins[-_. ]?(ci|bot|build|builder|agent|server)\b", r"\bbot\b",
]
CONVENTIONAL = r"(?i)^(feat|fix|chore|docs|refactor|test|perf|build|ci|style|revert)(\([^)]+\))?!?:\s"
NOISE = r"(?i)^(chore|revert|wip|bump|deps?|dependabot|lint|style|format|prettier|typo|merge|release|version|removed?|cleanup|cleanups?|delete|remove|rename|upgrade|update\s+(deps|dep|dependenc|package|lock))[\s:(\[]"
FEATURE = r"(?i)^(feat|add|implement|introduce|support)\b|^test[:(]"
REPAIR = r"(?i)^(fix(e[sd])?|hotfix|bugfix|bug|regression|revert(s|ed)?|patch(es|ed)?|resolve[sd]?|correct(s|ed)?)\b|^(fix|revert)[:(]"
TEST_PATHS = [r"\.(test|spec)\.(ts|tsx|js|jsx|mjs)$", r"(^|/)(test_|tests/)", r"_test\.(go|py|rb)$", r"(^|/)__tests__/", r"(^|/)spec/", r"\.spec\.rb$", r"Test\.(java|kt|cs)$", r"Tests\.(java|kt|cs)$"]
TEST_SUPPORT_PATHS = [
    r"(^|/)vitest[^/]*\.config\.(ts|js|mjs)$", r"(^|/)jest\.config\.(ts|js|mjs|cjs|json)$", r"(^|/)playwright\.config\.(ts|js|mjs)$",
    r"(^|/)cypress\.config\.(ts|js)$", r"(^|/)karma\.conf\.(ts|js)$", r"(^|/)tests?/setup/", r"(^|/)tests?/fixtures/", r"(^|/)tests?/helpers/",
    r"(^|/)tests?/__mocks__/", r"(^|/)tests?/conftest\.py$", r"(^|/)conftest\.py$", r"(^|/)pytest\.ini$", r"(^|/)tox\.ini$", r"(^|/)\.mocharc\.(js|cjs|json|yml|yaml)$",
]
SCHEMA_PATHS = [r"(^|/)schemas?/", r"(^|/)types?/", r"\.schema\.(ts|js|py)$", r"(^|/)migrations?/", r"(^|/)drizzle/", r"(^|/)prisma/", r"\.proto$", r"openapi\.(ya?ml|json)$"]
PROSE_PATHS = [r"\.md$", r"^\.github/", r"^\.gitlab/", r"\.ya?ml$", r"^Dockerfile", r"package(-lock)?\.json$", r"pnpm-lock\.yaml$", r"yarn\.lock$", r"poetry\.lock$", r"Cargo\.lock$"]
NOT_WORK_PATHS = [
    r"(^|/)(node_modules|vendor|third_party|dist|build|out|target|\.git|__pycache__|\.venv|venv|site-packages)/",
    r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Gemfile\.lock|composer\.lock|Cargo\.lock|go\.sum|requirements\.txt\.lock)$",
    r"\.(min\.js|min\.css|map|snap|lock|svg|png|jpe?g|gif|ico|woff2?|ttf|eot|pdf|mp4)$",
]
WORK_TEST_PATHS = [r"(^|/)(tests?|spec|__tests__|e2e)/", r"(^|/)(test_|conftest)", r"[._-](test|spec)\.[a-z0-9]+$"]
MOST_FILES, MOST_DIRS, BULK_TESTS, BULK_WORK, MOST_TASKS = 30, 3, 5, 3, 15
ADDED_PER_DELETED, PER_FILE, PER_DIR, PER_CHURN, MEDIUM_AT, LARGE_AT = 10, 0.15, 0.1, 2000.0, 0.33, 0.66
LEAST_CHURN, MOST_CHURN, LEAST_WORK_FILES = 20, 10_000, 2
LAST, BURST_COMMITS, BURST_DAYS, BURST_AUTHORS = 200, (2, 12), 2, 2
# End of the fixed values.

BLOCK = 1 << 16


def is_bot(name: Column, address: Column) -> Column:
    return F.concat_ws(" ", name, address).rlike(any_of(BOTS))


def owned_lines(lines: DataFrame) -> DataFrame:
    """lines (repo_id, line_no, text) with header: the line_no of the header line that owns the line, null before the first.

    Filled forward by blocks of line numbers: a window over each block, and one over a single row for each block to carry
    the last header on, so that a long history is not one task.
    """
    own = F.when(F.col("text").contains(SEPARATOR), F.col("line_no"))
    rows = lines.withColumns({"own": own, "block": F.floor(F.col("line_no") / BLOCK)})
    before = Window.partitionBy("repo_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("repo_id", "block").agg(F.max("own").alias("last")).select("repo_id", "block", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("repo_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.max("own").over(within)).join(carried, ["repo_id", "block"])
    return rows.select("repo_id", "line_no", "text", F.coalesce("within", "carried").alias("header"))


def commits(lines: DataFrame) -> DataFrame:
    """(repo_id, header, sha, short, name, address, at, subject, is_bot) of each header line; at keeps its offset, as text."""
    part = F.split("text", SEPARATOR, 6)
    rows = lines.where(F.col("text").contains(SEPARATOR)).select("repo_id", F.col("line_no").alias("header"), *(part[k].alias(n) for k, n in enumerate(("sha", "short", "name", "address", "at", "subject"))))
    return rows.withColumn("is_bot", is_bot(F.col("name"), F.col("address")))


def commit_files(lines: DataFrame) -> DataFrame:
    """(repo_id, header, path, added, deleted) of each file line; binary files have 0 lines; other lines are dropped."""
    part = F.split("text", "\t")
    rows = owned_lines(lines).where("header IS NOT NULL AND header <> line_no").where(F.size(part) == 3)
    a, d = (F.when(part[k] == "-", F.lit(0)).otherwise(F.expr(f"try_cast(split(text, '\\t')[{k}] AS BIGINT)")) for k in (0, 1))
    wrong = a.isNull() | d.isNull()
    return rows.select("repo_id", "header", part[2].alias("path"), F.when(wrong, 0).otherwise(a).cast("bigint").alias("added"), F.when(wrong, 0).otherwise(d).cast("bigint").alias("deleted"))


def commit_classes(log: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each commit: its counts, klass (A, B, C-pre or null), latent_tasks, is_repair, repair_complexity, band,
    and is_mineable. A commit without files has counts of 0.

    Commits and their files are dealt once to parts whose number grows with the commits; what is counted by commit stays there."""
    parts = scans.parts(log, log.count(), scans.TASK_ROWS)
    log, files = (df.repartition(parts, "repo_id", "header") for df in (log, files))
    p = F.col("path")
    test, support, prose = (p.rlike(any_of(x)) for x in (TEST_PATHS, TEST_SUPPORT_PATHS, PROSE_PATHS))
    waste, work_test = p.rlike(any_of(NOT_WORK_PATHS)), p.rlike(any_of(WORK_TEST_PATHS))
    churn = F.col("added") + F.col("deleted")
    counts = {
        "files": F.count("*"),
        "tests": F.count_if(test),
        "work": F.count_if(~test & ~support & ~prose),
        "schemas": F.count_if(p.rlike(any_of(SCHEMA_PATHS))),
        "dirs": F.count_distinct(F.when(p.contains("/"), F.substring_index(p, "/", 1))),
        "added": F.sum("added"),
        "deleted": F.sum("deleted"),
        "mined_files": F.count_if(~waste & ~work_test),
        "mined_churn": F.sum(F.when(~waste, churn)),
    }
    each = files.groupBy("repo_id", "header").agg(*(v.alias(k) for k, v in counts.items()))
    rows = log.join(each, ["repo_id", "header"], "left").fillna(0, list(counts))
    s, human = F.col("subject"), ~F.col("is_bot")
    small = (F.col("files") <= MOST_FILES) & (F.col("dirs") <= MOST_DIRS)
    real = human & ~s.rlike(NOISE)
    a = small & real & (F.col("tests") >= 1) & (F.col("work") >= 1)
    b = real & (F.col("tests") >= BULK_TESTS) & (F.col("work") < BULK_WORK)
    c = small & human & (F.col("work") >= 1) & (F.col("tests") == 0) & s.rlike(FEATURE)
    klass = F.when(a, "A").when(b, "B").when(c, "C-pre")
    shown = (F.col("deleted") >= 1) & ((F.col("tests") >= 1) | (F.col("added") <= ADDED_PER_DELETED * F.col("deleted")))
    # Shares are added up as decimals and thousandths are rounded as the double they are, so that halves go the way they do in SQL.
    shares = (F.lit(Decimal(str(PER_FILE))) * F.col("work") + F.lit(Decimal(str(PER_DIR))) * F.col("dirs")).cast("double")
    size = F.round(F.least(F.lit(1.0), shares + (F.col("added") + F.col("deleted")) / PER_CHURN) * 1000) / 1000
    rows = rows.withColumns({"klass": klass, "is_repair": s.rlike(REPAIR) & (F.col("work") >= 1) & human & shown, "repair_complexity": size})
    return rows.withColumns(
        {
            "latent_tasks": F.when(F.col("klass") == "B", F.least("tests", F.lit(MOST_TASKS))).when(F.col("klass").isNotNull(), 1).otherwise(0).cast("bigint"),
            "confidence": F.col("klass").isNotNull().cast("int") + s.rlike(FEATURE).cast("int") + (F.col("schemas") > 0).cast("int"),
            "band": F.when(F.col("repair_complexity") < MEDIUM_AT, "Small").when(F.col("repair_complexity") < LARGE_AT, "Medium").otherwise("Large"),
            "is_mineable": human & (F.col("mined_files") >= LEAST_WORK_FILES) & F.col("mined_churn").between(LEAST_CHURN, MOST_CHURN),
        }
    )


def class_counts(classes: DataFrame) -> DataFrame:
    """For each repository: commits of each class, confirmed and provisional candidates, real and mineable commits, authors."""
    k = F.col("klass")
    sure = F.sum(F.when(k.isin("A", "B"), F.col("latent_tasks")).otherwise(0))
    return classes.groupBy("repo_id").agg(
        F.count("*").alias("analyzed_commits"),
        F.count_if(k == "A").alias("class_a"),
        F.count_if(k == "B").alias("class_b"),
        F.count_if(k == "C-pre").alias("class_c_pre"),
        F.count_if("is_repair").alias("class_d"),
        sure.alias("confirmed"),
        (sure + F.count_if(k == "C-pre")).alias("provisional"),
        F.count_if(~F.col("is_bot")).alias("real_commits"),
        F.count_if("is_mineable").alias("mineable_commits"),
        F.count_distinct(F.when(~F.col("is_bot"), F.lower(F.trim("address")))).alias("authors"),
    )


def repository_stats(log: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """For each repository: commits, human and bot authors, bot share, days from the last listed commit to the first (floored),
    active_days (local dates), rate of conventional subjects among the newest 200, and whether it looks like a copied burst.

    merges (repo_id, merge_commits) counts what the log leaves out; without it merge_commits is null and so may the last be.
    """
    newest = F.row_number().over(Window.partitionBy("repo_id").orderBy("header"))
    rate = log.select("repo_id", "subject", newest.alias("k")).where(F.col("k") <= LAST).groupBy("repo_id").agg(F.round(F.avg(F.col("subject").rlike(CONVENTIONAL).cast("int")), 4).alias("conventional_rate"))
    who = F.struct("name", "address")
    micros = F.unix_micros(F.to_timestamp("at"))
    stats = log.groupBy("repo_id").agg(
        F.count("*").alias("commits"),
        F.count_distinct(F.when(~F.col("is_bot"), who)).alias("human_authors"),
        F.count_distinct(F.when(F.col("is_bot"), who)).alias("bot_authors"),
        F.round(F.avg(F.col("is_bot").cast("int")), 4).alias("bot_share"),
        F.floor((F.min_by(micros, "header") - F.max_by(micros, "header")) / 86_400_000_000).alias("span_days"),
        F.count_distinct(F.substring("at", 1, 10)).alias("active_days"),
    )
    counted = merges if merges is not None else log.sparkSession.createDataFrame([], "repo_id string, merge_commits bigint")
    rows = stats.join(rate, "repo_id").join(counted, "repo_id", "left")
    burst = F.col("commits").between(*BURST_COMMITS) & (F.col("span_days") <= BURST_DAYS) & (F.col("merge_commits") == 0) & (F.col("human_authors") <= BURST_AUTHORS)
    return rows.withColumn("looks_like_burst_copy", burst)


def commits_by_month(log: DataFrame, months: int = 12) -> DataFrame:
    """(repo_id, commits_by_month): counts of the months up to the newest commit's, oldest first, in the commits' own offsets."""
    month = F.substring("at", 1, 7)
    each = log.groupBy("repo_id", F.to_date(F.concat(month, F.lit("-01"))).alias("month")).agg(F.count("*").alias("n")).where("month IS NOT NULL")
    slots = each.groupBy("repo_id").agg(F.max("month").alias("last"), F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("n"))
    wanted = F.sequence(F.add_months("last", 1 - months), F.col("last"), F.expr("interval 1 month"))
    return slots.select("repo_id", F.transform(wanted, lambda m: F.coalesce(F.element_at("n", m), F.lit(0))).alias("commits_by_month"))


def collapsed_refs(refs: DataFrame, most: int | None = 12) -> DataFrame:
    """refs (repo_id, ref, object_type, sha, peeled_sha, commits) with one row for each commit: its first name, the number of
    names, and its place by commits; the first `most` places stay, or all of them."""
    tip = F.when((F.col("object_type") == "tag") & F.col("peeled_sha").isNotNull(), F.col("peeled_sha")).otherwise(F.col("sha"))
    each = refs.withColumn("tip", tip).groupBy("repo_id", "tip").agg(F.min("ref").alias("ref"), F.count("*").alias("names"), F.max("commits").alias("commits"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("commits"), "ref")))
    return ranked if most is None else ranked.where(F.col("place") <= most)
