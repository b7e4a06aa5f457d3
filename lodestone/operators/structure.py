"""Functions of source files and the decisions in them, and error handling by lines.

files is (repo_id, path, content). No parser runs: strings and comments are taken out, a file of braces is cut where blocks open,
close and statements end, a Python file into logical lines. A piece is a row; depths are prefix sums or indents, and the function a
decision falls to is the innermost one whose block is open (scans.enclosing). A decision weighs as much as the nodes that a
syntax tree has for it. Functions without braces (arrows, closures, lambdas) have no decisions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import extension
from .scans import by_file, enclosing, lines

# Patterns, and the weights of what a syntax tree has for each word.
SKIPPED_DIRS = (
    r"(?i)(^|/)(node_modules|bower_components|vendor|third_party|thirdparty|dist|build|out|target|bin|obj|\.git|__pycache__|\.venv|venv|env|site-packages|"
    r"coverage|migrations|generated|gen|\.next|\.nuxt|\.terraform|Pods)/"
)
SKIPPED_FILES = r"(?i)\.(min|bundle|generated|pb|_pb2|d)\.[a-z]+$"
TESTS = r"(?i)(^|/)(tests?|spec|specs|__tests__|__mocks__|e2e|fixtures|testdata)/|(^|/)(test_|conftest\.)|[._-](test|spec)\.[a-z0-9]+$"
GENERATED = r"(?i)@generated|DO NOT EDIT|Code generated by|autogenerated"
ERROR_WORDS = (
    r"(?i)\b(try|catch|except|rescue|finally|throw|throws|raise|panic|recover|unwrap_or|map_err|expect_err|ok_or|assert|invariant|precondition|require|"
    r"ensure|unreachable|rethrow|errdefer|bail|anyhow|with_context|runCatching|croak|confess|carp|pcall|xpcall|tryCatch|stopifnot|withCallingHandlers|"
    r"MException|throwIO|catchError|catches|bracket|failwith|badmatch|ex-info|handler-case|ignore-errors|NSError|trap|revert|iostat|SQLERRM|"
    r"RAISE_APPLICATION_ERROR|RAISERROR|die)\b|Write-Error|-ErrorAction|\bset\s+-[a-z]*e\b|\bON\s+SIZE\s+ERROR\b|\bWHEN\s+OTHERS\b|\berror\s+stop\b"
)
ERROR_TYPES = (
    r"\bResult\s*<|\bEither\s*<|errors\.(New|Wrap|Is|As)\b|fmt\.Errorf\b|\berr\s*!=\s*nil\b|\b(Result|Either|Try)\s*\[|\{:?error[,}]|"
    r"\b(errno|perror|strerror)\b"
)
MOST_BYTES = 1_000_000
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".ipynb": "python",
    ".js": "script", ".jsx": "script", ".mjs": "script", ".cjs": "script", ".ts": "script", ".tsx": "script",
    ".go": "go",
    ".rs": "rust",
}
DECISIONS = {
    "python": [(r"\b(?:if|elif|for|while|try)\b", 2), (r"^\s*(?:match|case)\b.*:\s*$", 2), (r"^\s*(?:else|except\b[^:]*|finally)\s*:", 1), (r"\b(?:and|or)\b", 1)],
    "script": [(r"\b(?:if|for|while|switch|case|try|catch)\b", 2), (r"\b(?:else|do|finally)\b|\bdefault\s*:", 1), (r"(?<!\?)\?(?![.?:])", 1)],
    "go": [(r"\b(?:if|for)\b", 2), (r"\b(?:switch|case|select)\b", 1)],
    "rust": [(r"\bmatch\b", 3), (r"\b(?:if|for|while|loop)\b|=>", 2), (r"\belse\b", 1)],
}
HEADS = {
    "python": r"^\s*(?:async\s+)?def\b",
    "script": r"(?s)\bfunction\b|=>\s*\{$|^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+|\*\s*)*(?!if\b|for\b|while\b|switch\b|catch\b|with\b|function\b)[A-Za-z_$#][\w$]*\s*(?:<[^<>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]*)?\{$",
    "go": r"\bfunc\b",
    "rust": r"\bfn\s+\w+",
}
UNBLOCKED = {"python": r"\blambda\b", "script": r"=>(?!\s*\{)", "go": r"(?!)", "rust": r"\|[A-Za-z_&][^|\n]*\|(?!\s*\{)"}
TEXTS = {
    "python": r"""(?s)\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|#[^\n]*""",
    "script": r"""(?s)/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""",
    "go": r"""(?s)/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'|`[^`]*`""",
    "rust": r"""(?s)/\*.*?\*/|//[^\n]*|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\.[^']*)'""",
}
# End of the fixed values.


def notebook_source(content: Column) -> Column:
    """The code cells of a notebook; empty where it is no notebook."""
    cells = F.from_json(content, "cells array<struct<cell_type:string,source:string>>")["cells"]
    source = lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"])
    return F.coalesce(F.array_join(F.transform(F.filter(cells, lambda c: (c["cell_type"] == "code") & c["source"].isNotNull()), source), "\n"), F.lit(""))


def sources(files: DataFrame) -> DataFrame:
    """Source files (repo_id, path, lang, content, is_test): neither vendored nor built. Generated, empty notebooks' and large files
    are left out unless they are tests, which are only counted."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    ext = extension(F.col("path"))
    rows = files.withColumn("lang", F.try_element_at(known, ext)).where("lang IS NOT NULL AND content IS NOT NULL")
    rows = rows.where(~F.col("path").rlike(SKIPPED_DIRS) & ~F.col("path").rlike(SKIPPED_FILES)).withColumn("is_test", F.col("path").rlike(TESTS))
    code = F.when(ext == ".ipynb", notebook_source(F.col("content"))).otherwise(F.regexp_replace("content", "\r\n", "\n"))
    rows = rows.where(F.col("is_test") | (F.octet_length("content") <= MOST_BYTES)).select("repo_id", "path", "lang", code.alias("content"), "is_test", (ext == ".ipynb").alias("notebook"))
    wrong = F.when(F.col("notebook"), F.trim("content") == "").otherwise(F.substring("content", 1, 4096).rlike(GENERATED))
    return rows.where(F.col("is_test") | ~wrong).drop("notebook")


def _by_lang(of) -> Column:
    out = F.lit(None)
    for lang in TEXTS:
        out = F.when(F.col("lang") == lang, of(lang)).otherwise(out)
    return out


def _weight(text: Column, lang: str) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) * w for p, w in DECISIONS[lang]), F.lit(0))


def _before(file: list[str], order: str, value: Column) -> Column:
    """The sum of value over the rows of a file before the row. Files that are read have MOST_BYTES at most, so a window may hold one."""
    return F.coalesce(F.sum(value.cast("long")).over(Window.partitionBy(*file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _pieces(code: DataFrame) -> list[DataFrame]:
    """(repo_id, path, lang, at, depth, opens, is_function, weight, plain): the pieces of each file in order, of files with braces
    and of Python."""
    bare = code.withColumn("content", _by_lang(lambda k: F.regexp_replace("content", TEXTS[k], F.lit("''" if k == "python" else " "))))
    file = ["repo_id", "path"]
    cut = F.regexp_extract_all("content", F.lit(r"(?s)[^;{}]*[;{}]"), 0)
    braced = bare.where("lang <> 'python'").select(*file, "lang", F.posexplode(cut).alias("at", "text"))
    end = F.substring("text", -1, 1)
    braced = braced.withColumn("depth", _before(file, "at", F.when(end == "{", 1).when(end == "}", -1).otherwise(0))).withColumn("opens", end == "{")
    rows = lines(bare.where("lang = 'python'"))
    # Lines inside of brackets go on from the line that opened them.
    brackets = F.regexp_count("text", F.lit(r"[(\[{]")) - F.regexp_count("text", F.lit(r"[)\]}]"))
    rows = rows.withColumn("inside", _before(file, "line", brackets))
    rows = rows.withColumn("before", _before(file, "line", (F.col("inside") <= 0).cast("int"))).withColumn("logical", F.col("before") + (F.col("inside") <= 0).cast("int") - 1)
    said = rows.groupBy(*file, "logical").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text")).where(F.trim("text") != "")
    indent = F.length(F.regexp_extract(F.regexp_replace("text", "\t", "        "), "^( *)", 1)).cast("long")
    python = said.select(*file, F.lit("python").alias("lang"), F.col("logical").cast("int").alias("at"), "text", indent.alias("depth"), F.lit(True).alias("opens"))
    shown = lambda every: every.select(*file, "lang", "at", "depth", "opens", (F.col("opens") & _by_lang(lambda k: F.col("text").rlike(HEADS[k]))).alias("is_function"), _by_lang(lambda k: _weight(F.col("text"), k)).cast("long").alias("weight"), _by_lang(lambda k: F.regexp_count("text", F.lit(UNBLOCKED[k]))).cast("long").alias("plain"))
    return [shown(braced.select(*file, "lang", "at", "text", "depth", "opens")), shown(python)]


def functions(files: DataFrame) -> DataFrame:
    """(repo_id, path, at, decisions): one row for each function of the sources that are no tests.

    at is the piece it begins at, -1 for functions without a block. A function that only wraps others, without a decision of
    its own, is left out.
    """
    braced, python = (_decided(pieces) for pieces in _pieces(by_file(sources(files).where("NOT is_test"))))
    return braced.unionByName(python)


def _decided(pieces: DataFrame) -> DataFrame:
    file = ["repo_id", "path"]
    pieces = enclosing(pieces, file, "at", "depth", F.col("opens"), F.col("is_function"), "owner")
    # A Python function's line holds what follows its colon; a block's head belongs to what stands around it.
    own = F.when(F.col("is_function") & (F.col("lang") == "python"), F.col("at")).otherwise(F.col("owner"))
    gift = lambda to, decisions, wraps: F.struct(to.cast("int").alias("at"), decisions.cast("long").alias("decisions"), wraps.alias("wraps"))
    alone = gift(F.when(F.col("plain") > 0, -1), F.lit(0), F.lit(False))
    itself = lambda place: F.when(F.col("is_function"), place)
    gifts = F.array(gift(own, F.col("weight"), F.col("plain") > 0), gift(itself(F.col("at")), F.lit(0), F.lit(False)), gift(itself(F.col("owner")), F.lit(0), F.lit(True)))
    rows = pieces.select(*file, "plain", F.inline(F.concat(gifts, F.array(alone)))).where("at IS NOT NULL").groupBy(*file, "at").agg(F.sum("decisions").alias("decisions"), F.bool_or("wraps").alias("wraps"), F.sum("plain").alias("plain"))
    # The functions without a block meet at -1, each a row; of the others, those that decide or do not only wrap.
    times = F.when(F.col("at") < 0, F.col("plain")).when((F.col("decisions") > 0) | ~F.col("wraps"), 1).otherwise(0)
    return rows.withColumn("_times", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times.cast("long"))).otherwise(F.array().cast("array<bigint>")))).select(*file, "at", "decisions")


def top_share(values: DataFrame, keys: list[str], value: str, percent: int = 1) -> DataFrame:
    """(keys..., n, total, top): the count and sum of value, and the sum of the largest percent of the values (one at least,
    halves up). Values are counted first, and only the distinct ones put in order."""
    counts = values.groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_value"))
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    most = F.greatest(F.lit(1), F.floor((F.sum("_n").over(Window.partitionBy(*keys)) * percent + 50) / 100))
    rows = counts.withColumns({"_before": before, "_most": most})
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_most") - F.col("_before")))
    return rows.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col("_value") * F.col("_n")).alias("total"), F.sum(F.col("_value") * taken).alias("top"))


def structure(files: DataFrame) -> DataFrame:
    """For each repository with sources: prod_loc, source_files, test_files, n_functions_seen, decisions_gini_top1pct (null without
    functions, 0 without decisions), error_handling_per_kloc (null without sources)."""
    rows = sources(files)
    code = ~F.col("is_test")
    count = lambda c: F.sum(F.when(code, c).otherwise(0))
    loc = F.regexp_count("content", F.lit("\n")) + F.when((F.col("content") != "") & ~F.col("content").endswith("\n"), 1).otherwise(0)
    hits = F.regexp_count("content", F.lit(ERROR_WORDS)) + F.regexp_count("content", F.lit(ERROR_TYPES))
    sums = rows.groupBy("repo_id").agg(count(loc).cast("long").alias("prod_loc"), F.count_if(code).alias("source_files"), F.count_if("is_test").alias("test_files"), count(hits).alias("hits"))
    shares = top_share(functions(files), ["repo_id"], "decisions").select("repo_id", F.col("n").alias("n_functions_seen"), F.when(F.col("total") > 0, F.round(F.col("top") / F.col("total"), 4)).otherwise(0.0).alias("decisions_gini_top1pct"))
    per = F.when(F.col("source_files") > 0, F.round(F.col("hits") / F.greatest(F.col("prod_loc") / 1000, F.lit(0.001)), 3))
    out = sums.join(shares, "repo_id", "left").withColumn("error_handling_per_kloc", per).fillna(0, ["n_functions_seen"])
    return out.select("repo_id", "prod_loc", "source_files", "test_files", "n_functions_seen", "decisions_gini_top1pct", "error_handling_per_kloc")
