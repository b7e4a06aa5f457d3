"""YAML documents as rows: one for each scalar, with the path of keys and places that leads to it.

A line is cut into nodes: one for each dash before it, and one for the key or text that is left. A node's ancestors are, for
each depth above its own, the last node before it that stands less deep. They come from windows by file and depth, not from
a stack that a program carries down the file, so a long file is several tasks. A line below the key of a block scalar is
text, whatever it looks like; keys it seems to hold are ancestors of nothing outside of it.

Read: block mappings and sequences (also sequences not deeper than their key), block scalars (literal and folded, with "-"),
quoted and plain scalars over several lines, comments, and flow sequences and mappings of scalars. A flow value inside a flow
value stays text; anchors and aliases are text; "+" of a block scalar is read as its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import by_file

#: A key ends at the first colon before a space or the end; quoted keys are taken whole.
KEY = r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s'"\[\]{},&*!|>%@`#?-][^#]*?|[-?][^\s#][^#]*?)\s*:(?:\s+(.*))?$"""
OPENER = r"^(?:[!&]\S+\s+)*([|>])([-+0-9]*)\s*(?:#.*)?$"
#: A key's depth is 4 for each space before it; a dash is deeper than a key in its column, a dash's block scalar yet more.
STEP, DASH, DASH_TEXT = 4, 2, 3


def _nodes(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, sub, depth, kind, name, rest, opens, lead, text): kinds are item, key, text, comment and blank."""
    lines = by_file(files.where("content IS NOT NULL")).select("repo_id", "path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    lines = lines.where(~F.col("text").rlike(r"^(---|\.\.\.)(\s|$)"))
    bare = F.regexp_replace("text", r"^\s+", "")
    lines = lines.withColumn("kind", F.when(bare == "", "blank").when(bare.startswith("#"), "comment").otherwise("node"))
    lead = F.length(F.regexp_extract("text", "^( *)", 1))
    lines = lines.withColumns({"lead": lead, "dashes": F.when(F.col("kind") == "node", F.regexp_extract("text", r"^ *((?:- +)*(?:-\s*$)?)", 1)).otherwise("")})
    places = F.filter(F.sequence(F.lit(0), F.length("dashes")), lambda i: F.substring(F.col("dashes"), i + 1, F.lit(1)) == "-")
    lines = lines.withColumns({"places": F.when(F.col("dashes") == "", F.array().cast("array<int>")).otherwise(places), "rest": F.when(F.col("kind") == "node", F.expr("rtrim(substring(text, lead + length(dashes) + 1))")).otherwise(F.col("text"))})
    key, opens = F.regexp_extract("rest", KEY, 1), F.col("rest").rlike(OPENER)
    last_dash = F.element_at(F.col("places"), -1)
    own_depth = F.when(opens & (F.size("places") > 0), (F.col("lead") + last_dash) * STEP + DASH_TEXT).otherwise((F.col("lead") + F.length("dashes")) * STEP)
    kind = F.when(F.col("kind") != "node", F.col("kind")).when(key != "", "key").otherwise("text")
    value = F.when(key != "", F.trim(F.coalesce(F.regexp_extract("rest", KEY, 2), F.lit("")))).otherwise(F.col("rest"))
    items = F.transform("places", lambda p, i: F.struct(i.alias("sub"), ((F.col("lead") + p) * STEP + DASH).alias("depth"), F.lit("item").alias("kind"), F.lit("").alias("name"), F.lit("").alias("rest")))
    own = F.struct(F.size("places").alias("sub"), own_depth.alias("depth"), kind.alias("kind"), _unquoted(key).alias("name"), value.alias("rest"))
    all_nodes = F.concat(items, F.when((F.col("kind") == "node") & (F.col("rest") == ""), F.array().cast("array<struct<sub:int,depth:int,kind:string,name:string,rest:string>>")).otherwise(F.array(own)))
    nodes = lines.select("repo_id", "path", "line", "text", "lead", F.inline(all_nodes))
    # A blank line stands as deep as the next line that is not blank: it belongs to a block scalar that goes on below it.
    after = Window.partitionBy("repo_id", "path").orderBy("line", "sub").rowsBetween(1, Window.unboundedFollowing)
    deep = F.when(F.col("kind") != "blank", F.col("depth"))
    opens = F.col("kind").isin("key", "text") & F.col("rest").rlike(OPENER)
    whole = Window.partitionBy("repo_id", "path")
    return nodes.withColumns({"depth": F.coalesce(deep, F.first(deep, True).over(after)), "depths": F.collect_set(deep).over(whole), "opens": opens}).where("depth IS NOT NULL")


def _unquoted(text: Column) -> Column:
    double = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r'(?s)^"(.*)"$', 1), r"\\n", "\n"), r"\\t", "\t"), r"\\(.)", "$1")
    single = F.regexp_replace(F.regexp_extract(text, r"(?s)^'(.*)'$", 1), "''", "'")
    return F.when(text.rlike(r'(?s)^".*"$'), double).when(text.rlike(r"(?s)^'.*'$"), single).otherwise(text)


def _scalar(text: Column) -> Column:
    """The value of a quoted or plain scalar; null for an empty one, ~ and null."""
    quoted = F.regexp_extract(text, r"""(?s)^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?$""", 1)
    plain = F.rtrim(F.regexp_replace(text, r"(^|\s)#.*$", ""))
    return F.when(quoted != "", _unquoted(quoted)).when(~plain.isin("", "~", "null"), plain)


def _split_flow(inner: Column) -> Column:
    """The members of a flow collection: commas outside of quotes and brackets part them."""
    parts = F.regexp_extract_all(inner, F.lit(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|\{[^{}]*\}|\[[^\[\]]*\]|[^,])+)"""), 1)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def values(files: DataFrame) -> DataFrame:
    """files (repo_id, path, content) -> (repo_id, path, line, keys, value, is_plain), a row for each scalar of each file.

    keys are mapping keys and, for the members of sequences, their places as "[0]", "[1]" and so on. Empty scalars have a null
    value; is_plain says that the value was not quoted and no block scalar. Null contents and files without scalars give no
    rows. A file whose lines unreadable() finds fault with gives rows too; leave it out with an anti join.
    """
    file = ["repo_id", "path"]
    wide = _nodes(files).withColumn("level", F.explode("depths")).drop("depths")
    # At each level, the nodes that stand less deep are what deeper ones look back at.
    before = Window.partitionBy(*file, "level").orderBy("line", "sub").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when((F.col("depth") < F.col("level")) & F.col("kind").isin("item", "key", "text"), F.struct("line", "sub", "kind", "name", "opens"))
    found = wide.withColumn("above", F.last(seen, True).over(before)).where("level <= depth")
    rows = found.groupBy(*file, "line", "sub").agg(*(F.first(c).alias(c) for c in ("kind", "name", "rest", "opens", "text", "lead")), F.array_sort(F.collect_set("above")).alias("above"))
    # What stands below a block scalar's key is its text; plain text holds nothing.
    rows = rows.withColumn("scalar", F.get(F.filter("above", lambda a: a["opens"]), F.lit(0)))
    rows = rows.withColumn("above", F.filter("above", lambda a: a["kind"] != "text"))
    rows = rows.withColumn("parent", F.try_element_at("above", F.lit(-1)))
    is_tree = F.col("scalar").isNull() & F.col("kind").isin("item", "key", "text")

    siblings = Window.partitionBy(*file, "parent.line", "parent.sub", is_tree & (F.col("kind") == "item")).orderBy("line", "sub")
    rows = rows.withColumn("place", F.when(is_tree & (F.col("kind") == "item"), F.concat(F.lit("["), F.row_number().over(siblings) - 1, F.lit("]"))))

    # Each row says what it is, and gives its words or its line to the node that they belong to.
    nothing = {"own": F.lit(None), "holds": F.lit(False), "word": F.lit(None), "row": F.lit(None)}
    kinds = {
        "own": "struct<kind:string,name:string,place:string,rest:string,opens:boolean,above:array<struct<line:int,sub:int,kind:string,name:string,opens:boolean>>>", "holds": "boolean",
        "word": "struct<line:int,sub:int,rest:string>", "row": "struct<line:int,blank:boolean,lead:int,text:string>",
    }

    def given(at: Column, when: Column, **what: Column) -> Column:
        parts = [(what.get(k) if k in what else v).cast(kinds[k]).alias(k) for k, v in nothing.items()]
        return F.when(when, F.struct(F.coalesce(at["line"], F.lit(-1)).alias("line"), F.coalesce(at["sub"], F.lit(-1)).alias("sub"), *parts))

    is_word = is_tree & (F.col("kind") == "text") & ~F.col("opens")
    gifts = F.array_compact(
        F.array(
            given(F.struct("line", "sub"), is_tree & ~is_word, own=F.struct("kind", "name", "place", "rest", "opens", "above")),
            given(F.col("parent"), is_tree & F.col("parent").isNotNull(), holds=F.lit(True)),
            given(F.col("parent"), is_word, word=F.struct("line", "sub", "rest")),
            given(F.col("scalar"), F.col("scalar").isNotNull() & (F.col("sub") == 0), row=F.struct("line", (F.col("kind") == "blank").alias("blank"), "lead", "text")),
        )
    )
    ends = rows.select(*file, F.inline(gifts)).groupBy(*file, "line", "sub").agg(F.first("own", True).alias("own"), F.bool_or("holds").alias("holds"), F.array_sort(F.collect_list("word")).alias("words"), F.array_sort(F.collect_list("row")).alias("block"))
    ends = ends.where("own IS NOT NULL").select(*file, "line", "sub", "own.*", "holds", "words", "block")

    first = F.get(F.filter("block", lambda r: ~r["blank"]), F.lit(0))["lead"]
    body = F.array_join(F.transform("block", lambda r: F.when(r["blank"], "").otherwise(F.substring(r["text"], F.coalesce(F.col("first"), F.lit(0)) + 1, F.length(r["text"])))), "\n")
    folded = F.regexp_replace(F.regexp_replace("body", r"(?<=[^\n])\n(?=[^\s])", " "), r"\n\n", "\n")
    text = F.concat(F.when(F.regexp_extract("rest", OPENER, 1) == ">", folded).otherwise(F.col("body")), F.when(F.regexp_extract("rest", OPENER, 2).contains("-"), "").otherwise("\n"))
    flat = F.trim(F.concat_ws(" ", F.when(F.col("kind") == "key", F.col("rest")), F.transform("words", lambda w: w["rest"])))
    ends = ends.withColumn("first", first).withColumn("body", body).withColumns({"flat": F.when(~F.col("opens"), flat), "value": F.when(F.col("opens"), F.when(F.size("block") == 0, "").otherwise(text))})
    # The places of the file's items, and of its nodes those that are scalars, meet in a row of the file.
    is_end = F.col("opens") | (F.col("flat") != "") | ~F.col("holds")
    at = F.concat(F.col("line"), F.lit("."), F.col("sub"))
    end = F.struct("line", "sub", "kind", "name", "place", "above", "value", "flat", "opens")
    whole = ends.groupBy(*file).agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct(at.alias("at"), "place")))).alias("places"), F.collect_list(F.when(is_end, end)).alias("ends"))
    step = lambda n: F.when(n["kind"] == "item", F.try_element_at("places", F.concat(n["line"], F.lit("."), n["sub"]))).otherwise(n["name"])
    none = F.array().cast("array<string>")
    keys = lambda e: F.concat(F.transform(e["above"], step), F.when((e["kind"] == "text") | (e["line"] < 0), none).otherwise(F.array(F.coalesce(e["place"], e["name"]))))
    ends = whole.select(*file, F.inline(F.transform("ends", lambda e: F.struct(e["line"].alias("line"), keys(e).alias("keys"), e["value"].alias("value"), e["flat"].alias("flat"), e["opens"].alias("opens")))))

    flow = F.regexp_extract("flat", r"(?s)^([\[{])(.*)[\]}]\s*(?:#.*)?$", 1)
    inner = F.regexp_extract("flat", r"(?s)^([\[{])(.*)[\]}]\s*(?:#.*)?$", 2)
    ends = ends.withColumns({"flow": F.coalesce(flow, F.lit("")), "members": F.when(flow != "", _split_flow(inner))})
    named = F.col("flow") == "{"
    at = F.transform("members", lambda v, i: F.struct(F.when(named, _unquoted(F.trim(F.regexp_replace(v, r"(?s):(\s.*)?$", "")))).otherwise(F.concat(F.lit("["), i, F.lit("]"))).alias("element"), F.when(named, F.trim(F.regexp_extract(v, r"(?s):\s+(.*)$", 1))).otherwise(v).alias("flat")))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("element"), F.col("flat").alias("flat")))
    out = ends.select(*file, "line", F.col("keys").alias("above"), "opens", "value", F.inline(F.when(F.col("flow") != "", at).otherwise(alone)))
    keys = F.when(F.col("element").isNull(), F.col("above")).otherwise(F.array_append("above", F.col("element")))
    plain = ~F.col("opens") & ~F.coalesce(F.col("flat").rlike("""^["']"""), F.lit(False))
    return out.select(*file, "line", keys.alias("keys"), F.when(F.col("opens"), F.col("value")).otherwise(_scalar(F.col("flat"))).alias("value"), plain.alias("is_plain"))


def unreadable(files: DataFrame) -> DataFrame:
    """(repo_id, path) of files that are no YAML document: a tab before a key or dash, text at the margin of a file that has
    keys there, a second document, or a bracket that is never closed. Lines of block scalars with such marks count as well,
    but for what stands deeper than the margin."""
    lines = by_file(files.where("content IS NOT NULL")).select("repo_id", "path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    starts = F.col("text").rlike(r"^---(\s|$)")
    body = F.col("text").rlike(r"^[^\s#]") & ~starts
    tab = F.col("text").rlike(r"^ *\t[ \t]*(- |[A-Za-z_][\w.-]*:(\s|$))")
    stray = body & ~F.col("text").rlike(KEY) & ~F.col("text").rlike(r"^(- |-$|%|\.\.\.|[\]}])")
    keyed = body & F.col("text").rlike(KEY)
    open_ = F.col("text").rlike(r"""^[^\s#'"]*:\s+\[[^\]#]*$|^[^\s#'"]*:\s+\{[^}#]*$""")
    close = F.col("text").rlike(r"[\]}]\s*(#.*)?$")
    faults = lines.groupBy("repo_id", "path").agg(
        F.count_if(tab).alias("tabs"), F.count_if(stray).alias("strays"), F.count_if(keyed).alias("keyed"), F.min(F.when(body, F.col("line"))).alias("first"),
        F.max(F.when(starts, F.col("line"))).alias("second"), F.max(F.when(open_, F.col("line"))).alias("opened"), F.max(F.when(close, F.col("line"))).alias("closed"),
    )
    return faults.where("tabs > 0 OR (strays > 0 AND keyed > 0) OR second > first OR opened > coalesce(closed, -1)").select("repo_id", "path")
