"""The graph of commits: depths, what refs reach, the deepest ref, and the tally of the history behind it.

commits is (repo_id, sha, parents, name, address, at, subject), parents an array of hashes in their order; refs is (repo_id, ref,
object_type, sha, peeled_sha). Parents that are not in the table (a shallow clone) end a history.

First parents make a forest, so pointers along them can be doubled. For depths, one commit in MARKED is a mark: each commit is first
led to the next mark above it, which takes a few rounds over all commits, and only the marks are led to the end of their line.

What refs reach is counted along one line of first parents in each repository, the longest behind a tip: its spine. Each commit off
the spine is told the first commit of the spine that reaches it, so running sums count for every commit of the spine at once, however
many refs there are. A tip off the spine adds the commits of its own line to what the spine's commit reaches where that line begins.

Only lines off the spine that hold merges of their own need more: bits, one for each of their tips, not pairs of tip and commit. Tips
and the other parents of merges are marks, too. Bits go up along the marks' pointers, which are doubled, then to the other parents of
the merges that were passed, as long as some bit is new; at last the commits between two marks take those of the marks below them. A
row is a commit however many refs reach it, and rounds grow with the nesting of merges, not with the length of the history. Tips are
taken in groups of a few words of bits, so that a row is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lineage import cut
from .commits import collapsed_refs, commit_classes, is_bot

# The word by which an anonymising pass names itself, and versions.
ANONYMISED = "anonymi"
SEMVER = r"^v?\d+\.\d+"
# End of the fixed values.

MARKED = 16
WORD, WORDS = 64, 8
BLOCK, CHUNK = 4096, 200_000
COUNTS = ["commits", "merges", "roots"]


def _edges(commits: DataFrame) -> DataFrame:
    """(repo_id, sha, to, place) of parents that are in the table."""
    known = commits.select("repo_id", F.col("sha").alias("to")).distinct()
    return commits.select("repo_id", "sha", F.posexplode("parents").alias("place", "to")).join(known, ["repo_id", "to"], "left_semi")


def _is_marked() -> Column:
    return F.xxhash64("repo_id", "sha") % MARKED == 0


def _segments(commits: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(repo_id, sha, mark, end, steps, at_mark): the next mark above each commit along first parents, or the last commit of the
    line; and for k = 0, 1, ..., (repo_id, sha, to): the ancestor 2^k steps away, where no mark is passed or met on the way."""
    first = _edges(commits).where("place = 0").select("repo_id", "sha", "to").distinct()
    rows = commits.select("repo_id", "sha").distinct().join(first, ["repo_id", "sha"], "left").withColumn("mark", _is_marked())
    if marks is not None:
        rows = rows.join(marks.withColumn("asked", F.lit(True)), ["repo_id", "sha"], "left").withColumn("mark", F.col("mark") | F.col("asked").isNotNull())
    open_, state = F.col("to").isNotNull(), ["repo_id", "sha", "mark", "end", "steps", "at_mark", "open"]
    rows = rows.select("repo_id", "sha", "mark", F.coalesce("to", "sha").alias("end"), open_.cast("long").alias("steps"), F.lit(False).alias("at_mark"), open_.alias("open"))
    left = cut(rows)
    done, left, jumps = left.where("NOT open"), left.where("open"), []
    while not left.isEmpty():
        # Whoever points to a mark has arrived. Rows that have arrived stay out of the join, but for what others point to.
        ahead = done.unionByName(left).select("repo_id", F.col("sha").alias("end"), F.col("mark").alias("met"), F.struct(*state[3:]).alias("next"))
        then = lambda arrived, on: F.when(F.col("met"), arrived).otherwise(on)
        moved = left.join(ahead, ["repo_id", "end"]).select(
            "repo_id", "sha", "mark", then(F.col("end"), F.col("next.end")).alias("end"), (F.col("steps") + then(F.lit(0), F.col("next.steps"))).alias("steps"),
            then(F.lit(True), F.col("next.at_mark")).alias("at_mark"), then(F.lit(False), F.col("next.open")).alias("open"), F.when(~F.col("met"), F.col("end")).alias("via"),
        )
        moved = cut(moved)
        jumps.append(moved.where("via IS NOT NULL").select("repo_id", "sha", F.col("via").alias("to")))
        done, left = done.unionByName(moved.where("NOT open").select(*state)), moved.where("open").select(*state)
    return done.drop("open"), jumps


def _doubled(rows: DataFrame) -> DataFrame:
    """rows (repo_id, sha, to, root, depth) whose pointers go twice as far."""
    ahead = rows.select("repo_id", F.col("sha").alias("to"), F.col("to").alias("next"), F.col("root").alias("end"), F.col("depth").alias("more"))
    moved = rows.where("to IS NOT NULL").join(ahead, ["repo_id", "to"]).select("repo_id", "sha", F.col("next").alias("to"), F.col("end").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))
    return rows.where("to IS NULL").unionByName(moved)


def _levels(marks: DataFrame) -> list[DataFrame]:
    """marks (repo_id, sha, to, root, depth) with pointers 1, 2, 4, ... marks away, until all have come to the end of their line."""
    levels = [cut(marks)]
    while not levels[-1].where("to IS NOT NULL").isEmpty():
        levels.append(cut(_doubled(levels[-1])))
    return levels


def _jumps(rows: DataFrame) -> list[DataFrame]:
    """rows (repo_id, sha, to), and those that lead 2, 4, 8, ... times as far."""
    jumps = [cut(rows)]
    while not jumps[-1].isEmpty():
        ahead = jumps[-1].select("repo_id", F.col("sha").alias("to"), F.col("to").alias("next"))
        jumps.append(cut(jumps[-1].join(ahead, ["repo_id", "to"]).select("repo_id", "sha", F.col("next").alias("to"))))
    return jumps[:-1]


def first_parent_depths(commits: DataFrame) -> DataFrame:
    """(repo_id, sha, depth, root): steps along first parents to the commit that has none, and which that is."""
    rows, _ = _segments(commits)
    marks = cut(rows.where("mark").select("repo_id", "sha", F.when(F.col("at_mark"), F.col("end")).alias("to"), F.col("end").alias("root"), F.col("steps").alias("depth")))
    while not marks.where("to IS NOT NULL").isEmpty():
        marks = cut(_doubled(_doubled(marks)))
    ends = marks.select("repo_id", F.col("sha").alias("end"), "root", "depth")
    led = rows.where("at_mark").join(ends, ["repo_id", "end"]).select("repo_id", "sha", (F.col("steps") + F.col("depth")).alias("depth"), "root")
    return rows.where("NOT at_mark").select("repo_id", "sha", F.col("steps").alias("depth"), F.col("end").alias("root")).unionByName(led)


def _reached(commits: DataFrame, tips: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """tips (repo_id, tip) -> numbered tips (repo_id, tip, word, bit); (repo_id, sha, words...) of the commits that some tip
    reaches, a bit for each tip that does; and the names of the words."""
    own = commits.select("repo_id", F.col("sha").alias("tip"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("tip")) - 1
    numbered = tips.select("repo_id", "tip").distinct().join(own, ["repo_id", "tip"], "left_semi").withColumn("place", place)
    numbered = cut(numbered.select("repo_id", "tip", F.floor(F.col("place") / WORD).cast("int").alias("word"), (F.col("place") % WORD).alias("bit")))
    words = [f"w{k}" for k in range(1 + (numbered.agg(F.max("word")).first()[0] or 0))]
    merged = lambda df: df.groupBy("repo_id", "sha").agg(*(F.bit_or(w).alias(w) for w in words))

    others = cut(_edges(commits).where("place > 0").select("repo_id", "sha", "to"))
    asked = numbered.select("repo_id", F.col("tip").alias("sha")).unionByName(others.select("repo_id", F.col("to").alias("sha"))).distinct()
    rows, jumps = _segments(commits, asked)
    # The commits from each mark up to the next: every distance is a sum of powers of two in one way, so none comes twice.
    inside = rows.where("mark").select("repo_id", F.col("sha").alias("low"), "sha")
    for jump in reversed(jumps):
        inside = inside.join(jump, ["repo_id", "sha"], "left").select("repo_id", "low", F.explode(F.array_compact(F.array("sha", "to"))).alias("sha"))
    inside = cut(inside)
    aside = cut(inside.join(others, ["repo_id", "sha"]).select("repo_id", F.col("low").alias("sha"), "to").distinct())
    up = _jumps(rows.where("mark AND at_mark").select("repo_id", "sha", F.col("end").alias("to")))

    handed = lambda bits, edges: bits.join(edges, ["repo_id", "sha"]).select("repo_id", F.col("to").alias("sha"), *words)
    own_bit = lambda k: F.when(F.col("word") == k, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
    fresh = cut(merged(numbered.select("repo_id", F.col("tip").alias("sha"), *(own_bit(k).alias(w) for k, w in enumerate(words)))))
    seen = fresh.limit(0)
    while not fresh.isEmpty():
        for k, jump in enumerate(reversed(up)):
            fresh = merged(fresh.join(jump, ["repo_id", "sha"], "left").select("repo_id", F.explode(F.array_compact(F.array("sha", "to"))).alias("sha"), *words))
            fresh = cut(fresh) if k % 6 == 5 else fresh
        fresh = cut(fresh)
        seen = cut(merged(seen.unionByName(fresh)))
        known = seen.select("repo_id", "sha", *(F.col(w).alias(f"_{w}") for w in words))
        new = merged(handed(fresh, aside)).join(known, ["repo_id", "sha"], "left")
        new = new.select("repo_id", "sha", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).alias(w) for w in words))
        fresh = cut(new.where(" OR ".join(f"{w} <> 0" for w in words)))
    found = inside.join(seen.withColumnRenamed("sha", "low"), ["repo_id", "low"]).select("repo_id", "sha", *words)
    return numbered, cut(merged(found)), words


def _by_tip(rows: DataFrame, numbered: DataFrame, words: list[str]) -> DataFrame:
    """rows with words -> a row for each tip whose bit is set, with `tip`."""
    places = lambda k, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col(w), i) == 1), lambda i: F.struct(F.lit(k).alias("word"), i.alias("bit")))
    return rows.withColumn("_at", F.explode(F.concat(*(places(k, w) for k, w in enumerate(words))))).select("*", "_at.*").drop("_at", *words).join(numbered, ["repo_id", "word", "bit"]).drop("word", "bit")


def reachable(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """tips (repo_id, tip) -> (repo_id, tip, sha): every commit that each tip reaches, itself included."""
    numbered, found, words = _reached(commits, tips)
    return _by_tip(found, numbered, words).select("repo_id", "tip", "sha")


def listed_refs(refs: DataFrame) -> DataFrame:
    """All refs, with `tip`: what an annotated tag points to, else the ref's own commit."""
    return refs.withColumn("tip", F.when((F.col("object_type") == "tag") & F.col("peeled_sha").isNotNull(), F.col("peeled_sha")).otherwise(F.col("sha")))


def ref_kind(ref: Column) -> Column:
    return F.when(ref.startswith("refs/tags/"), "tag").when(ref.startswith("refs/remotes/"), "remote").when(ref.startswith("refs/heads/"), "local").otherwise("other")


def _trees(key_type: T.DataType) -> tuple[T.StructType, Callable]:
    """(repo_id, sha, to) in stored order -> (repo_id, sha, tree, steps, tin, tout, out), by chunks: the trees that first parents make
    within a chunk, the steps to the tree's top, what numbers in it lie below the commit (tin up to tout, its own is tin), and, of
    tops, the parent outside of the chunk. Logs are stored in their order, so few lines leave a chunk; any order is right."""
    schema = T.StructType([T.StructField("repo_id", key_type), T.StructField("sha", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("tree", "steps", "tin", "tout")), T.StructField("out", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 40, []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if not held or (batch is not None and sum(b.num_rows for b in held) < CHUNK):
                continue
            repos, shas, parents = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in range(3))
            held = []
            keys = list(zip(repos.to_pylist(), shas.to_pylist(), strict=True))
            place = {k: i for i, k in enumerate(keys)}
            n, out = len(keys), parents.to_pylist()
            up = [place.get((r, p), -1) if p is not None else -1 for (r, _), p in zip(keys, out, strict=True)]
            below: list[list[int]] = [[] for _ in range(n)]
            tops = []
            for i, p in enumerate(up):
                (below[p] if p >= 0 else tops).append(i)
            tree, steps, tin, tout, number = [0] * n, [0] * n, [0] * n, [0] * n, 0
            for top in tops:
                own, todo = base + top, [top]
                while todo:
                    i = todo.pop()
                    if i < 0:
                        tout[~i] = number
                        continue
                    tree[i], tin[i], number = own, number, number + 1
                    steps[i] = steps[up[i]] + 1 if up[i] >= 0 else 0
                    todo.append(~i)
                    todo += below[i]
            base += n
            columns = [repos, shas, *(pa.array(c, pa.int64()) for c in (tree, steps, tin, tout)), pa.array([p if u < 0 else None for p, u in zip(out, up, strict=True)], pa.string())]
            yield from pa.Table.from_arrays(columns, schema.names).to_batches(10_000)

    return schema, run


def _spines(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """tips (repo_id, tip) -> (repo_id, sha, depth): the longest line of first parents behind a tip of each repository.

    Lines are followed within chunks of commits first, so that pointers are doubled for the trees of chunks only. A line enters a
    tree once, and its commits there are those that the number of its entry lies below."""
    schema, run = _trees(commits.schema["repo_id"].dataType)
    nodes = cut(commits.where("repo_id IS NOT NULL AND sha IS NOT NULL").select("repo_id", "sha", F.get("parents", F.lit(0)).alias("to")).mapInArrow(run, schema))
    wanted = nodes.where("out IS NOT NULL").select("repo_id", F.col("out").alias("sha")).unionByName(tips.select("repo_id", F.col("tip").alias("sha"))).distinct()
    met = cut(nodes.join(wanted, ["repo_id", "sha"], "left_semi").groupBy("repo_id", "sha").agg(F.min(F.struct("tree", "tin", "steps")).alias("at")).select("repo_id", "sha", "at.*"))
    ahead = met.select("repo_id", F.col("sha").alias("out"), F.col("tree").alias("to"), F.col("tin").alias("entry"), (F.col("steps") + 1).alias("depth"))
    links = cut(nodes.where("steps = 0").select("repo_id", F.col("tree").alias("sha"), "out").join(ahead, ["repo_id", "out"], "left"))
    levels = _levels(links.select("repo_id", "sha", "to", F.col("sha").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth")))
    above = levels[-1].select("repo_id", F.col("sha").alias("tree"), F.col("depth").alias("above"))
    asked = met.join(tips.select("repo_id", F.col("tip").alias("sha")).distinct(), ["repo_id", "sha"]).join(above, ["repo_id", "tree"])
    tops = cut(asked.groupBy("repo_id").agg(F.max(F.struct((F.col("steps") + F.col("above")).alias("depth"), "sha", "tree", "tin")).alias("top")).select("repo_id", "top.*"))
    line = tops.select("repo_id", F.col("tree").alias("sha"))
    for k, level in enumerate(reversed(levels[:-1])):
        line = line.join(level.where("to IS NOT NULL").select("repo_id", "sha", "to"), ["repo_id", "sha"], "left").select("repo_id", F.explode(F.array_compact(F.array("sha", "to"))).alias("sha"))
        line = cut(line) if k % 6 == 5 else line
    entries = links.where("to IS NOT NULL").join(line, ["repo_id", "sha"], "left_semi").select("repo_id", F.col("to").alias("tree"), "entry")
    entries = cut(entries.unionByName(tops.select("repo_id", "tree", F.col("tin").alias("entry"))).join(above, ["repo_id", "tree"]))
    spine = nodes.join(entries, ["repo_id", "tree"]).where("tin <= entry AND entry < tout")
    return cut(spine.select("repo_id", "sha", (F.col("steps") + F.col("above")).alias("depth")).dropDuplicates(["repo_id", "sha"]))


def _since(off: DataFrame, asides: DataFrame) -> DataFrame:
    """(repo_id, sha, since) of commits off the spine that it reaches: the least depth on it that does.

    off is (repo_id, sha, to): first parents off the spine. asides is (repo_id, sha, to, depth): other parents off the spine, with the
    depth of the merge, null off the spine."""
    least = lambda df: df.groupBy("repo_id", "sha").agg(F.min("since").alias("since"))
    jumps = _jumps(off.where("to IS NOT NULL").select("repo_id", "sha", "to"))
    among = asides.where("depth IS NULL").select("repo_id", "sha", "to")
    fresh = cut(least(asides.where("depth IS NOT NULL").select("repo_id", F.col("to").alias("sha"), F.col("depth").alias("since"))))
    seen = fresh
    while not fresh.isEmpty():
        for k, jump in enumerate(jumps):
            fresh = least(fresh.join(jump, ["repo_id", "sha"], "left").select("repo_id", F.explode(F.array_compact(F.array("sha", "to"))).alias("sha"), "since"))
            fresh = cut(fresh) if k % 6 == 5 else fresh
        fresh = cut(fresh)
        seen = cut(least(seen.unionByName(fresh)))
        handed = least(fresh.join(among, ["repo_id", "sha"]).select("repo_id", F.col("to").alias("sha"), "since"))
        fresh = cut(handed.join(seen.withColumnRenamed("since", "known"), ["repo_id", "sha"], "left").where("known IS NULL OR since < known").drop("known"))
    return seen


def _running(rows: DataFrame) -> DataFrame:
    """rows (repo_id, depth, counts) summed up to each depth, by blocks of depths, so that a long line is not one task."""
    rows = rows.groupBy("repo_id", "depth").agg(*(F.sum(c).alias(c) for c in COUNTS)).withColumn("block", F.floor(F.col("depth") / BLOCK))
    before = Window.partitionBy("repo_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("repo_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy("repo_id", "block").agg(*(F.sum(c).alias(c) for c in COUNTS))
    blocks = blocks.select("repo_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in COUNTS))
    return rows.join(blocks, ["repo_id", "block"]).select("repo_id", "depth", *((F.col(f"_{c}") + F.sum(c).over(within)).alias(c) for c in COUNTS))


def _bit_counts(commits: DataFrame, shape: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo_id, tip, counts) by bits, a few words of tips at a time."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("tip")) - 1
    dealt = cut(tips.select("repo_id", "tip", F.floor(place / (WORD * WORDS)).alias("part")))
    parts = dealt.agg(F.max("part")).first()[0]
    out = []
    for part in range(0 if parts is None else parts + 1):
        own = dealt.where(F.col("part") == part).drop("part")
        repos = own.select("repo_id").distinct()
        numbered, found, words = _reached(commits.join(repos, "repo_id", "left_semi"), own)
        # Commits that the same tips reach are counted before tips are told apart.
        alike = found.join(shape, ["repo_id", "sha"]).groupBy("repo_id", *words).agg(*(F.sum(c).alias(c) for c in COUNTS))
        out.append(cut(_by_tip(alike, numbered, words).groupBy("repo_id", "tip").agg(*(F.sum(c).alias(c) for c in COUNTS))))
    return reduce(DataFrame.unionByName, out) if out else dealt.select("repo_id", "tip", *(F.lit(0).cast("long").alias(c) for c in COUNTS))


def _counted(commits: DataFrame, tips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tips (repo_id, tip) -> (repo_id, tip, counts) of what each reaches; and (repo_id, sha, since, own): the commits of the
    spines and those that they reach, with the least depth on the spine that does, and whether they are on it themselves."""
    tips = cut(tips.distinct())
    spine = _spines(commits, tips)
    shape = commits.groupBy("repo_id", "sha").agg(F.count("*").alias("commits"), F.count_if(F.size("parents") > 1).alias("merges"), F.count_if(F.size("parents") == 0).alias("roots"))
    edges = cut(_edges(commits))
    target = spine.select("repo_id", F.col("sha").alias("to"), F.col("depth").alias("joins"))
    first = edges.where("place = 0").select("repo_id", "sha", "to").distinct()
    others = edges.where("place > 0").select("repo_id", "sha", "to").distinct()
    rows = cut(shape.join(spine, ["repo_id", "sha"], "left"))
    off = rows.where("depth IS NULL").drop("depth").join(first, ["repo_id", "sha"], "left").join(target, ["repo_id", "to"], "left")
    merged = others.select("repo_id", "sha", F.lit(1).alias("aside")).distinct()
    # Pointers end where the spine begins: `joins` is its depth there.
    off = off.join(merged, ["repo_id", "sha"], "left").select("repo_id", "sha", *COUNTS, F.when(F.col("joins").isNull(), F.col("to")).alias("to"), "joins", F.coalesce("aside", F.lit(0)).alias("aside"))
    off = cut(off)
    asides = others.join(target, ["repo_id", "to"], "left_anti").join(spine, ["repo_id", "sha"], "left").select("repo_id", "sha", "to", "depth")
    since = _since(off, cut(asides))
    reached = off.join(since, ["repo_id", "sha"]).select("repo_id", "sha", "since", *COUNTS, F.lit(False).alias("own"))
    placed = cut(rows.where("depth IS NOT NULL").select("repo_id", "sha", F.col("depth").alias("since"), *COUNTS, F.lit(True).alias("own")).unionByName(reached))
    upto = cut(_running(placed.select("repo_id", F.col("since").alias("depth"), *COUNTS)))

    lines = off
    while not lines.where("to IS NOT NULL").isEmpty():
        ahead = lines.select("repo_id", F.col("sha").alias("to"), F.struct("to", "joins", "aside", *COUNTS).alias("next"))
        moved = lines.where("to IS NOT NULL").join(ahead, ["repo_id", "to"])
        moved = moved.select("repo_id", "sha", *((F.col(c) + F.col(f"next.{c}")).alias(c) for c in COUNTS), F.col("next.to").alias("to"), F.col("next.joins").alias("joins"), F.greatest("aside", "next.aside").alias("aside"))
        lines = cut(lines.where("to IS NULL").unionByName(moved))
    asked = tips.withColumnRenamed("tip", "sha")
    on = asked.join(spine, ["repo_id", "sha"]).join(upto, ["repo_id", "depth"]).select("repo_id", F.col("sha").alias("tip"), *COUNTS)
    beside = cut(asked.join(lines, ["repo_id", "sha"]))
    base = upto.select("repo_id", F.col("depth").alias("joins"), *(F.col(c).alias(f"_{c}") for c in COUNTS))
    plain = beside.where("aside = 0").join(base, ["repo_id", "joins"], "left").select("repo_id", F.col("sha").alias("tip"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTS))
    rest = _bit_counts(commits, shape, beside.where("aside > 0").select("repo_id", F.col("sha").alias("tip")))
    return on.unionByName(plain).unionByName(rest), placed.select("repo_id", "sha", "since", "own")


def _ref_depths(commits: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    listed = listed_refs(refs)
    counts, placed = _counted(commits, listed.select("repo_id", "tip"))
    return listed.join(counts, ["repo_id", "tip"], "left").fillna(0, COUNTS), placed


def ref_depths(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """All refs with what they reach: commits, merges, roots. Zeros where the tip is not in the table."""
    return _ref_depths(commits, refs)[0]


def chosen_refs(depths: DataFrame) -> DataFrame:
    """(repo_id, ref, tip, commits, candidates): of refs with depths, the deepest; of equal ones, the first by name."""
    ranked = collapsed_refs(depths.select("repo_id", "ref", "object_type", "sha", "peeled_sha", "commits"), None)
    count = F.count("*").over(Window.partitionBy("repo_id"))
    return ranked.withColumn("candidates", count).where("place = 1").select("repo_id", "ref", "tip", "commits", "candidates")


def tallied(commits: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """The history behind each repository's deepest ref: ref_commits, ref_candidates_considered, anonymizer_tip_detected, merges,
    first_at and last_at (of the root and the analysed tip), real_commits, mineable_commits, human_authors, tag_count, semver_tags.

    files is (repo_id, sha, path, added, deleted). Merges are not tallied, nor is a tip that an anonymising pass has appended:
    the history is then that of its first parent.
    """
    depths, placed = _ref_depths(commits, refs)
    depths = cut(depths)
    about = commits.select("repo_id", F.col("sha").alias("tip"), "parents", "name", "address", "subject")
    said = F.lower(F.concat_ws("|", "name", "address", "subject"))
    passed = is_bot(F.concat_ws("|", "name", "address"), F.col("subject")) & said.contains(ANONYMISED)
    chosen = chosen_refs(depths).join(about, ["repo_id", "tip"])
    chosen = chosen.select("repo_id", "commits", "candidates", passed.alias("anonymised"), F.when(passed, F.get("parents", F.lit(0))).otherwise(F.col("tip")).alias("tip"))
    chosen = cut(chosen)
    # What the spine's commits reach is known by its depths.
    tops = cut(chosen.select("repo_id", "tip").join(placed.where("own").select("repo_id", F.col("sha").alias("tip"), F.col("since").alias("top")), ["repo_id", "tip"]))
    behind = placed.join(tops, "repo_id").where("since <= top").select("repo_id", "tip", "sha")
    rest = cut(chosen.select("repo_id", "tip").join(tops, ["repo_id", "tip"], "left_anti"))
    if not rest.isEmpty():
        behind = behind.unionByName(reachable(commits.join(rest, "repo_id", "left_semi"), rest))
    log = cut(commits.select("repo_id", "sha", "parents", "name", "address", "at", "subject").join(behind, ["repo_id", "sha"]))
    shape = log.groupBy("repo_id").agg(
        F.count_if(F.size("parents") > 1).alias("merges"), F.min(F.when(F.size("parents") == 0, F.struct("sha", "at"))).alias("root"), F.max(F.when(F.col("sha") == F.col("tip"), F.col("at"))).alias("last_at"),
    )
    plain = log.where(F.size("parents") < 2)
    plain = plain.select("repo_id", F.col("sha").alias("header"), "name", "address", "at", "subject", is_bot(F.col("name"), F.col("address")).alias("is_bot"))
    each = commit_classes(plain, files.select("repo_id", F.col("sha").alias("header"), "path", "added", "deleted"))
    tally = each.groupBy("repo_id").agg(F.count_if(~F.col("is_bot")).alias("real_commits"), F.count_if("is_mineable").alias("mineable_commits"), F.count_distinct(F.when(~F.col("is_bot"), F.lower(F.trim("address")))).alias("human_authors"))
    # Tags count where the analysed history reaches them.
    tags = depths.where(F.col("ref").startswith("refs/tags/")).select("repo_id", "ref", F.col("tip").alias("sha")).join(behind.drop("tip"), ["repo_id", "sha"], "left_semi")
    tags = tags.groupBy("repo_id").agg(F.count("*").alias("tag_count"), F.count_if(F.substring_index("ref", "/", -1).rlike(SEMVER)).alias("semver_tags"))
    out = chosen.join(shape, "repo_id", "left").join(tally, "repo_id", "left").join(tags, "repo_id", "left")
    counts = ["merges", "real_commits", "mineable_commits", "human_authors", "tag_count", "semver_tags"]
    return out.fillna(0, counts).select("repo_id", F.col("commits").alias("ref_commits"), F.col("candidates").alias("ref_candidates_considered"), F.col("anonymised").alias("anonymizer_tip_detected"), F.col("root.at").alias("first_at"), "last_at", *counts)
