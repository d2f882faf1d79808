"""Parent-child links to full hierarchies.

Deterministic hash splitters cut all chains into short stretches; every node walks to its next splitter; the graph of
the splitters alone, a fraction of the nodes, is solved by pointer doubling; nodes then add their stretch to their
splitter's answer. Cycles without a splitter are solved among their own nodes. The number of rounds follows the
logarithm of the depth, and each round reads only the rows still walking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.session import written

SPLIT_EVERY = 8


def _is_splitter(c: Column, every: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(every)) == 0


def latest_links(entries: DataFrame) -> DataFrame:
    """One row (id, parent) for each trimmed, non-blank id: that of its latest timestamp, ties by the larger parent."""
    rows = entries.select(trimmed(F.col("id")).alias("id"), "timestamp", trimmed(F.col("parent_id")).alias("parent")).where("id <> ''")
    return rows.groupBy("id").agg(F.max(F.struct("timestamp", "parent")).alias("top")).select("id", F.nullif(F.col("top.parent"), F.lit("")).alias("parent"))


def _state(df: DataFrame, paths: bool) -> list[str]:
    return ["id", "at", "dist", "low", "done", *(["path"] if paths else [])]


def _hop(active: DataFrame, side: DataFrame, paths: bool) -> DataFrame:
    """One doubling: each active row goes on from where the row it points at has come to. `_via` has that row where it
    is done, as another row may point at it in the next round."""
    fields = _state(side, paths)
    to = side.select(F.col("id").alias("at"), F.struct(*fields).alias("_to"))
    more = [F.concat("path", "_to.path").alias("path")] if paths else []
    return active.join(to, "at").select(
        "id", F.col("_to.at").alias("at"), (F.col("dist") + F.col("_to.dist")).alias("dist"), F.least("low", "_to.low").alias("low"), F.col("_to.done").alias("done"), *more, F.when(F.col("_to.done"), F.col("_to")).alias("_via")
    )


def _double(state: DataFrame, label: str, paths: bool) -> tuple[DataFrame, DataFrame | None]:
    """Doubles until only rows on or below cycles are left: (rows that arrived, rows that cannot).

    What is pointed at in a round was pointed at in the round before, by the row half way: so a round reads the rows
    that were still walking and those they had reached, no others, and rounds shrink as rows arrive."""
    fields = _state(state, paths)
    state = written(state.select(*fields), label)
    arrived, active, side = [state.where("done")], state.where("not done"), state
    left = active.count()
    while left:
        after = written(_hop(active, side, paths), label)
        arrived.append(after.where("done").select(*fields))
        active = after.where("not done").select(*fields)
        now, left = left, active.count()
        if left == now:  # a chain that ends loses rows in every round; these only turn
            break
        if left:
            reached = after.where("_via is not null").groupBy("_via.id").agg(F.any_value("_via").alias("_v")).select("_v.*")
            side = after.select(*fields).unionByName(reached)  # apart: what was done before the round did not walk in it
    done = arrived[0]
    for part in arrived[1:]:
        done = done.unionByName(part)
    return done, active if left else None


def _cycle_roots(turning: DataFrame, label: str) -> DataFrame:
    """(id, root): the smallest id on the cycle that each row is on or below."""
    turning = turning.select("id", "at", "dist", "low", "done")
    count, steps = turning.count(), 1
    while steps < count:  # the rows have gone at least one step already; then as many as there are rows
        turning = written(_hop(turning, turning, False).drop("_via"), label)
        steps *= 2
    on = turning.select(F.col("id").alias("at"), F.col("low").alias("root"))
    return turning.select("id", "at").join(on, "at").select("id", "root")


def hierarchy(links: DataFrame, paths: bool = False, split_every: int = SPLIT_EVERY) -> DataFrame:
    """(id, root_id, depth[, path]) of rows (id, parent) with unique ids.

    A null parent, or one that is no id, makes a root: its own root_id, depth 0. On or below a cycle root_id is the
    smallest id on the cycle, depth -1 and the path null. `path` holds the ids from the root down to the node. Ids
    that are null do not count; an empty table gives an empty result; a self-parent is a cycle of one.
    """
    base = links.select("id", "parent").where("id is not null")
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    nodes = base.join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("up"))
    is_root = F.col("up").isNull()
    start = nodes.select(
        "id",
        F.coalesce("up", "id").alias("at"),
        F.when(is_root, 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("id").alias("low"),
        (is_root | _is_splitter(F.col("up"), split_every)).alias("done"),
        *([F.when(is_root, F.array().cast("array<string>")).otherwise(F.array("id")).alias("path")] if paths else []),
    )
    none = [F.lit(None).cast("array<string>").alias("path")] if paths else []
    walked, turning = _double(start, "walk", paths)
    # The reduced graph: splitters and roots, each with its next one. Roots stay where they are.
    reduced = walked.where(_is_splitter(F.col("id"), split_every) | (F.col("at") == F.col("id")) & (F.col("dist") == 0)).withColumn("done", F.col("dist") == 0)
    circled = None
    if turning is not None:  # a splitter below a cycle without one ends its stretch like a root, and is marked afterwards
        circled = written(_cycle_roots(turning, "turn"), "turned")
        ends = circled.where(_is_splitter(F.col("id"), split_every)).select("id", F.col("id").alias("at"), F.lit(0).cast("bigint").alias("dist"), F.col("id").alias("low"), F.lit(True).alias("done"), *none)
        reduced = reduced.unionByName(ends)
    solved, circling = _double(reduced, "reduced", paths)
    answers = solved.select(F.col("id").alias("at"), F.col("at").alias("root_id"), F.col("dist").alias("_depth"), *([F.col("path").alias("_path")] if paths else []))
    if circled is not None:
        answers = answers.join(circled.select(F.col("id").alias("root_id"), "root"), "root_id", "left")
        answers = answers.withColumns({"root_id": F.coalesce("root", "root_id"), "_depth": F.when(F.col("root").isNotNull(), -1).otherwise(F.col("_depth"))}).drop("root")
        answers = answers.select("at", "root_id", "_depth", *(["_path"] if paths else []))
    if circling is not None:
        bad = _cycle_roots(circling, "circle").select(F.col("id").alias("at"), F.col("root").alias("root_id"), F.lit(-1).cast("bigint").alias("_depth"), *([F.lit(None).cast("array<string>").alias("_path")] if paths else []))
        answers = answers.unionByName(bad)
    depth = F.when(F.col("_depth") < 0, -1).otherwise(F.col("dist") + F.col("_depth")).cast("int").alias("depth")
    down = [F.when(F.col("_depth") >= 0, F.reverse(F.concat("path", "_path", F.array("root_id")))).alias("path")] if paths else []
    result = walked.join(answers, "at").select("id", "root_id", depth, *down)
    if circled is not None:
        result = result.unionByName(circled.select("id", F.col("root").alias("root_id"), F.lit(-1).alias("depth"), *none))
    return result


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance) for each node and each node below it, from a hierarchy with paths; cycles give none."""
    steps = tree.where("path is not null").select(F.col("id").alias("descendant"), F.size("path").alias("_n"), F.posexplode("path").alias("_i", "id"))
    return steps.where("_i < _n - 1").select("id", "descendant", (F.col("_n") - 1 - F.col("_i")).alias("distance"))


def all_descendants(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, loop) for every id, (id, descendant, distance, loop) for each id and each other id below it).

    `loop` is "on" for ids on a loop, "below" for those below one, else null. What is reached by going down from an id
    is below it, at the least number of steps: for ids on a loop these are the loop's other ids and all that hangs from
    any of them, for ids below a loop what hangs from them. Each loop is opened above its smallest id, which makes a
    tree of all that is on or below it; ids of the loop that the opening took out of a path are added to it again."""
    tree = written(hierarchy(links, paths=True), "tree")
    whole = tree.where("depth >= 0")
    looped = tree.where("depth < 0").select("id", "root_id")
    unmarked = F.lit(None).cast("string").alias("loop")
    marks, pairs = whole.select("id", unmarked), descendants(whole).select("*", unmarked)
    if looped.isEmpty():
        return marks, pairs
    caught = looped.join(links.where("id is not null"), "id")
    opened = written(hierarchy(caught.select("id", F.when(F.col("id") != F.col("root_id"), F.col("parent")).alias("parent")), paths=True), "opened")
    loops = caught.where("id = root_id").select("root_id", F.col("parent").alias("id")).join(opened.select("id", F.col("path").alias("_loop")), "id").drop("id")
    placed = written(opened.join(loops, "root_id").withColumn("_on", F.size(F.array_intersect("path", "_loop"))), "placed")
    caught_marks = placed.select("id", F.when(F.expr("_on = size(path)"), "on").otherwise("below").alias("loop"))
    rest = placed.select(F.col("id").alias("descendant"), "_on", F.expr("size(path) - 1 + size(_loop)").alias("_n"), F.posexplode(F.expr("slice(_loop, _on + 1, size(_loop) - _on)")).alias("_i", "id"))
    below = descendants(placed).unionByName(rest.select("id", "descendant", F.expr("_n - _on - _i").alias("distance")))
    return marks.unionByName(caught_marks), pairs.unionByName(below.join(caught_marks, "id"))
