"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, and cycles.

Method: frontier joins from the roots. Round k joins the nodes not yet reached, each holding
its 2^k-th ancestor, to the nodes reached so far: those whose ancestor is reached get its root,
depth and path; the others double their reach. So the frontier advances by blocks of levels that
double in height, and a chain of depth d needs log2(d) joins instead of d. When a round reaches
nothing, the nodes left over lie on cycles or lead into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymark.operators.orphans import join_hot
from quarrymark.sources.shared import staged


def links(df: DataFrame, name: str, node: str, parent: str) -> DataFrame:
    """(h, id, parent), one row per id of a parent-child table, for ``resolve``.

    Null ids are ignored. An id that occurs with several parents keeps the smallest non-null
    one. An id can thus be repeated freely; columns besides the two are not read.
    """
    return df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("id")).agg(F.min(F.col(parent).cast("long")).alias("parent")).select(F.lit(name).alias("h"), "id", "parent")


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def resolve(edges: DataFrame, paths: bool = False) -> DataFrame:
    """Of (h, id, parent), id unique in each h: h, id, parent, has_parent, root, depth, cyclic[, path].

    root: the topmost ancestor, the first whose parent is null or missing; for a node on a cycle
    or leading into one, the smallest id on that cycle. depth and path (ids from the root to the
    node) are null there, and cyclic is true. An empty table gives no rows.
    """
    edges = staged(edges, "edges")
    # nodes without parent take no part in the join; a parent with very many children is joined apart
    linked = edges.where("parent is not null")
    known = edges.select("h", F.col("id").alias("parent"), F.lit(True).alias("known"))
    named = linked.select("h", "parent").distinct().join(known, ["h", "parent"], "left").select("h", "parent", F.coalesce("known", F.lit(False)).alias("has_parent"))
    tops = edges.where("parent is null").withColumn("has_parent", F.lit(False))
    base = staged(join_hot(linked, named, ["h", "parent"], linked.count()).select("h", "id", "parent", "has_parent").unionByName(tops), "links")
    extra = ["path"] * paths
    first = base.withColumn("path", F.array("id")) if paths else base
    done = first.where("not has_parent").select("h", "id", F.col("id").alias("root"), F.lit(0).alias("depth"), *extra)
    # path of a node not reached: itself and its ancestors below the jump's target
    left = first.where("has_parent").select("h", "id", F.col("parent").alias("jump"), *extra)
    height, rows = 1, base.where("has_parent").count()
    while True:
        step = staged(_advance(left, done, height, extra, rows), "frontier")
        found = step.agg(F.count("root").alias("new"), F.count_if(F.col("root").isNull()).alias("left")).first()
        done = done.unionByName(step.where("root is not null").select("h", "id", "root", "depth", *extra))
        left = step.where("root is null").select("h", "id", "jump", *extra)
        height, rows = 2 * height, found["left"]
        if not found["new"] or not found["left"]:
            break
    done = done.withColumn("cyclic", F.lit(False))
    if found["left"]:
        tail = _cycle_roots(left.select("h", "id", "jump"), base).withColumn("depth", _nothing("int")).withColumn("cyclic", F.lit(True))
        done = done.unionByName(tail.withColumn("path", _nothing("array<bigint>")) if paths else tail)
    return base.join(done, ["h", "id"])


def _advance(left: DataFrame, done: DataFrame, height: int, extra: list[str], rows: int) -> DataFrame:
    """One round: left's nodes with root and depth where their jump's target is reached, else with a jump twice as high."""
    targets = done.withColumn("jump", _nothing("long")).unionByName(left.withColumn("root", _nothing("long")).withColumn("depth", _nothing("int")))
    targets = targets.select("h", F.col("id").alias("jump"), F.col("root").alias("t_root"), F.col("depth").alias("t_depth"), F.col("jump").alias("t_jump"), *[F.col(c).alias("t_path") for c in extra])
    path = [F.concat("t_path", c).alias(c) for c in extra]
    return join_hot(left, targets, ["h", "jump"], rows).select("h", "id", F.col("t_root").alias("root"), (F.col("t_depth") + height).alias("depth"), F.col("t_jump").alias("jump"), *path)


def _cycle_roots(left: DataFrame, base: DataFrame) -> DataFrame:
    """h, id, root of nodes (h, id, jump) from which no root can be reached.

    Doubling the jumps drives every pointer onto its cycle; the set of targets stops shrinking
    exactly when it holds the nodes on cycles alone. The minimum along each cycle is then
    doubled from single links, until a round lowers none.
    """
    size, rows = None, left.count()
    while (aims := left.select("h", "jump").distinct().count()) != size:
        size = aims
        t = left.select("h", F.col("id").alias("jump"), F.col("jump").alias("t_jump"))
        left = staged(join_hot(left, t, ["h", "jump"], rows).select("h", "id", F.col("t_jump").alias("jump")), "tails")
    on_cycle = left.select("h", F.col("jump").alias("id")).distinct()
    ring = staged(base.join(on_cycle, ["h", "id"], "left_semi").select("h", "id", F.col("parent").alias("jump"), F.col("id").alias("least"), F.lit(True).alias("lower")), "rings")
    while ring.where("lower").limit(1).count():
        t = ring.select("h", F.col("id").alias("jump"), F.col("jump").alias("t_jump"), F.col("least").alias("t_least"))
        ring = staged(ring.join(t, ["h", "jump"]).select("h", "id", F.col("t_jump").alias("jump"), F.least("least", "t_least").alias("least"), (F.col("t_least") < F.col("least")).alias("lower")), "rings")
    return join_hot(left, ring.select("h", F.col("id").alias("jump"), "least"), ["h", "jump"], rows).select("h", "id", F.col("least").alias("root"))


def descendants(resolved: DataFrame) -> DataFrame:
    """h, ancestor, node, distance: every pair of a node and one of its ancestors, from paths. Nodes of cycles have none."""
    up = resolved.where("path is not null").select("h", F.col("id").alias("node"), "depth", F.posexplode("path").alias("level", "ancestor"))
    return up.where("level < depth").select("h", "ancestor", "node", (F.col("depth") - F.col("level")).alias("distance"))
