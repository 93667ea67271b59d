"""Graph traversals as frontier joins.

Each hop joins the frontier with the edges, drops what was visited, and is written out; the driver
sees only whether a hop found anything. Small frontiers are broadcast by size at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.runtime import counted, forget, materialize, stored

DEPTH = 8


def hops(edges: DataFrame, rels: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(src, dst) pairs of the relationship types (G21), forward, backward or both ways (G12); a pair
    stands as often as there are edges of it, for making pairs distinct shuffles the whole graph."""
    own = edges if rels is None else edges.where(F.col("rel_type").isin(*rels))
    ahead, back = own.select("src", "dst"), own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": ahead, "in": back, "both": ahead.unionAll(back)}[direction]


def bfs(pairs: DataFrame, starts: DataFrame, depth: int = DEPTH, parents: bool = False, nearest: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """(node_id, level) of the nodes within ``depth`` hops of the starts (column node_id), each once,
    without the starts (G01, G02, G09-G14, G22). With ``parents`` also the least predecessor.

    Cycles and loops end at what was visited. No starts or edges: no rows. Pairs may repeat; each hop
    scans them and lets what it reached be distinct. Pairs that aren't scanned from files are written
    first. With ``nearest`` levels are whole, but none follows the one by which so many nodes (those of
    ``of``, a column node_id, if given) were reached: all that come later are farther.
    """
    pairs = stored(pairs.select("src", "dst"), "bfs-edges")
    visited = [starts.select("node_id").distinct()]
    levels: list[DataFrame] = []
    frontier = visited[0]
    for level in range(1, depth + 1):
        reached = frontier.select(F.col("node_id").alias("src")).join(pairs, "src")
        reached = reached.groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
        seen = reduce(DataFrame.unionAll, visited)
        frontier, n = counted(reached.join(seen, "node_id", "left_anti").withColumn("level", F.lit(level)), "bfs-level")
        if not n:
            break
        levels.append(frontier)
        visited.append(frontier.select("node_id"))
        if nearest is not None:
            nearest -= n if of is None else frontier.join(of.select("node_id"), "node_id", "left_semi").count()
            if nearest <= 0:
                break
    out = reduce(DataFrame.unionAll, levels) if levels else frontier
    return out.select("node_id", "level", "parent") if parents else out.select("node_id", "level")


def paths_from(pairs: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node_id, path): for each node reached the path from its start along least predecessors."""
    tree = materialize(bfs(pairs, starts, depth, parents=True), "bfs-tree")
    begin = starts.select("node_id").distinct().select("node_id", F.array("node_id").alias("path"))
    parts, now = [], begin
    for level in range(1, depth + 1):
        step = tree.where(F.col("level") == level).select(F.col("node_id").alias("to"), F.col("parent").alias("node_id"))
        now = step.join(now, "node_id").select(F.col("to").alias("node_id"), F.concat("path", F.array("to")).alias("path"))
        parts.append(now)
    return reduce(DataFrame.unionAll, parts)


def fan_out(nodes: DataFrame, edges: DataFrame, rels: list[str], direction: str = "in") -> DataFrame:
    """(node_id, fan_out): distinct neighbours by the relationship types; 0 without any."""
    near = hops(edges, rels, direction).distinct().groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_out"))
    return nodes.select("node_id").join(near, "node_id", "left").select("node_id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def longest_trail(edges: DataFrame, starts: DataFrame, rels: list[str], depth: int = DEPTH, acyclic: bool | None = None, direction: str = "in") -> DataFrame:
    """(start, chain): the longest trail that ends at each start and begins at a node without incoming
    edges, as node ids; of equals the least chain (G07, G08). No edge is walked twice.

    With ``acyclic`` only the least chain to each node is kept per hop, which gives the same result on
    graphs without cycles at the cost of one row a node. None finds out: walks that end within the
    depth met no cycle, which would go on for ever; otherwise trails remember their edges within
    strongly connected components, where alone an edge can come again, and forget them on leaving.
    False remembers them everywhere.
    """
    back = stored(hops(edges, rels, direction), "trail-edges")
    if acyclic is None:
        chains, ended = _walk(back, starts, depth, least=True, again=True)
        if not ended:
            # These walks met every node within the depth; only edges from there are read from now on.
            reach = chains.select("node_id").unionAll(starts.select("node_id")).distinct()
            back = materialize(back.join(reach.withColumnRenamed("node_id", "src"), "src", "left_semi").select("src", "dst").distinct(), "trail-near")
            chains = _walk_components(back, starts, depth)
    else:
        chains, _ = _walk(back, starts, depth, least=acyclic)
    whole = chains.join(back.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    return whole.groupBy("start").agg(F.min(F.struct((-F.size("chain")).alias("n"), "chain")).alias("best")).select("start", "best.chain")


def _walk(back: DataFrame, starts: DataFrame, depth: int, least: bool, again: bool = False) -> tuple[DataFrame, bool]:
    """(start, node_id, chain) of all hops, and whether the walks ended within the depth. ``least`` keeps
    one chain a node and hop; ``again`` lets a walk take an edge twice."""
    now = starts.select(F.col("node_id").alias("start"), "node_id").distinct().select("start", "node_id", F.array("node_id").alias("chain"), F.expr("cast(array() as array<string>)").alias("used"))
    found = []
    for _ in range(depth):
        edge = F.concat_ws("\u0001", "node_id", "dst")
        step = now.join(back.select(F.col("src").alias("node_id"), "dst"), "node_id").withColumn("edge", edge)
        if not again:
            step = step.where(~F.expr("array_contains(used, edge)"))
        used = F.col("used") if again else F.concat("used", F.array("edge"))
        step = step.select("start", F.col("dst").alias("node_id"), F.concat(F.array("dst"), "chain").alias("chain"), used.alias("used"))
        if least:
            step = step.groupBy("start", "node_id").agg(F.min(F.struct("chain", "used")).alias("best")).select("start", "node_id", "best.chain", "best.used")
        else:
            step = step.distinct()
        now, n = counted(step, "trail-level")
        if not n:
            break
        found.append(now)
    ended = len(found) < depth
    return (reduce(DataFrame.unionAll, found) if found else now).select("start", "node_id", "chain"), ended


#: Hops of colors in one job: when components are looked for, tables are small against the cost of a job.
_HOPS = 4


def _trimmed(left: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The pairs without most of those that lead from no other pair or to none, and their number."""
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        (kept, n), before = counted(kept.select("src", "dst"), "cyclic-edges"), n
        forget(left)
        left = kept
        if n > before // 2:
            break
    return left, n


def _greatest(pairs: DataFrame) -> DataFrame:
    """(node_id, color): the greatest name of the nodes that reach each node of the pairs, its own included."""
    color = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("color", F.col("node_id")), "cyclic-colors")
    # Each node's pair with itself keeps its color, so a hop is one join and reads the colors once.
    own = color.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    along = materialize(pairs.select("src", "dst").unionAll(own).withColumnRenamed("src", "node_id"), "cyclic-along")
    n = 1
    while n:
        now = color.withColumn("was", F.col("color"))
        for _ in range(_HOPS):
            now = now.join(along, "node_id").groupBy(F.col("dst").alias("node_id")).agg(F.max("color").alias("color"), F.max(F.when(F.col("node_id") == F.col("dst"), F.col("was"))).alias("was"))
        seen = Observation()
        moved = materialize(now.observe(seen, F.count_if(F.col("color") > F.col("was")).alias("n")).select("node_id", "color"), "cyclic-colors")
        forget(color)
        color, n = moved, seen.get["n"]
    forget(along)
    return color


def cyclic_components(pairs: DataFrame) -> DataFrame:
    """(node_id, component) of the nodes on cycles, loops included; a component's name is its greatest node.

    Each node takes the greatest name that reaches it; pairs between names are on no cycle and go. Backwards,
    each takes the greatest name that it reaches by what is left, and pairs between these go too: those that
    reach the name that reaches them are a component. The rest goes round again. Pairs that lead from or to no
    other are trimmed before. Rounds grow with the longest path among what is left, and with the components that
    lie one behind the other in the order of their names.
    """
    loops = pairs.where("src = dst").select(F.col("src").alias("node_id"))
    left, n = counted(pairs.select("src", "dst").where("src <> dst").distinct(), "cyclic-edges")
    found: list[DataFrame] = []
    while n:
        left, n = _trimmed(left, n)
        if not n:
            break
        ahead = _greatest(left)
        inside = materialize(_within(left, ahead), "cyclic-inside")
        behind = _greatest(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found.append(materialize(behind.join(ahead, ["node_id", "color"], "left_semi").select("node_id", F.col("color").alias("component")), "cyclic-found"))
        old = left
        left, n = counted(_within(inside, behind.join(found[-1].select("node_id"), "node_id", "left_anti")), "cyclic-edges")
        forget(old, ahead, inside, behind)
    own = reduce(DataFrame.unionAll, found) if found else loops.limit(0).withColumn("component", F.col("node_id"))
    # A name that only reaches itself by going nowhere is on no cycle unless it has a loop.
    many = own.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    own = own.join(many, "component", "left_semi").select("node_id", "component")
    return materialize(own.unionAll(loops.distinct().join(own, "node_id", "left_anti").withColumn("component", F.col("node_id"))), "cyclic-components")


def _within(pairs: DataFrame, color: DataFrame) -> DataFrame:
    """The pairs whose nodes have the same color."""
    ends = pairs.join(color.select(F.col("node_id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node_id").alias("dst"), F.col("color").alias("b")), "dst")
    return ends.where("a = b").select("src", "dst")


def _walk_components(near: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node_id, chain) of all hops by distinct pairs; one chain, the least, for each start, node and set of
    edges that the trail has used in the component that it is in."""
    of = cyclic_components(near)
    pairs = near.join(of.select(F.col("node_id").alias("src"), F.col("component").alias("a")), "src", "left").join(of.select(F.col("node_id").alias("dst"), F.col("component").alias("b")), "dst", "left")
    pairs = materialize(pairs.select("src", "dst", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("inside")), "trail-pairs")
    now = starts.select(F.col("node_id").alias("start"), "node_id").distinct().select("start", "node_id", F.array("node_id").alias("chain"), F.expr("cast(array() as array<string>)").alias("used"))
    found = []
    for _ in range(depth):
        step = now.join(pairs.withColumnRenamed("src", "node_id"), "node_id").withColumn("edge", F.concat_ws("\u0001", "node_id", "dst")).where("not (inside and array_contains(used, edge))")
        used = F.when(F.col("inside"), F.array_sort(F.concat("used", F.array("edge")))).otherwise(F.expr("cast(array() as array<string>)"))
        step = step.select("start", F.col("dst").alias("node_id"), F.concat(F.array("dst"), "chain").alias("chain"), used.alias("used"))
        now, n = counted(step.groupBy("start", "node_id", "used").agg(F.min("chain").alias("chain")).select("start", "node_id", "chain", "used"), "trail-level")
        if not n:
            break
        found.append(now)
    return (reduce(DataFrame.unionAll, found) if found else now).select("start", "node_id", "chain")
