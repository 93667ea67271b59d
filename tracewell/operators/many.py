"""What many schema changes break, in one traversal.

Changes are numbered and packed, 64 to a word: a row (word, node_id, bits) says which changes of the
word reach a node. A hop moves the bits that are new along the edges, merges them with bit_or and
masks what was there, so it costs a row for each word and node instead of one for each change. Scores
don't depend on the change and are computed once for each node.

What is attached to columns is reached by nearly as many pairs of changes and assets as there are paths
to it. These pairs are never shuffled: a column's changes travel as lists to the assets attached to it,
where an asset's lists meet, lose their repeats and are counted by change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.model import LABELS
from tracewell.operators.impact import SchemaChange, flow_edges, ranked
from tracewell.operators.traverse import DEPTH
from tracewell.runtime import counted, forget, hand_over, materialize, stored

_KEY = ["word", "node_id"]
#: A list's changes, about; the lists of an asset that meet in one row; the lists that a task reads.
_LIST, _MEET, _A_TASK = 1000, 1000, 300_000
#: What is counted of an asset: its kinds as 0 or 1.
_COUNTS = {"p0_count": "sla_tier = 'P0'", "p1_count": "sla_tier = 'P1'", "dashboards": "node_type = 'Dashboard'", "features": "node_type = 'MLFeature'", "datasets": "node_type = 'Dataset'"}


def numbered(changes: DataFrame) -> DataFrame:
    """The changes (a column node_id, others as they are) with the word and the bit that each has from now on."""
    # The numbers differ from run to run, so they are written before anything reads them.
    n = changes.withColumn("number", F.monotonically_increasing_id())
    return materialize(n.select(*changes.columns, F.expr("number div 64").alias("word"), F.expr("shiftleft(1L, cast(number % 64 as int))").alias("bit")), "changes")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.bit_or("bits").alias("bits"))


def step(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The bits of what is one hop from the rows; not merged."""
    return rows.join(pairs.withColumnRenamed("src", "node_id"), "node_id").select("word", F.col("dst").alias("node_id"), "bits")


def many_bfs(pairs: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, node_id, bits) of what each change reaches within ``depth`` hops, its own start left out.

    starts: (word, node_id, bits). Cycles end at what a change visited. No starts or edges: no rows.
    """
    pairs = stored(pairs.select("src", "dst"), "many-edges")
    own = _merged(starts).withColumnRenamed("bits", "start")
    state = materialize(own.select(*_KEY, "start", F.col("start").alias("bits"), F.col("start").alias("fresh")), "many-level")
    for _ in range(depth):
        moved = _merged(step(state.where("fresh <> 0").select(*_KEY, F.col("fresh").alias("bits")), pairs)).withColumnRenamed("bits", "got")
        met = state.drop("fresh").join(moved, _KEY, "full").na.fill(0, ["start", "bits", "got"])
        seen = Observation()
        now = met.select(*_KEY, "start", F.expr("bits | got").alias("bits"), F.expr("got & ~bits").alias("fresh")).observe(seen, F.count_if(F.col("fresh") != 0).alias("n"))
        state, old = materialize(now, "many-level"), state
        forget(old)
        if not seen.get["n"]:
            break
    return hand_over(state, state.select(*_KEY, F.expr("bits & ~start").alias("bits")).where("bits <> 0"))


def _fan(flow: DataFrame, found: DataFrame) -> DataFrame:
    """(node_id, fan_out) of the nodes found, distinct, along the flow."""
    near = flow.select("src", "dst").join(found.select(F.col("node_id").alias("src")), "src", "left_semi").distinct()
    fan = found.join(near.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n")), "node_id", "left")
    return fan.select("node_id", F.coalesce("n", F.lit(0)).alias("fan_out"))


def _scored(nodes: DataFrame, fan: DataFrame, change_type: str, column: bool) -> DataFrame:
    """(node_id, p0_count, ..., criticality_score): what an asset adds to a report."""
    labels = LABELS if column else [x for x in LABELS if x != "Column"]
    scored = ranked(nodes, fan, SchemaChange("", None, change_type), column, kept=None).where(F.col("node_type").isin(*labels))
    return scored.select("node_id", *(F.expr(f"cast({kind} AS int)").alias(name) for name, kind in _COUNTS.items()), "criticality_score")


def _lists(cols: DataFrame) -> DataFrame:
    """(node_id, numbers): the numbers of the changes that reach a node, in lists of bounded length."""
    large = cols.groupBy("node_id").agg(F.sum(F.bit_count("bits")).alias("n")).where(f"n > {_LIST}")
    part = F.expr(f"coalesce(pmod(word, n div {_LIST} + 1), 0)")
    each = cols.join(large, "node_id", "left").select("node_id", part.alias("part"), "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
    each = each.where("getbit(bits, place) = 1").select("node_id", "part", F.expr("word * 64 + place").alias("number"))
    return each.groupBy("node_id", "part").agg(F.collect_list("number").alias("numbers")).select("node_id", "numbers")


def _column_counts(nodes: DataFrame, flow: DataFrame, starts: DataFrame, change_type: str, depth: int) -> DataFrame:
    """(node_id, total, ...) of the starts: a column's change goes from column to column; then the datasets of these,
    the transforms that consume and what reads those datasets are attached, and the pipelines of all these."""
    kinds = lambda *k: flow.where(F.col("rel_type").isin(*k)).select(F.col("src").alias("at"), "dst")
    cols = many_bfs(kinds("FEEDS").withColumnRenamed("at", "src"), starts.select("word", "node_id", F.col("bit").alias("bits")), depth)
    starts = starts.select("node_id", F.expr("word * 64 + length(bin(bit)) - 1").alias("number"))
    lists = materialize(_lists(cols).select("node_id", F.lit(False).alias("own"), "numbers").unionAll(starts.select("node_id", F.lit(True), F.array("number"))), "many-lists")
    forget(cols)
    # What is attached to a column; what consumes it is affected by a change of the column itself too.
    at = lambda rows, *k: rows.withColumnRenamed("dst", "at").join(kinds(*k), "at").select("src", "own", "dst")
    columns = materialize(lists.select(F.col("node_id").alias("src"), "own", F.col("node_id").alias("dst")).distinct(), "many-columns")
    reached = columns.where("not own")
    sets = materialize(at(reached, "COLUMN_OF"), "many-datasets")
    users = materialize(at(columns, "CONSUMED_BY").unionAll(at(sets, "READ_BY", "PRODUCES")), "many-users")
    attached, n = counted(reached.unionAll(sets).unionAll(users).unionAll(at(users, "RUNS_IN").distinct()), "many-attached")
    met = materialize(attached.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("lists")), "many-found")
    info = _scored(nodes, _fan(flow, met.select("node_id")), change_type, True).join(met, "node_id").join(starts, "node_id", "left")
    values = [*_COUNTS, "criticality_score"]
    info = materialize(info.select(F.col("node_id").alias("dst"), F.monotonically_increasing_id().alias("asset"), F.expr(f"lists > {_MEET}").alias("wide"), F.col("number").alias("mine"), *values), "many-assets")
    # An asset's number and values stand in the rows from here on.
    key = ["asset", "mine", *values]
    sent = attached.join(info, "dst").select(F.col("src").alias("node_id"), "own", "wide", *key)
    sent = sent.join(lists, ["node_id", "own"])
    tasks = n // _A_TASK + 1
    few = sent.where("not wide").select(*key, "numbers").repartition(tasks, "asset").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers")).select(*key, F.explode("numbers").alias("number"))
    wide = sent.where("wide").select(*key, F.explode("numbers").alias("number")).distinct()
    each = few.unionAll(wide).where("mine is null or number <> mine")
    got = each.groupBy("number").agg(F.count(F.lit(1)).alias("total"), *(F.sum(c).alias(c) for c in _COUNTS), F.max("criticality_score").alias("top_score"))
    got = materialize(got.join(starts, "number").drop("number"), "many-counts")
    forget(lists, columns, sets, users, attached, met, info)
    return got


def _dataset_counts(nodes: DataFrame, flow: DataFrame, starts: DataFrame, change_type: str, depth: int) -> DataFrame:
    """(node_id, total, ...) of the starts: a dataset's change goes along the whole flow, without columns."""
    own = starts.select("word", "node_id", F.col("bit").alias("bits"))
    pairs = flow.where(F.col("rel_type").isin("FEEDS", "READ_BY", "WRITES_TO", "PRODUCES", "CONSUMED_BY", "RUNS_IN")).select("src", "dst")
    found = many_bfs(pairs, own, depth).join(nodes.where("label <> 'Column'").select("node_id").distinct(), "node_id", "left_semi").select(*_KEY, "bits")
    found = materialize(found, "many-found")
    values = [*_COUNTS, "criticality_score"]
    scored = _scored(nodes, _fan(flow, found.select("node_id").distinct()), change_type, False)
    # A word's counts of one kind of asset meet before the bits are told apart.
    same = found.join(scored, "node_id").groupBy("word", "bits", *values).agg(F.count(F.lit(1)).alias("n"))
    each = starts.join(same, "word").where("(bits & bit) <> 0")
    return each.groupBy("node_id").agg(F.sum("n").alias("total"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in _COUNTS), F.max("criticality_score").alias("top_score"))


def reports(nodes: DataFrame, edges: DataFrame, changes: DataFrame, change_type: str = "drop_column", column: bool = True, depth: int = DEPTH) -> DataFrame:
    """For each change (its columns, node_id among them): total, p0_count, p1_count, dashboards, features, datasets
    of the affected assets and the highest score. Changes that reach nothing have zeros and no score; changes that
    are repeated each have a row. Null nodes reach nothing."""
    starts = numbered(changes.select("node_id").where("node_id is not null").distinct())
    flow = materialize(flow_edges(nodes, edges), "many-flow", by="rel_type")
    got = (_column_counts if column else _dataset_counts)(nodes, flow, starts, change_type, depth)
    totals = ["total", *_COUNTS]
    return changes.join(got, "node_id", "left").select(*changes.columns, *totals, "top_score").na.fill(0, totals)
