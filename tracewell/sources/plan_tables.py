"""Lineage of a table of logical plans, in joins.

A plan is Catalyst's flat pre-order list of nodes with ``num-children``; nested trees are flattened
first. Parents and subtree sizes come from folds over the child counts, so a subtree is an interval of
positions. Expression ids lead from a column to those that it is computed from; a fixpoint of joins
follows them, a Union's to every branch, until the relations' own columns are reached.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import by_shuffled_size, counted, forget, materialize, ship
from tracewell.sources.plan_json import PROJECTS, RELATIONS, WRITES
from tracewell.sources.plan_shapes import each_shape

_EXPR = "struct<class:string,`num-children`:int,name:string,exprId:struct<id:long,jvmId:string>,qualifier:string,value:string>"
_TABLE = "struct<identifier:struct<database:string,table:string>>"
_NODE = f"array<struct<class:string,`num-children`:int,output:array<array<{_EXPR}>>,{','.join(f'{x}:array<array<{_EXPR}>>' for x in PROJECTS.values())},tableMeta:{_TABLE},catalogTable:{_TABLE},outputPath:string,path:string,options:struct<dbtable:string,path:string>,tableIdent:struct<multipartIdentifier:array<string>>,joinType:string>>"
#: What is read of a plan without its columns: of a relation's output only the qualifier.
_SLIM = re.sub(r",\w+:array<array<struct<class.*?>>>(?=,)", "", _NODE.replace(f"output:array<array<{_EXPR}>>", "output:array<array<struct<qualifier:string>>>").replace(_EXPR, "struct<class:string>"))
_names = lambda names: ", ".join(f"'{n}'" for n in sorted(names))
_PARENTS = "aggregate(kids, struct(array(-1) AS stack, cast(array() AS array<int>) AS out), (a, k) -> struct(concat(slice(a.stack, 1, greatest(size(a.stack) - 1, 0)), array_repeat(size(a.out), k)) AS stack, concat(a.out, array(try_element_at(a.stack, -1))) AS out), a -> a.out)"
_LAST = "slice(a.stack, greatest(size(a.stack) - {k} + 1, 1), {k})"
_SIZE = f"1 + aggregate({_LAST.format(k='k')}, 0, (s, x) -> s + x)"
_SIZES = f"reverse(aggregate(reverse(kids), struct(cast(array() AS array<int>) AS stack, cast(array() AS array<int>) AS out), (a, k) -> struct(concat(slice(a.stack, 1, greatest(size(a.stack) - k, 0)), array({_SIZE})) AS stack, concat(a.out, array({_SIZE})) AS out), a -> a.out))"


def _kind(column: str) -> str:
    """The last part of a class name, without a pattern, which would be compiled for every expression."""
    return f"substring_index({column}, '.', -1)"


#: The text of a flat expression, from its last node back; a node takes its children off the stack.
_TEXT = f"""try_element_at(aggregate(reverse({{items}}), cast(array() AS array<string>), (a, e) -> concat(
    slice(a, 1, greatest(size(a) - coalesce(e.`num-children`, 0), 0)),
    array(CASE WHEN {_kind('e.class')} = 'AttributeReference' THEN e.name WHEN {_kind('e.class')} = 'Literal' THEN coalesce(e.value, 'null')
          ELSE concat({_kind('e.class')}, '(', array_join(reverse(slice(a, greatest(size(a) - coalesce(e.`num-children`, 0) + 1, 1), coalesce(e.`num-children`, 0))), ', '), ')') END))), -1)"""


def tree(node: dict) -> list[dict]:
    """A nested tree's nodes in pre-order; expressions within a node likewise."""
    kids = [*(node.get("children") or []), *(node[k] for k in ("child", "query") if isinstance(node.get(k), dict))]
    own = {k: v for k, v in node.items() if k not in ("children", "child", "query", "type")} | {"class": node.get("class") or node.get("type"), "num-children": len(kids)}
    for k in ("output", *PROJECTS.values()):
        if isinstance(own.get(k), list):
            own[k] = [e if isinstance(e, list) else tree(e) for e in own[k] if isinstance(e, (dict, list))]
    return [own, *(n for c in kids if isinstance(c, dict) for n in tree(c))]


def flat(plans: pd.Series) -> pd.Series:
    """Plans in the nested form as flat lists; flat lists and what is no JSON stay."""

    def one(text: str | None) -> str | None:
        try:
            plan = json.loads(text or "")
        except ValueError:
            return text
        return json.dumps(tree(plan)) if isinstance(plan, dict) else text

    return plans.map(one)


def nodes(plans: DataFrame, plan_col: str = "plan", columns: bool = True) -> DataFrame:
    """(plan_id, i, kind, parent, last, ...): a row for each node; its subtree is the positions i to last. Without
    ``columns`` the nodes have no output and items, which are most of a plan.

    Null, empty and unreadable plans have no nodes. ``plan_id`` must be unique.
    """
    ship(plans.sparkSession)
    # Only nested plans travel to Python; a filter on what is parsed would parse each plan twice.
    nested = F.pandas_udf(flat, "string")(F.when(F.ltrim(plan_col).startswith("{"), F.col(plan_col)))
    parsed = plans.select("plan_id", F.from_json(F.coalesce(nested, F.col(plan_col)), _NODE if columns else _SLIM).alias("n")).withColumn("kids", F.expr("transform(n, x -> coalesce(x.`num-children`, 0))"))
    shaped = parsed.select("plan_id", "n", F.expr(_PARENTS).alias("parent"), F.expr(_SIZES).alias("size"))
    zipped = shaped.select("plan_id", F.posexplode(F.arrays_zip("n", "parent", "size")).alias("i", "x"))
    kind, ident = _kind("x.n.class"), "coalesce(x.n.tableMeta.identifier, x.n.catalogTable.identifier)"
    qualifier = "get(get(x.n.output, 0), 0).qualifier"
    parts = f"coalesce(from_json({qualifier}, 'array<string>'), array({qualifier}))"
    base = lambda path: f"element_at(split(rtrim('/', {path}), '/'), -1)"
    return zipped.select(
        "plan_id", "i", F.expr(kind).alias("kind"), F.col("x.parent").alias("parent"), F.expr("i + x.size - 1").alias("last"), *([F.col("x.n.output").alias("output")] if columns else []), F.col("x.n.joinType").alias("join_type"),
        *([F.coalesce(*(F.when(F.expr(kind) == k, F.col(f"x.n.{v}")) for k, v in PROJECTS.items())).alias("items")] if columns else []),
        # The table's identifier, or the first qualifier of its output. E11: path, options, identifier.
        F.expr(f"CASE WHEN {kind} IN ({_names(RELATIONS)}) THEN coalesce(nullif(concat_ws('.', {ident}.database, {ident}.table), ''), nullif(array_join(slice({parts}, greatest(size({parts}) - 1, 1), 2), '.'), ''), 'unknown') END").alias("relation"),
        F.expr(
            f"CASE WHEN {kind} IN ({_names(WRITES)}) THEN coalesce({base("nullif(coalesce(nullif(x.n.outputPath, ''), x.n.path), '')")}, nullif(x.n.options.dbtable, ''), {base("nullif(x.n.options.path, '')")}, "
            "nullif(array_join(slice(x.n.tableIdent.multipartIdentifier, greatest(size(x.n.tableIdent.multipartIdentifier) - 1, 1), 2), '.'), ''), 'unknown') END"
        ).alias("target"),
    )


def written(n: DataFrame) -> DataFrame:
    """The nodes below the topmost writes, with the write's position and target."""
    by = Window.partitionBy("plan_id").orderBy("i")
    before = F.max(F.when(F.col("target").isNotNull(), F.col("last"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    top = n.withColumn("top", F.col("target").isNotNull() & (F.coalesce(before, F.lit(-1)) < F.col("i")))
    held = F.last(F.when(F.col("top"), F.struct(F.col("i").alias("at"), F.col("last").alias("until"), F.col("target").alias("of"))), ignorenulls=True).over(by)
    return top.withColumn("w", held).where("w.at < i and i <= w.until").select(*(c for c in n.columns if c != "target"), F.col("w.at").alias("write"), F.col("w.of").alias("target"))


def _id(e: str) -> str:
    """What a column goes by: its expression id, or its name where the plan has no ids."""
    return f"coalesce(concat('#', {e}.exprId.id, coalesce(concat('@', {e}.exprId.jvmId), '')), concat('name ', {e}.name))"


def columns(below: DataFrame) -> DataFrame:
    """(plan_id, write, i, pos, kind, name, id, refs, expression, bare, relation): the columns that relations and
    projections make; refs are the ids of the columns in it, a relation's has none."""
    made = below.where("relation is not null or items is not null").select("plan_id", "write", "i", "last", "kind", "relation", F.posexplode(F.coalesce("items", "output")).alias("pos", "e"))
    inner = f"if({_kind('get(e, 0).class')} = 'Alias', slice(e, 2, size(e)), e)"
    attribute = f"{_kind('x.class')} = 'AttributeReference'"
    return made.where(f"{_kind('get(e, 0).class')} IN ('Alias', 'AttributeReference')").select(
        "plan_id", "write", "i", "last", "pos", "kind", "relation", F.expr("get(e, 0).name").alias("name"), F.expr(_id("get(e, 0)")).alias("id"),
        F.expr(f"if(relation is null, array_distinct(transform(filter({inner}, x -> {attribute}), x -> {_id('x')})), array())").alias("refs"),
        F.expr(f"transform(filter({inner}, x -> {attribute}), x -> x.name)").alias("ref_names"),
        F.expr(f"if(size({inner}) = 1 and {_kind(f'get({inner}, 0).class')} = 'AttributeReference', null, {_TEXT.format(items=inner)})").alias("expression"),
    )


def frontier(below: DataFrame) -> DataFrame:
    """(plan_id, write, i, top, union_at, start): the relations and projections that make the output of each write (top -1) or branch of a Union
    (top is the branch's position): those without another between. A semi or anti join has its left side only."""
    n = below.select("plan_id", "i", "last", "parent", "kind", "relation", "projects", "join_type", "write")
    tops = n.alias("c").join(n.alias("u"), F.expr("c.plan_id = u.plan_id and c.parent = u.i and u.kind = 'Union'")).select("c.plan_id", "c.i", "c.last", F.col("c.i").alias("top"), F.col("c.parent").alias("union_at"))
    writes = n.groupBy("plan_id", F.col("write").alias("i")).agg(F.max("last").alias("last")).select("plan_id", "i", "last", F.lit(-1).alias("top"), F.lit(None).cast("int").alias("union_at"))
    # What hides the nodes below it: a projection, a relation, a further Union's later branches, the right side of a semi or anti join.
    made = n.where("relation is not null or (projects and kind <> 'Window')").select("plan_id", F.col("i").alias("h"), (F.col("i") + 1).alias("low"), F.col("last").alias("high"))
    sides = n.alias("c").join(n.alias("j"), F.expr("c.plan_id = j.plan_id and c.parent = j.i and c.i > j.i + 1 and (j.kind = 'Union' or j.join_type rlike 'Semi|Anti')"))
    hidden = made.unionAll(sides.select("c.plan_id", F.col("c.i").alias("h"), F.col("c.i").alias("low"), F.col("c.last").alias("high")))
    found = n.where("relation is not null or projects").alias("f").join(tops.unionAll(writes).alias("t"), F.expr("f.plan_id = t.plan_id and t.i <= f.i and f.i <= t.last"))
    found = found.select("f.plan_id", "f.i", "f.write", "t.top", "t.union_at", F.col("t.i").alias("start"))
    return found.alias("f").join(hidden.alias("h"), F.expr("f.plan_id = h.plan_id and h.low <= f.i and f.i <= h.high and (h.h > f.start or (h.h = f.start and h.low > h.h))"), "left_anti")


def derivations(plans: DataFrame, plan_col: str = "plan", semantics: str = "documented") -> DataFrame:
    """(plan_id, write, target, position, column, source_dataset, source_column, expression, is_passthrough): what
    each column that a topmost write stores is computed from.

    documented follows expression ids to the relation that owns the column, through joins and all branches
    of a Union, windows included; columns that a relation hands on unprojected give no row.
    as_implemented takes every projection below the write, its first referenced name and the write's first relation.
    Plans without a write, null and unreadable ones give no rows.
    """
    with by_shuffled_size(plans.sparkSession):
        return each_shape(plans, plan_col, lambda some: _derivations(some, plan_col, semantics))


def _derivations(plans: DataFrame, plan_col: str, semantics: str) -> DataFrame:
    # What only asks whether a node has items reads a flag, not the items.
    below = materialize(written(nodes(plans, plan_col)).withColumn("projects", F.col("items").isNotNull()), "plan-nodes")
    made = materialize(columns(below), "plan-columns")
    target = below.groupBy("plan_id", "write").agg(F.first("target").alias("target"), F.min_by("relation", F.when(F.col("relation").isNotNull(), F.col("i"))).alias("first_source"))
    if semantics == "as_implemented":
        every = made.where("relation is null and kind <> 'Window' and size(ref_names) > 0").join(target, ["plan_id", "write"])
        out = every.select(
            "plan_id", "write", "target", F.row_number().over(Window.partitionBy("plan_id", "write").orderBy(F.desc("i"), "pos")).alias("position"), F.col("name").alias("column"),
            F.coalesce("first_source", F.lit("unknown")).alias("source_dataset"), F.expr("get(ref_names, 0)").alias("source_column"), "expression", F.expr("expression is null and get(ref_names, 0) = name").alias("is_passthrough"),
        )
        out = materialize(out, "plan-derivations")
        forget(below, made)
        return out
    front = materialize(frontier(below).join(made, ["plan_id", "write", "i"]), "plan-frontier")
    # A Union's columns have the ids of its first branch, which mean that branch's columns within it: above it, and in
    # what it hands on, they go by the Union's place as well.
    branch = front.where("top >= 0").withColumn("place", F.row_number().over(Window.partitionBy("plan_id", "top").orderBy("i", "pos"))).withColumn("least", F.min("top").over(Window.partitionBy("plan_id", "union_at")))
    first = branch.where("top = least").select("plan_id", F.col("union_at").alias("u"), "place", F.col("id").alias("out"))
    of_union = lambda u, i: F.concat(F.lit("union "), u, F.lit(" "), i)
    unions = below.where("kind = 'Union'").select(F.col("plan_id").alias("p"), F.col("i").alias("u"), F.col("last").alias("u_last"))

    def named(rows: DataFrame) -> DataFrame:
        """Frontier rows with the node that they stand for: the outermost Union's column around them, or their own."""
        around = rows.join(unions, F.expr("p = plan_id and start <= u and u < i and i <= u_last"), "left")
        key = ["plan_id", "write", "top", "i", "pos"]
        u = around.groupBy(*key).agg(F.min("u").alias("u"))
        return rows.join(u, key).withColumn("node", F.coalesce(of_union(F.col("u"), F.col("id")), F.col("id")))

    refs = made.select("plan_id", "i", "last", "id", F.explode("refs").alias("ref"))
    scoped = refs.join(first.withColumnRenamed("plan_id", "p"), F.expr("p = plan_id and out = ref and i < u and u <= last"), "left").groupBy("plan_id", "i", "id", "ref").agg(F.min("u").alias("u"))
    scoped = scoped.select("plan_id", "id", F.coalesce(of_union(F.col("u"), F.col("ref")), F.col("ref")).alias("ref"))
    across = named(branch).select("plan_id", F.col("union_at").alias("u"), "place", "node").join(first, ["plan_id", "u", "place"]).select("plan_id", of_union(F.col("u"), F.col("out")).alias("id"), F.col("node").alias("ref"))
    step = materialize(scoped.unionAll(across).where("id <> ref").distinct(), "plan-steps")
    base = materialize(made.where("relation is not null").select("plan_id", "id", F.col("relation").alias("source_dataset"), F.col("name").alias("source_column")).distinct(), "plan-bases")

    # The columns behind each output: one join a level, until a level adds none.
    own = named(front.where("top = -1 and relation is null")).withColumn("position", F.row_number().over(Window.partitionBy("plan_id", "write").orderBy("i", "pos")))
    own = materialize(own.select("plan_id", "write", "position", "node", "name", "expression", F.expr("size(refs)").alias("many"), F.expr("get(ref_names, 0)").alias("ref_name")), "plan-outputs")
    seen = new = own.select("plan_id", "write", "position", F.col("node").alias("ref"))
    levels = []
    while True:
        found = new.join(step.withColumnsRenamed({"id": "via", "ref": "to", "plan_id": "p"}), F.expr("p = plan_id and via = ref")).select("plan_id", "write", "position", F.col("to").alias("ref")).distinct()
        new, n = counted(found.join(seen, ["plan_id", "write", "position", "ref"], "left_anti"), "plan-reach")
        levels.append(new)
        if not n:
            break
        seen = seen.unionAll(new)
    sources = seen.join(base.withColumnRenamed("id", "ref"), ["plan_id", "ref"]).select("plan_id", "write", "position", "source_dataset", "source_column").distinct()
    # A column that some column behind it computes is computed too; its text is the first in the plan by its own id.
    texts = made.where("expression is not null").groupBy("plan_id", F.col("id").alias("ref")).agg(F.min_by("expression", F.struct("i", "pos")).alias("text"))
    computed = seen.join(texts, ["plan_id", "ref"]).select("plan_id", "write", "position").distinct().withColumn("computed", F.lit(True))
    out = own.join(sources, ["plan_id", "write", "position"]).join(target, ["plan_id", "write"]).join(computed, ["plan_id", "write", "position"], "left").join(texts.withColumnRenamed("ref", "node"), ["plan_id", "node"], "left")
    out = materialize(
        out.select("plan_id", "write", "target", "position", F.col("name").alias("column"), "source_dataset", "source_column", F.coalesce("expression", "text").alias("expression"), F.expr("expression is null and computed is null and many = 1 and ref_name = name").alias("is_passthrough")),
        "plan-derivations",
    )
    forget(below, made, front, step, base, own, *levels)
    return out


def events(plans: DataFrame, plan_col: str = "plan", job_col: str = "job_id", semantics: str = "documented") -> DataFrame:
    """(plan_id, transform_id, target_dataset, source_datasets): a row for each topmost write, its relations in
    order of their names without repeats; ``transform_id`` is job_target."""
    below = written(nodes(plans, plan_col, columns=False))
    each = below.groupBy("plan_id", "write").agg(F.first("target").alias("target_dataset"), F.array_sort(F.collect_set("relation")).alias("source_datasets"))
    return each.join(plans.select("plan_id", F.col(job_col).alias("job")), "plan_id").select("plan_id", F.concat_ws("_", "job", "target_dataset").alias("transform_id"), "target_dataset", "source_datasets")
