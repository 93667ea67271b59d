"""Plans of one shape: one of them is read, and what was read is written out for the others.

Runs of the same job log plans that differ in numbers alone: of expressions, tables, paths. Two plans have one
shape if their texts are the same but for numbers of 3 to 18 digits and the same of these numbers are equal in
both. Reading a plan compares names and ids, and knows classes without such numbers, so it finds the same rows
in both with the numbers exchanged. Where such numbers are more than names, which a shape shows, its plans are
all read: counts of children, fractions outside of strings, escaped characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.runtime import counted, forget, materialize

#: A text in turn what stays, other numbers in it, and the numbers that may differ. Those that begin with 0 would be
#: no number for JSON.
_RUNS = "(?:[^0-9]++|0[0-9]*+|[1-9][0-9]?+(?![0-9])|[1-9][0-9]{18,}+)++|[1-9][0-9]{2,17}+"
#: Only a text that is no plan begins with another number.
_FREE = "x >= '1' AND x < ':'"
#: A shape's text has the least such runs in their stead, 100 for the first, so that no other run is mistaken for one.
_MARKS = "map_from_arrays(numbers, transform(numbers, (x, i) -> cast(100 + i AS string)))"
#: The marks are read in two places, so that they are not made anew for each run.
_SHAPE = "array_join(if(size(marks) = 0, runs, transform(runs, x -> if(x < '1', x, coalesce(try_element_at(marks, x), x)))), '')"
#: What makes numbers more than names.
_READ = r"""\\u|"num-children"\s*:\s*[1-9][0-9]{2}|[:,\[]\s*-?[0-9]+[.eE]"""

#: A plan of more numbers has a shape of its own, for each run is looked up among them.
_MOST = 1000
#: Shapes that are sent to all tasks: so many plans' ids, so many bytes of what they derive.
_IDS, _BYTES = 100_000, 16_000_000
#: Plans that a task reads: some kilobytes and twenty nodes each.
_A_TASK = 500


def shapes(plans: DataFrame, plan_col: str = "plan") -> DataFrame:
    """(plan_id, shape, numbers): numbers are the distinct ones that may differ, in order. A plan without a text has no shape."""
    # Null texts stay: a filter on a text that is made would make it twice.
    cut = plans.where(F.col("plan_id").isNotNull()).select("plan_id", F.regexp_extract_all(plan_col, F.lit(_RUNS), F.lit(0)).alias("runs"))
    cut = cut.withColumn("numbers", F.expr(f"array_distinct(filter(runs, x -> {_FREE}))"))
    cut = cut.withColumn("marks", F.expr(f"if(size(numbers) > {_MOST}, map(), {_MARKS})"))
    return cut.select("plan_id", F.sha2(F.expr(_SHAPE), 256).alias("shape"), "numbers")


def _parts(column: str) -> Column:
    """A text's runs, each with its place among the numbers, 0 if it is none of them."""
    return F.expr(f"transform(regexp_extract_all({column}, '{_RUNS}', 0), x -> struct(x AS text, cast(array_position(numbers, x) AS int) AS place))").alias(column)


def _filled(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> if(x.place > 0, get(numbers, x.place - 1), x.text)), '')").alias(column)


def _of(plans: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The plans of n ids, written to files that grow with them."""
    ids = ids.select("plan_id")
    return materialize(plans.join(F.broadcast(ids) if n <= _IDS else ids, "plan_id", "left_semi").repartition(n // _A_TASK + 1, "plan_id"), "plan-texts")


def each_shape(plans: DataFrame, plan_col: str, read) -> DataFrame:
    """``read`` (plans with plan_id and the text, to rows with plan_id and texts) of all plans, from one plan of
    each shape. Where most plans have a shape of their own all are read."""
    plans, seen = plans.select("plan_id", plan_col), Observation()
    every = materialize(shapes(plans, plan_col).observe(seen, F.count(F.lit(1)).alias("n")), "plan-shapes")
    one, n = counted(every.groupBy("shape").agg(F.min("plan_id").alias("plan_id")), "plan-firsts")
    if 2 * n > seen.get["n"]:
        forget(every, one)
        return read(plans)
    first = _of(plans, one, n)
    unlike, some = counted(first.where(F.col(plan_col).rlike(_READ)).select("plan_id").join(one, "plan_id"), "plan-unlike")
    rows = read(first.join(unlike.select("plan_id"), "plan_id", "left_anti") if some else first)
    texts = [c for c, kind in rows.dtypes if kind == "string" and c != "plan_id"]
    numbers = every.join(F.broadcast(one) if n <= _IDS else one, ["shape", "plan_id"])
    made = rows.join(numbers, "plan_id").select("shape", *(_parts(c) if c in texts else c for c in rows.columns if c != "plan_id"))
    size, of = Observation(), lambda c: F.expr(f"coalesce(aggregate({c}, 0L, (a, x) -> a + 64 + length(x.text)), 0L)")
    made = materialize(made.observe(size, F.sum(sum((of(c) for c in texts), F.lit(200))).alias("bytes")), "plan-shape-rows")
    held = (size.get["bytes"] or 0) <= _BYTES
    out = every.join(F.broadcast(made) if held else made, "shape").select(*(_filled(c) if c in texts else c for c in rows.columns))
    forget(first, rows)
    if some:
        ids, m = counted(every.join(unlike.select("shape"), "shape", "left_semi").select("plan_id"), "plan-unlike-ids")
        out = out.unionAll(read(_of(plans, ids, m)))
    return out
