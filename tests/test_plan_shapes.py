"""Plans of one shape are read once: the same rows as when every plan is read, on odd texts too."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.plans import plan_queries
from tracewell.sources import plan_shapes, plan_tables

REL, ATTR = "x.LogicalRelation", "x.AttributeReference"


def attr(name, id_):
    return {"class": ATTR, "num-children": 0, "name": name, "exprId": {"id": id_, "jvmId": "j"}, "qualifier": []}


def plan(table, ids, text, value="1", path="/lake/out", wide=0, indent=None):
    """A write of a projection: a column passed on, and a computed one with a literal."""
    inner = [{"class": "x.Alias", "num-children": 1, "name": text, "exprId": {"id": ids[1], "jvmId": "j"}}, {"class": "x.Add", "num-children": 2}, attr("net", ids[0]), {"class": "x.Literal", "num-children": 0, "value": value}]
    nodes = [
        {"class": "x.AppendData", "num-children": 1, "path": path},
        {"class": "x.Project", "num-children": 1, "projectList": [[attr("net", ids[2])], inner]},
        *([{"class": "x.Union", "num-children": wide}] if wide else []),
        *[{"class": REL, "num-children": 0, "output": [[attr("net", ids[0])]], "catalogTable": {"identifier": {"database": "d", "table": table}}}] * (wide or 1),
    ]
    return json.dumps(nodes, indent=indent)


#: Pairs whose texts differ in numbers alone, or in what looks so.
TEXTS = [
    *(plan(f"t{n}", (n, n + 1000, n), f"c{n}", path=f"/lake/{n}/out{n}/") for n in range(400, 440)),
    plan("t500", (500, 1500, 501), "c500"), plan("t501", (501, 1501, 501), "c500"),  # another id passed on: no row for it
    plan("t600", (600, 1600, 600), "c1"), plan("t601", (601, 1601, 601), "c601"),  # the name is the table's number or isn't
    plan("t602", (602, 1602, 602), "c100"), plan("t603", (603, 1603, 603), "c603"),
    *(plan("t", (7, 8, 7), "c", value=v) for v in (1.500, 2.250, 123.456, 123.4560, 1e300, 10e200, 700, 701, "1.500", "1.250")),
    plan("t", (7, 8, 7), "c", value=1).replace('"value": 1', '"value": 1.500'), plan("t", (7, 8, 7), "c", value=1).replace('"value": 1', '"value": 1.2500'),
    plan("t", (7, 8, 7), "x").replace('"x"', r'"ሴ"'), plan("t", (7, 8, 7), "x").replace('"x"', r'"ስ"'),
    plan("t", (7, 8, 7), "x").replace('"x"', r'"a\"700"'), plan("t", (7, 8, 7), "x").replace('"x"', r'"a\"701"'),
    plan("t", (100, 101, 100), "c", wide=120), plan("t", (100, 101, 100), "c", wide=130, indent=1), plan("t", (100, 101, 100), "c", wide=130),
    plan("t", (700, 800, 700), "c").replace('"id": 700', '"id": 0700'), plan("t", (700, 800, 700), "c").replace('"id": 700', '"id": 1700'),
    plan("t", (7, 8, 7), "c").replace("LogicalRelation", "DataSourceV2Relation"), plan("t", (7, 8, 7), "c").replace("LogicalRelation", "DataSourceV123Relation"), plan("t", (7, 8, 7), "c").replace("LogicalRelation", "DataSourceV345Relation"),
    plan("t" + "9" * 25, (7, 8, 7), "c"), plan("t" + "8" * 25, (7, 8, 7), "c"),
    *(json.dumps({"class": "x.AppendData", "path": f"/o{n}", "children": [{"class": "x.Project", "projectList": [{"class": ATTR, "name": f"a{n}"}], "child": {"class": REL, "output": [{"class": ATTR, "name": f"a{n}", "qualifier": ["q", f"t{n}"]}]}}]}) for n in (300, 301, 302)),
    None, "", "  ", "123", "124", "[1000]", "{", "[{" , "{}", "[]", None,
]


@pytest.mark.parametrize("semantics", ["documented", "as_implemented"])
def test_same_rows_as_when_all_are_read(spark, semantics, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "plan_id long, plan string").repartition(3)
    read, asked = plan_tables._derivations, []
    monkeypatch.setattr(plan_tables, "_derivations", lambda some, *a: asked.append(some.count()) or read(some, *a))
    got = plan_tables.derivations(df, semantics=semantics)
    assert asked and sum(asked) < len(TEXTS) - 30  # the forty of one shape are read once
    want = read(df, "plan", semantics)
    assert want.where("expression is not null").select("expression").distinct().count() > 5
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_shapes_tell_which_numbers_are_equal(spark):
    texts = ["a123 b456 c123", "a777 b888 c777", "a777 b888 c888", "a123 b456 c12", "a123 b456 c012", "a100 b101 c100", "a1234 b45678 c1234", "a123 b123 c123"]
    shape = {r["plan_id"]: (r["shape"], r["numbers"]) for r in plan_shapes.shapes(spark.createDataFrame([*enumerate(texts), (99, None)], "plan_id long, plan string")).collect()}
    same = lambda a, b: shape[a][0] == shape[b][0]
    assert same(0, 1) and same(0, 5) and same(0, 6) and shape[99][0] is None
    assert not any(same(0, k) for k in (2, 3, 4, 7)) and not same(3, 4)
    assert shape[1][1] == ["777", "888"]


def test_a_plan_of_very_many_numbers_has_its_own_shape(spark, monkeypatch):
    monkeypatch.setattr(plan_shapes, "_MOST", 2)
    df = spark.createDataFrame([(1, "111 222 333"), (2, "111 222 444"), (3, "100 101"), (4, "555 666")], "plan_id long, plan string")
    shape = {r["plan_id"]: r["shape"] for r in plan_shapes.shapes(df).collect()}
    assert len({shape[k] for k in (1, 2, 3)}) == 3 and shape[3] == shape[4]


def test_the_loop_over_runs_makes_nothing_anew(spark):
    text = plan_shapes.shapes(spark.createDataFrame([(1, "a")], "plan_id long, plan string"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == text.count("map_from_arrays") == text.count("array_distinct") == 1
    assert text.index("transform(runs") < text.index("map_from_arrays") and "sha2" in text.split("\n")[0] and "map_from_arrays" not in text.split("\n")[0]


@pytest.mark.parametrize("ids, held", [(100_000, 16_000_000), (0, 0)])
def test_few_of_many_plans_are_read(spark, sf, monkeypatch, ids, held):
    monkeypatch.setattr(plan_shapes, "_IDS", ids)
    monkeypatch.setattr(plan_shapes, "_BYTES", held)
    plans = plan_queries.plans(spark, sf.replace("0.001", "0.01"))
    read, asked = plan_tables._derivations, []
    monkeypatch.setattr(plan_tables, "_derivations", lambda some, *a: asked.append(some.count()) or read(some, *a))
    got = plan_tables.derivations(plans).drop("write", "position")
    n = plans.count()
    assert sum(asked) < n / 5
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf.replace('0.001', '0.01')}/orders.parquet'")
    want = con.execute(plan_queries.TABLE["e06_plan_lineage"][1]).fetchall()
    assert got.agg(F.count(F.lit(1))).first()[0] == len(want) and sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))
