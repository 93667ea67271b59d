"""The report counts what is affected, not what is listed."""

from tracewell.operators import impact as I
from tracewell.plans.bridge import graph


def test_report_counts_beyond_the_listed(spark, monkeypatch):
    nodes, edges = graph(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(I, "longest_trail", lambda *a, **k: None)
    change = I.SchemaChange("p:5", "k:5", "drop_column")
    reach = I.affected(nodes, edges, I.starts_of(nodes, change))
    everything = I.ranked(nodes, reach, change, kept=None).count()
    got = I.blast_radius(nodes, edges, change)
    listed = got["assets"].count()
    assert listed == I.KEPT < everything == got["report"]["total"]
    assert f" affects {everything} downstream assets." in got["report"]["summary"]
