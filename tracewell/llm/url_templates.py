"""URL filters by path templates (operator 4). DataFrame operations only.

Each host has a tree of path segments. Runs of digits make a segment variable by its form, and
segments that few of their siblings' pages have are variable by their number; variable segments
become wildcards. Of the others, a branch keeps its name only if its share of blocked pages differs
from all its siblings' share by more than chance allows; branches that are alike are merged into the
wildcard too. The pages that rules judge are the labels: a template's share of allowed ones, smoothed
towards its host's, and that towards the share of all, decides for the pages that no rule judges.

The tree is built on counts of (host, path form), so its tables are as large as the number of forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialize

#: Fixed values of the contract: host, path and verdict of each rule.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LEVELS, SUPPORT, SHARE, CHANCE, SMOOTH, PURE = 6, 20, 0.02, 3.0, 5.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _by_length(rules):
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))


def rule_of(rules, pick) -> Column:
    """What ``pick`` takes from the longest rule that fits the columns host and path."""
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in _by_length(rules)]
    chain = reduce(lambda c, x: c.when(x[0], F.lit(pick(x[1]))), zip(fits, _by_length(rules), strict=True), F.when(F.lit(False), F.lit(None).cast("string")))
    return chain.otherwise(F.lit(None).cast("string"))


def templates(forms: DataFrame, levels: int = LEVELS, support: int = SUPPORT, share: float = SHARE, chance: float = CHANCE) -> DataFrame:
    """(host, form, template, good, bad) of the counted forms (host, form, n, good, bad)."""
    now = forms.withColumn("segs", F.expr("filter(split(form, '/'), x -> x <> '')")).withColumn("template", F.lit(""))
    for d in range(levels):
        now = now.withColumn("seg", F.get("segs", F.lit(d)))
        nodes = materialize(now.where("seg is not null").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad"))), "url-nodes")
        tops = nodes.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        part = F.expr("cast(all_bad as double) / (all_good + all_bad)")
        mean = (F.col("good") + F.col("bad")) * part
        named = (
            nodes.join(tops, ["host", "template"])
            .where((F.col("n") >= support) & (F.col("n") >= share * F.col("all_n")) & ~F.col("seg").contains("#"))
            .where((F.col("good") + F.col("bad") > 0) & (F.col("all_good") + F.col("all_bad") > 0))
            .where((F.col("bad") - mean) * (F.col("bad") - mean) > chance * chance * mean * (1 - part))
            .select("host", "template", "seg", F.lit(True).alias("named"))
        )
        step = F.when(F.col("seg").isNull(), F.lit("")).when(F.col("named"), F.concat(F.lit("/"), "seg")).otherwise(F.lit("/*"))
        now = now.join(named, ["host", "template", "seg"], "left").withColumn("template", F.concat("template", step)).drop("named", "seg")
        now = materialize(now, "url-templates")
    rest = F.when(F.size("segs") > levels, F.lit("/**")).otherwise(F.lit(""))
    return now.select("host", "form", F.concat("template", rest).alias("template"), "good", "bad")


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, smooth: float = SMOOTH, pure: float = PURE) -> DataFrame:
    """The pages' columns with host, path, rule, template and verdict.

    A null url or one without ``://`` has an empty host and path and is judged with all others of
    that kind. Rules fit the host and its subdomains if the path starts with theirs; the longest
    wins. Columns of ``pages`` that clash with these names give way to them. Repeated rows stay,
    and each counts. Without any label every share is one half, which allows.
    """
    new = ["host", "path", "rule", "template", "purity", "verdict", "form"]
    url = F.col(url_col).cast("string")
    base = pages.select(*[c for c in pages.columns if c not in new], host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("rule", rule_of(rules, lambda r: r[0] + r[1])).withColumn("said", rule_of(rules, lambda r: r[2])).withColumn("form", F.regexp_replace("path", "[0-9]+", "#"))
    yes, no = (F.count_if(F.coalesce(F.col("said") == v, F.lit(False))).alias(k) for v, k in (("allow", "good"), ("block", "bad")))
    forms = materialize(base.groupBy("host", "form").agg(F.count(F.lit(1)).alias("n"), yes, no), "url-forms")
    own = templates(forms)
    leaf = own.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = forms.groupBy("host").agg(F.sum("good").alias("host_good"), (F.sum("good") + F.sum("bad")).alias("host_all"))
    total = forms.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("good") + F.sum("bad"), F.lit(0)) + 2.0)).alias("all_pure"))
    of_host = hosts.join(F.broadcast(total)).select("host", ((F.col("host_good") + smooth * F.col("all_pure")) / (F.col("host_all") + smooth)).alias("host_pure"))
    pure_of = leaf.join(of_host, "host").select("host", "template", ((F.col("good") + smooth * F.col("host_pure")) / (F.col("good") + F.col("bad") + smooth)).alias("purity"))
    known = materialize(own.select("host", "form", "template").join(pure_of, ["host", "template"]), "url-purity")
    out = base.join(known, ["host", "form"])
    verdict = F.coalesce("said", F.when(F.col("purity") >= pure, F.lit("allow")).otherwise(F.lit("block")))
    return out.withColumn("verdict", verdict).drop("said", "form")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "template", "verdict")


def oracle() -> str:
    fit = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(h, p, v)}'" for h, p, v in _by_length(RULES)) + " END"
    sql = [
        f"""a AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_PARTS}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages)""",
        f"b AS (SELECT *, {fit(lambda h, p, v: h + p)} AS rule, {fit(lambda h, p, v: v)} AS said, regexp_replace(path, '[0-9]+', '#', 'g') AS form FROM a)",
        "forms AS (SELECT host, form, count(*) AS n, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM b GROUP BY ALL)",
        "t0 AS (SELECT host, form, n, good, bad, list_filter(string_split(form, '/'), lambda x: x <> '') AS segs, '' AS template FROM forms)",
    ]
    for d in range(LEVELS):
        sql += [
            f"s{d} AS (SELECT *, segs[{d + 1}] AS seg FROM t{d})",
            f"n{d} AS (SELECT host, template, seg, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM s{d} WHERE seg IS NOT NULL GROUP BY ALL)",
            f"p{d} AS (SELECT host, template, sum(n) AS all_n, sum(good) AS all_good, sum(bad) AS all_bad FROM n{d} GROUP BY ALL)",
            f"m{d} AS (SELECT *, all_bad::DOUBLE / (all_good + all_bad) AS part FROM n{d} JOIN p{d} USING (host, template) WHERE good + bad > 0 AND n >= {SUPPORT} AND n >= {SHARE}::DOUBLE * all_n AND NOT contains(seg, '#'))",
            f"""k{d} AS (SELECT host, template, seg FROM m{d} WHERE (bad - (good + bad) * part) * (bad - (good + bad) * part)
            > {CHANCE * CHANCE}::DOUBLE * ((good + bad) * part) * (1 - part))""",
            f"""t{d + 1} AS (SELECT s.host, form, n, good, bad, segs, s.template || CASE WHEN s.seg IS NULL THEN '' WHEN k.seg IS NOT NULL THEN '/' || s.seg ELSE '/*' END AS template
            FROM s{d} s LEFT JOIN k{d} k ON s.host = k.host AND s.template = k.template AND s.seg = k.seg)""",
        ]
    sql += [
        f"own AS (SELECT host, form, template || CASE WHEN len(segs) > {LEVELS} THEN '/**' ELSE '' END AS template, good, bad FROM t{LEVELS})",
        "leaf AS (SELECT host, template, sum(good) AS good, sum(bad) AS bad FROM own GROUP BY ALL)",
        "whole AS (SELECT (coalesce(sum(good), 0) + 1)::DOUBLE / (coalesce(sum(good) + sum(bad), 0) + 2) AS p FROM forms)",
        f"hosts AS (SELECT host, (sum(good) + {SMOOTH}::DOUBLE * p) / (sum(good) + sum(bad) + {SMOOTH}::DOUBLE) AS hp FROM forms, whole GROUP BY host, p)",
        f"pure AS (SELECT host, template, (good + {SMOOTH}::DOUBLE * hp) / (good + bad + {SMOOTH}::DOUBLE) AS purity FROM leaf JOIN hosts USING (host))",
    ]
    return "WITH " + ",\n".join(sql) + f"\nSELECT page_id, b.host, path, rule, template, coalesce(said, CASE WHEN purity >= {PURE} THEN 'allow' ELSE 'block' END) AS verdict FROM b JOIN own USING (host, form) JOIN pure USING (host, template)"
