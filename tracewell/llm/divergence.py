"""How far the sources of a language differ in their words (operator 11).

A group is a (lang, source). Its share of a term depends on the term's count in the group alone, so
the divergence of two groups over all kept terms is priced by inclusion and exclusion over their
supports: a histogram of a group's counts prices its terms as if the other group had none of them,
the other's histogram likewise, one constant prices what neither has, and a join of the postings
corrects the terms that both have. Nothing ever holds a row for a term that a group lacks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows, materialize

#: Distinct (group, term) entries that a task holds before it hands them on.
HELD = 200_000
#: Bytes of a text that are split into words at once.
SLICE = 4 << 20
#: Case is folded for A-Z only; every other ASCII character ends a term.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def slices(folded: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words between the spaces, in lists from stretches of about ``size`` bytes that end at a space."""
    at = 0
    while at < len(folded):
        end = at + size
        if end < len(folded):
            cut = folded.rfind(b" ", at, end)
            cut = folded.find(b" ", end) if cut < 0 else cut
            end = len(folded) if cut < 0 else cut
        yield folded[at:end].split()
        at = end + 1


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pd.DataFrame:
        rows = [(*g, t.decode("utf-8", "replace"), n, docs[t]) for g, (all_, docs) in held.items() for t, n in all_.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    for pdf in batches:
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
            all_, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for words in slices(text.encode("utf-8", "surrogatepass").translate(FOLD)):
                all_.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(a) for a, _ in held.values()) > HELD:
            yield out()
    yield out()


def postings(rows: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in ``min_docs`` documents of their language or
    more; ``first`` is 1 in one row of each (lang, term). One shuffle, by language and term."""
    counted = rows.mapInPandas(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (
        each.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("df"), (F.min("source").over(term) == F.col("source")).cast("int").alias("first"))
        .where(F.col("df") >= min_docs).drop("df")
    )


def share(n: str, total: str, terms: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + terms)), exact for any counts: the product is a decimal."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20,0)) * cast({scale} as decimal(12,0))) div cast({total} + {terms} as decimal(20,0))")


def gap(p: str, q: str) -> str:
    """The price of one term: the squared difference by the second share, rounded down."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): a group against each other source of its language (part
    ``pair``, every rank) and its ``top`` terms against the language as a whole (part ``term``).

    Null text, lang and source are read as ''. Repeated rows are documents of their own. A group without
    kept terms has its pairs; in a language without kept terms they are 0. Equal values rank by the
    item's bytes. Whole texts are counted, however long; other columns are not read. No rows: no rows.
    """
    arrow_rows(docs.sparkSession, 2000)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), part(text_col).alias("text"))
    kept = materialize(postings(rows, min_docs), "divergence-postings")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "support", "terms"])
    groups = materialize(groups.withColumn("zero", F.when(F.col("terms") > 0, share("0", "total", "terms", scale))), "divergence-groups")

    # Every kept posting with its group's share of the term and of a term that it lacks.
    priced = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms", scale))
    priced = materialize(priced.select("lang", "source", "term", "p", "zero", share("lang_n", "lang_total", "terms", scale).alias("q")), "divergence-shares")

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("far"), F.col("support").alias("far_support"))
    both = groups.join(other, "lang").where("source <> item")
    neither = both.select("lang", "source", "item", F.expr(f"if(terms = 0, 0, (terms - support - far_support) * {gap('zero', 'far')})").alias("value"))
    heights = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("h"))
    sided = (
        heights.join(other, "lang").where("source <> item").groupBy("lang", "source", "item")
        .agg(F.expr(f"sum(h * {gap('p', 'far')})").alias("as_first"), F.expr(f"sum(h * {gap('far', 'p')})").alias("as_second"))
    )
    a = priced.select("lang", "term", "source", F.col("p").alias("ap"), F.col("zero").alias("az"))
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("bp"), F.col("zero").alias("bz"))
    fix = lambda p, pz, q, qz: f"sum({gap(p, q)} - {gap(p, qz)} - {gap(pz, q)} + {gap(pz, qz)})"
    shared = (
        a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item")
        .agg(F.expr(fix("ap", "az", "bp", "bz")).alias("as_first"), F.expr(fix("bp", "bz", "ap", "az")).alias("as_second"))
    )
    for t in (sided, shared):
        ways = F.explode(F.array(F.struct("source", "item", F.col("as_first").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("as_second").alias("value"))))
        neither = neither.unionAll(t.select("lang", ways.alias("w")).select("lang", "w.*"))
    pairs = neither.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    ranked = lambda t, part: t.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    return ranked(pairs, "pair").unionAll(ranked(terms, "term").where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL that prices every group's every kept term one by one."""
    return r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= 3),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms, coalesce(lang_total, 0) AS lang_total
          FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)
          LEFT JOIN (SELECT lang, count(*) AS terms FROM kept GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, sum(n) AS lang_total FROM c GROUP BY lang) USING (lang)),
    grid AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + terms)::HUGEINT AS p FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // any_value(lang_total + terms)::HUGEINT AS q FROM c JOIN (SELECT DISTINCT lang, terms, lang_total FROM g) USING (lang) GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM grid a JOIN grid b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
    every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
    terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM grid JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
               UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 200)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
    """
