"""Column lineage of a table of SQL texts, in windows and joins.

Texts become a table of tokens. Running sums over them give the statement, the depth, the query that a
token stands in, its branch of a set operation, clause, select item and relation; windows over the
tokens before and after it tell what a name is. Relations, common tables, items and column references
are then tables of their own: names are resolved by equi-joins on statement and alias, the nearest
enclosing query first; stars are expanded by a fixpoint of joins with what a query puts out; and a
second fixpoint follows the columns through queries until the base tables are reached.

It reads the common core of the dialects: WITH [RECURSIVE], set operations, nested and lateral queries,
LATERAL VIEW, table functions, QUALIFY, TOP, ``::``, three quoting styles. Set operands in brackets of
their own within brackets, PIVOT and names that lambdas bind aren't told apart.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import by_shuffled_size, counted, forget, materialize

_TOKEN = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*(?s:.*?)\*/|[\p{L}_][\p{L}\p{N}_$]*|\d+(?:\.\d+)?|::|<=>|<>|<=|>=|!=|\|\||->>|->|=>|\S"""
_SETS = {"UNION", "EXCEPT", "INTERSECT", "MINUS"}
_CLAUSES = ["WITH", "SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "WINDOW", "QUALIFY", "INSERT", "CREATE", "VALUES", "CLUSTER", "DISTRIBUTE", "SORT", "OFFSET", "FETCH"]
#: Words that are no names unless they are quoted.
_WORDS = {*_SETS, *_CLAUSES} | set(
    "ALL AND ANY AS ASC BETWEEN BY CASE CROSS CURRENT CURRENT_DATE CURRENT_TIMESTAMP DESC DISTINCT ELSE END ESCAPE EXCLUDE EXISTS FALSE FILTER FOLLOWING FULL ILIKE IN INNER INTERVAL INTO IS JOIN LATERAL LEFT LIKE NATURAL NOT NULL NULLS ON OR OUTER OVER OVERWRITE PARTITION PRECEDING RANGE RECURSIVE RIGHT RLIKE ROW ROWS SOME TABLE TABLESAMPLE THEN TRUE UNBOUNDED USING WHEN WITHIN".split()
)
_JOIN_WORDS = {"LEFT", "RIGHT", "FULL", "INNER", "OUTER", "CROSS", "NATURAL", "SEMI", "ANTI", "LATERAL", "FROM", "JOIN", ","}
_TARGET_WORDS = {"CREATE", "OR", "REPLACE", "TEMP", "TEMPORARY", "GLOBAL", "EXTERNAL", "MATERIALIZED", "TABLE", "VIEW", "IF", "NOT", "EXISTS", "INSERT", "INTO", "OVERWRITE"}
_KEY, _GROUP = ["id", "n"], ["id", "n", "g"]
_BLOCK = [*_GROUP, "branch"]


def _any(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def tokens(texts: DataFrame, id_col: str = "statement_id", sql_col: str = "sql") -> DataFrame:
    """(id, n, pos, tok, up, word, name, ...): a row for each token without comments; ``n`` counts the statements of a text.

    ``name`` tells an identifier. Null and blank texts have no tokens.
    """
    found = F.filter(F.regexp_extract_all(sql_col, F.lit(_TOKEN), F.lit(0)), lambda x: ~(x.startswith("--") | x.startswith("/*")))
    t = texts.select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "tok"))
    t = t.withColumn("up", F.when(F.col("tok").rlike(r"^[\p{L}_]"), F.upper("tok")).otherwise(F.col("tok")))
    t = t.withColumn("word", F.when(F.col("tok").rlike('^["`]'), F.expr("substr(tok, 2, length(tok) - 2)")).otherwise(F.col("tok")))
    t = t.withColumn("name", F.col("tok").rlike(r'^[\p{L}_"`]') & ~F.expr(f"up in {_any(_WORDS)}"))
    by = Window.partitionBy("id").orderBy("pos")
    # After AS or a dot any word is a name, but for a query's and a window's.
    t = t.withColumn("name", F.expr(f"name or (tok rlike '^[\\\\p{{L}}_]' and coalesce(lag(up) over (partition by id order by pos), '') in ('AS', '.') and up not in ('SELECT', 'WITH', 'NOT'))"))
    for k in range(1, 5):
        t = t.withColumn(f"p{k}", F.lag("up", k).over(by))
    t = t.withColumn("w2", F.lag("word", 2).over(by)).withColumn("w4", F.lag("word", 4).over(by)).withColumn("prev_name", F.lag("name", 1).over(by))
    t = t.withColumn("next", F.lead("up", 1).over(by))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    close = F.expr("cast(tok = ')' as int)")
    # Every bracket pair is matched by its depth; then it is a query's, a join's or an expression's.
    t = t.withColumn("raw", F.sum(F.expr("case tok when '(' then 1 when ')' then -1 else 0 end")).over(so_far) + close)
    t = t.withColumn("n", F.sum(F.expr("cast(tok = ';' and raw = 0 as int)")).over(so_far))
    kind = F.expr("case when tok = '(' then case when next in ('SELECT', 'WITH') then 'query' when p1 in ('FROM', 'JOIN') then 'join' else 'plain' end end")
    t = t.withColumn("bracket", F.when(F.col("tok").isin("(", ")"), F.last(kind, ignorenulls=True).over(Window.partitionBy("id", "raw").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))))
    step = "case when tok = '(' then 1 when tok = ')' then -1 else 0 end"
    t = t.withColumn("depth", F.sum(F.expr(f"case when bracket <> 'join' then {step} else 0 end")).over(so_far) + F.expr("cast(tok = ')' and bracket <> 'join' as int)"))
    t = t.withColumn("deep", F.sum(F.expr(f"case when bracket = 'query' then {step} else 0 end")).over(so_far) + F.expr("cast(tok = ')' and bracket = 'query' as int)"))
    # A query's opening bracket stands twice: in the query, and as ``sub`` in the one around it.
    twice = F.explode(F.expr("case when tok = '(' and bracket = 'query' then array(0, 1) else array(0) end")).alias("out")
    t = t.where("tok <> ';' and not coalesce(bracket = 'join', false)").select("*", twice).withColumn("depth", F.expr("depth - out")).withColumn("deep", F.expr("deep - out")).withColumn("sub", F.expr("if(out = 1, pos, null)"))
    inner = Window.partitionBy("id", "n", "deep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.expr("tok = '(' and bracket = 'query' and out = 0")
    t = t.withColumn("g", F.coalesce(F.last(F.when(opens, F.col("pos")), ignorenulls=True).over(inner), F.lit(-1)))
    t = t.withColumn("level", F.col("depth") - F.coalesce(F.last(F.when(opens, F.col("depth")), ignorenulls=True).over(inner), F.lit(0)))
    # Within a query: branch, clause, item, relation.
    at = Window.partitionBy(*_GROUP).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("branch", F.sum(F.expr(f"cast(level = 0 and up in {_any(_SETS)} and not (up = 'EXCEPT' and coalesce(p1, '') = '*') as int)")).over(at))
    block = Window.partitionBy(*_BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    clause = F.expr(f"case when level = 0 and up in {_any(_CLAUSES)} and not (up = 'GROUP' and coalesce(p1, '') = 'WITHIN') and not (up = 'FROM' and coalesce(p1, '') = 'DISTINCT') then up end")
    t = t.withColumn("clause", F.last(clause, ignorenulls=True).over(block)).withColumn("heads", clause.isNotNull())
    top = "(up = 'TOP' and p1 in ('SELECT', 'DISTINCT', 'ALL') and (next = '(' or next rlike '^[0-9]')) or (p1 = 'TOP' and (tok = '(' or tok rlike '^[0-9]')) or (p2 = 'TOP' and p1 = '(') or (p3 = 'TOP' and p2 = '(') or (up in ('DISTINCT', 'ALL') and p1 = 'SELECT')"
    t = t.withColumn("skip", F.expr(f"coalesce({top}, false) or heads"))
    t = t.withColumn("item", F.sum(F.expr("cast(level = 0 and tok = ',' as int)")).over(Window.partitionBy(*_BLOCK, "clause").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.expr("case when clause = 'FROM' and level = 0 then case when up in ('FROM', 'JOIN') then 'relation' when up = 'LATERAL' and next = 'VIEW' then 'view' when up in ('ON', 'USING') then 'condition' end end")
    t = t.withColumn("mark", F.last(mark, ignorenulls=True).over(block))
    comma = F.expr("clause = 'FROM' and level = 0 and tok = ',' and mark <> 'view'")
    state = F.when(comma, F.lit("relation")).otherwise(mark)
    t = t.withColumn("state", F.last(state, ignorenulls=True).over(block))
    return t.withColumn("rel", F.sum((state.isin("relation", "view") & state.isNotNull()).cast("int")).over(block))


#: A task's tokens in the shuffles after them, of some 300 bytes each.
_A_TASK = 200_000
#: What the later steps read of a token.
_KEPT = "id n pos tok up word name p1 p2 p3 w2 w4 prev_name next level g branch clause skip item state rel sub".split()


def _sorted(*fields: str, where: str = "true"):
    return F.expr(f"array_sort(collect_list(struct({', '.join(fields)})) filter (where {where}))")


def _chain(words: str) -> str:
    """How many of the words at the start make one dotted name."""
    return f"coalesce(array_min(filter(sequence(1, greatest(size({words}) - 1, 1)), i -> get({words}, i).tok <> '.' and get({words}, i - 1).tok <> '.' and i < size({words}))), size({words}))"


_dotted = lambda words, n: f"transform(filter(slice({words}, 1, {n}), x -> x.tok <> '.'), x -> x.word)"
_last_two = lambda parts: f"array_join(slice({parts}, greatest(size({parts}) - 1, 1), 2), '.')"


def statements(t: DataFrame) -> DataFrame:
    """(id, n, kind, target, names): kind is query, insert or create for statements with lineage, else other;
    ``names`` is an insertion's list of columns."""
    outer = t.where("g = -1")
    plain = f"level = 0 and clause in ('INSERT', 'CREATE') and up not in {_any(_TARGET_WORDS)} and sub is null"
    s = outer.groupBy(*_KEY).agg(
        F.min_by("up", "pos").alias("first"), F.expr("max(case when clause = 'INSERT' then 1 else 0 end)").alias("inserts"), F.expr("max(case when clause = 'SELECT' or (sub is not null and level = 0 and coalesce(clause, '') <> 'WITH') then 1 else 0 end)").alias("queries"),
        _sorted("pos", "tok", "word", "name", where=plain).alias("words"), _sorted("pos", "word", where="clause = 'INSERT' and level = 1 and name and p1 in ('(', ',')").alias("list"),
    )
    kind = F.expr("case when queries = 0 then 'other' when inserts = 1 and first in ('INSERT', 'WITH') then 'insert' when first = 'CREATE' then 'create' when first in ('SELECT', 'WITH', '(') then 'query' else 'other' end")
    parts = _dotted("words", _chain("words"))
    return s.select(*_KEY, kind.alias("kind"), F.expr(f"if(size(words) > 0 and words[0].name, {_last_two(parts)}, null)").alias("target"), F.expr("transform(list, x -> x.word)").alias("names"))


def commons(t: DataFrame) -> DataFrame:
    """(id, n, g, name, names, body, at, recursive): the common tables, by the query that declares them."""
    w = t.where("clause = 'WITH'")
    each = w.groupBy(*_BLOCK, "item").agg(F.min_by("word", F.expr("if(level = 0 and name, pos, null)")).alias("name"), F.max("sub").alias("body"), F.min("pos").alias("at"), _sorted("pos", "word", where="level = 1 and name").alias("list"))
    recursive = w.groupBy(*_GROUP).agg(F.max(F.col("up") == "RECURSIVE").alias("recursive"))
    return each.where("body is not null").join(recursive, _GROUP).select(*_GROUP, F.lower("name").alias("name"), F.expr("if(size(list) > 0, transform(list, x -> x.word), null)").alias("names"), "body", "at", "recursive")


def relations(t: DataFrame) -> DataFrame:
    """(id, n, g, branch, rel, at, kind, dataset, single, inner, alias, names): what each FROM reads: a table, a
    query, a function or a lateral view; a block that is only a bracketed query reads that."""
    f = t.where("clause = 'FROM' and state in ('relation', 'view') and rel > 0")
    # A bracket with its content is no part of the words: what an argument list holds is a level deeper.
    words = f"level = 0 and up not in {_any(_JOIN_WORDS - {','})} and not (tok = ',' and state = 'relation')"
    r = f.groupBy(*_BLOCK, "rel").agg(
        F.min("state").alias("state"), F.min("pos").alias("at"), _sorted("pos", "tok", "up", "word", "name", "next", "sub", where=words).alias("all"), _sorted("pos", "word", where="level = 1 and name and p1 in ('(', ',')").alias("list")
    )
    r = r.withColumn("words", F.expr("filter(all, x -> x.up <> 'AS')")).where("size(words) > 0")
    parts, n = _dotted("words", "len"), _chain("words")
    r = r.withColumn("len", F.expr(n)).withColumn("kind", F.expr("case when state = 'view' then 'view' when words[0].sub is not null then 'query' when words[0].name and get(words, len - 1).next = '(' then 'function' when words[0].name then 'table' end"))
    view = "filter(words, x -> x.up not in ('VIEW', 'OUTER', ','))"  # function, alias, columns
    as_at = "coalesce(array_position(transform(all, x -> x.up), 'AS'), 0)"
    columns = f"if({as_at} > 0, transform(filter(slice(all, {as_at} + 1, size(all)), x -> x.name), x -> x.word), array())"
    named = "get(words, if(kind = 'query', 1, len))"
    out = r.where("kind is not null").select(
        *_BLOCK, "rel", "at", "kind", F.expr(f"if(kind = 'table', {_last_two(parts)}, null)").alias("dataset"), F.expr(f"kind = 'table' and size({parts}) = 1").alias("single"), F.expr("if(kind = 'query', words[0].sub, null)").alias("inner"),
        F.lower(F.expr(f"case when kind = 'view' then if(get({view}, 1).pos < get(all, {as_at} - 1).pos or {as_at} = 0, get({view}, 1).word, '') else coalesce(if({named}.name, {named}.word, null), if(kind = 'table', element_at({parts}, -1), '')) end")).alias("alias"),
        F.expr(f"case when kind = 'view' then {columns} when kind <> 'function' and size(list) > 0 then transform(list, x -> x.word) end").alias("names"),
    )
    alone = t.where("level = 0 and sub is not null and (clause is null or clause in ('INSERT', 'CREATE'))").groupBy(*_BLOCK).agg(F.min("sub").alias("inner"))
    return out.unionByName(alone.select(*_BLOCK, F.lit(1).alias("rel"), F.col("inner").alias("at"), F.lit("query").alias("kind"), "inner", F.lit("").alias("alias"), F.lit(False).alias("single")), allowMissingColumns=True)


def items(t: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, n, g, branch, item, first, last, alias_at, name, bare, star, of, without): the select items."""
    i = t.where("clause = 'SELECT' and not skip and not (level = 0 and tok = ',') and not (tok = ')' and level < 0)")
    i = i.groupBy(*_BLOCK, "item").agg(_sorted("pos", "tok", "up", "word", "name", "p1", "prev_name", "level", "sub").alias("all"), F.max("pos").alias("end"))
    tail = "element_at(all, -1)"
    given = f"size(all) > 1 and {tail}.level = 0 and {tail}.name and ({tail}.p1 = 'AS' or ({tail}.p1 <> '.' and ({tail}.prev_name or {tail}.p1 in (')', 'END', 'NULL', 'TRUE', 'FALSE', 'CURRENT_DATE', 'CURRENT_TIMESTAMP', 'ROW') or {tail}.p1 rlike '^[0-9''\"`\\\\]]')))"
    i = i.withColumn("given", F.expr(given)).withColumn("body", F.expr(f"if(given, filter(all, x -> x.pos < {tail}.pos and not (x.up = 'AS' and x.pos = {tail}.pos - 1)), all)"))
    star = "get(filter(body, x -> x.tok = '*' and x.level = 0 and (x.pos = body[0].pos or x.p1 = '.')), 0)"
    i = i.withColumn("star", F.expr(f"{star} is not null and (size(body) = 1 or {star}.p1 = '.' or body[0].tok = '*')"))
    i = i.withColumn("bare", F.expr("not star and forall(body, x -> x.name or x.tok = '.') and size(body) % 2 = 1 and body[0].sub is null"))
    i = i.select(
        *_BLOCK, "item", F.expr("body[0].pos").alias("first"), F.expr("if(given, element_at(body, -1).pos, end)").alias("last"), F.expr(f"if(given, {tail}.pos, null)").alias("alias_at"),
        F.expr(f"case when given then {tail}.word when bare then element_at(body, -1).word end").alias("name"), "bare", "star", F.expr("if(star and body[0].tok <> '*', lower(element_at(filter(body, x -> x.name), 1).word), null)").alias("of"),
        F.expr("if(star, transform(filter(body, x -> x.level = 1 and x.name), x -> lower(x.word)), array())").alias("without"),
    )
    # A block without a SELECT hands its only relation on.
    alone = rels.join(i.select(*_BLOCK).distinct(), _BLOCK, "left_anti").where("kind = 'query'").groupBy(*_BLOCK).agg(F.min("at").alias("first"))
    return i.unionByName(alone.select(*_BLOCK, F.lit(0).alias("item"), "first", F.col("first").alias("last"), F.lit(False).alias("bare"), F.lit(True).alias("star"), F.expr("cast(array() as array<string>)").alias("without")), allowMissingColumns=True)


def references(t: DataFrame, of: DataFrame) -> DataFrame:
    """(id, n, g, branch, item, rel, pos, a, b, c): the columns that items and arguments of lateral views and functions
    name, as parts of a dotted name from the right; ``rel`` is 0 for an item's."""
    kept = "name and next is distinct from '.' and next is distinct from '(' and next is distinct from '=>' and next is distinct from '->' and coalesce(p1, '') not in ('AS', '::', 'NULLS') and not coalesce(next like '\\'%', false) and not coalesce(p1 rlike '^[0-9\\']' and p2 <> 'TOP', false) and not (level > 0 and coalesce(next, '') = 'FROM')"
    r = t.where(kept).where("(clause = 'SELECT' and not skip) or (clause = 'FROM' and level > 0 and state <> 'condition')")
    r = r.select(*_BLOCK, "item", F.expr("if(clause = 'FROM', rel, 0)").alias("rel"), "pos", F.col("word").alias("a"), F.expr("if(p1 = '.', w2, null)").alias("b"), F.expr("if(p1 = '.' and p3 = '.', w4, null)").alias("c"))
    alias = of.where("alias_at is not null").select(*_BLOCK, F.col("alias_at").alias("pos"))
    # What a star leaves out is no reference to it.
    return r.join(alias, [*_BLOCK, "pos"], "left_anti").join(of.where("star").select(*_BLOCK, "item", F.lit(0).alias("rel")), [*_BLOCK, "item", "rel"], "left_anti")


def _with_commons(rels: DataFrame, ctes: DataFrame, groups: DataFrame) -> DataFrame:
    """Relations that name a common table read its body: the innermost one declared before, in a query around."""
    c = ctes.join(groups.select(*_GROUP, F.col("close").alias("until")), _GROUP).join(groups.select("id", "n", F.col("g").alias("body"), F.col("close").alias("body_end")), ["id", "n", "body"])
    c = c.select("id", "n", F.col("g").alias("of"), F.col("name").alias("cte"), F.col("names").alias("cte_names"), "body", F.col("at").alias("from"), "until", "body_end", "recursive")
    near = rels.where("single").alias("r").join(c.alias("c"), F.expr("r.id = c.id and r.n = c.n and lower(r.dataset) = c.cte and r.at > c.from and r.at <= c.until and (c.recursive or r.at < c.body or r.at > c.body_end)"))
    near = near.groupBy(*(F.col(f"r.{k}").alias(k) for k in [*_BLOCK, "rel"])).agg(F.max_by(F.struct("body", "cte_names"), F.col("c.of")).alias("cte"))
    j = rels.join(near, [*_BLOCK, "rel"], "left")
    return j.select(*_BLOCK, "rel", "at", F.expr("if(cte is null, kind, 'query')").alias("kind"), F.expr("if(cte is null, dataset, null)").alias("dataset"), F.expr("coalesce(cte.body, inner)").alias("inner"), "alias", F.expr("coalesce(names, cte.cte_names)").alias("names"))


class Extraction:
    """The tables of one run over the texts, written once each, when they are first asked for.

    statements: (id, n, kind, target, names); sources: (id, n, dataset); derivations: see ``extract``.
    """

    def __init__(self, texts: DataFrame, id_col: str = "statement_id", sql_col: str = "sql", catalog: DataFrame | None = None):
        spark = texts.sparkSession
        t, n = counted(tokens(texts, id_col, sql_col).select(*_KEPT), "sql-tokens")
        self.tokens, self.tasks = t, n // _A_TASK + 1
        self.catalog = spark.createDataFrame([], "dataset string, place int, column string") if catalog is None else catalog.select("dataset", F.col("place").cast("int").alias("place"), "column")

    def planned(self):
        """How the joins of a run are planned; what is run later must be within as well."""
        return by_shuffled_size(self.tokens.sparkSession, self.tasks)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        with self.planned():
            return materialize(df, name)

    @cached_property
    def statements(self) -> DataFrame:
        return self._written(statements(self.tokens), "sql-statements")

    @property
    def _read(self) -> DataFrame:
        """The tokens of the statements with lineage."""
        return self.tokens.join(self.statements.where("kind <> 'other'").select(*_KEY), _KEY, "left_semi")

    @cached_property
    def groups(self) -> DataFrame:
        return self._written(self._read.groupBy(*_GROUP).agg(F.max("pos").alias("close")), "sql-groups")

    @cached_property
    def relations(self) -> DataFrame:
        # The last token of the outermost query ends after all others.
        groups = self.groups.select(*_GROUP, F.expr("if(g = -1, 2147483647, close)").alias("close"))
        return self._written(_with_commons(relations(self._read), commons(self._read), groups), "sql-relations")

    @cached_property
    def items(self) -> DataFrame:
        return self._written(items(self._read, self.relations), "sql-items")

    @cached_property
    def references(self) -> DataFrame:
        return self._written(references(self._read, self.items), "sql-references")

    @property
    def sources(self) -> DataFrame:
        return self.relations.where("kind = 'table'").select(*_KEY, "dataset").distinct()

    @property
    def spans(self) -> DataFrame:
        return self._read.groupBy(*_BLOCK).agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))

    @property
    def words(self) -> DataFrame:
        glue = F.expr("concat(if(p1 is null or p1 in ('(', '.', '::') or tok in (')', ',', '.', '::') or (tok = '(' and prev_name), '', ' '), tok)")
        return self._read.where("sub is null").groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("pos", glue.alias("text")))).alias("words"))

    def _texts(self) -> DataFrame:
        """The items' expressions in a plain form: the tokens with single spaces."""
        text = "trim(array_join(transform(filter(words, x -> x.pos >= first and x.pos <= last), x -> x.text), ''))"
        ends = self.groups.select("id", "n", F.col("g").alias("last"), "close")
        whole = self.items.join(ends, ["id", "n", "last"], "left").withColumn("last", F.coalesce("close", "last"))
        return whole.join(self.words, _KEY).select(*_BLOCK, "item", F.expr(text).alias("text"))

    def outputs(self) -> DataFrame:
        """(id, n, g, branch, item, place, name, bare, text, dataset, column, inner, inner_place, view): what every branch puts
        out, stars expanded. A star over a table that isn't catalogued is one output ``*``."""
        listed = self.items.join(self._texts(), [*_BLOCK, "item"])
        plain = listed.where("not star").select(*_BLOCK, "item", F.lit(0).alias("rel"), F.lit(0).alias("k"), F.coalesce("name", "text").alias("name"), "bare", "text")
        over = listed.where("star").join(self.relations.select(*_BLOCK, "rel", "kind", "dataset", "inner", "alias", "names"), _BLOCK).where("of is null or of = alias or of = lower(dataset)")
        over = materialize(over.select(*_BLOCK, "item", "rel", "kind", "dataset", "inner", "names", "without"), "sql-stars")
        base = over.where("kind = 'table'").join(self.catalog.withColumnRenamed("dataset", "of"), F.expr("lower(dataset) = lower(of)"), "left")
        base = base.select(*_BLOCK, "item", "rel", F.coalesce("place", F.lit(0)).alias("k"), F.coalesce("column", F.lit("*")).alias("column"), "dataset", "without", F.lit(None).cast("string").alias("view"))
        views = over.where("kind in ('view', 'function')").select(*_BLOCK, "item", "rel", F.posexplode(F.expr("if(size(names) > 0, names, array('*'))")).alias("k", "column"), F.lit(None).cast("string").alias("dataset"), "without", _node("v", "rel").alias("view"))
        flat = base.unionByName(views).where("not array_contains(without, lower(column))")
        flat = flat.select(*_BLOCK, "item", "rel", "k", F.col("column").alias("name"), F.expr("view is null").alias("bare"), "dataset", F.expr("if(view is null, column, null)").alias("column"), "view")
        fixed = materialize(plain.unionByName(flat, allowMissingColumns=True), "sql-outputs")
        queries = over.where("kind = 'query'")

        def put_out(of: DataFrame, known: DataFrame | None) -> DataFrame:
            rows = fixed.join(of, _GROUP, "left_semi")
            if known is not None:
                inner = known.select("id", "n", F.col("g").alias("inner"), F.col("place").alias("inner_place"), F.col("name").alias("inner_name"), F.col("bare").alias("inner_bare"), "text")
                q = queries.join(of, _GROUP, "left_semi").join(inner, ["id", "n", "inner"]).withColumn("name", F.expr("coalesce(get(names, inner_place - 1), inner_name)")).where("not array_contains(without, lower(name))")
                rows = rows.unionByName(q.select(*_BLOCK, "item", "rel", F.col("inner_place").alias("k"), "name", F.col("inner_bare").alias("bare"), "text", "inner", "inner_place"), allowMissingColumns=True)
            place = F.row_number().over(Window.partitionBy(*_BLOCK).orderBy("item", "rel", "k"))
            return rows.withColumn("place", place)

        # A query's names are those of its first branch; it waits for the queries that its stars there read.
        first = self.groups.select(*_GROUP)
        waits = queries.where("branch = 0").select(*_GROUP, "inner").distinct()
        done, known = None, None
        while True:
            open_ = waits if done is None else waits.join(done.withColumnRenamed("g", "inner"), ["id", "n", "inner"], "left_anti")
            ready = first.join(open_, _GROUP, "left_anti")
            ready = ready if done is None else ready.join(done, _GROUP, "left_anti")
            now = put_out(ready, known).where("branch = 0") if known is not None else put_out(ready, fixed.limit(0).withColumn("place", F.lit(0)))
            step, n = counted(now.where("branch = 0").select(*_GROUP, "place", "name", "bare", "text"), "sql-names")
            if not n:
                break
            known = step if known is None else known.unionAll(step)
            ready = step.select(*_GROUP).distinct()
            done = ready if done is None else done.unionAll(ready)
        if known is None:
            known = fixed.withColumn("place", F.lit(0)).select(*_GROUP, "place", "name", "bare", "text")
        self.names = known
        return put_out(first, known)

    def _resolved(self) -> DataFrame:
        """(id, n, g, branch, item, rel, want, dataset, inner, inner_place, view): what each reference means; no row if nothing."""
        span = self.spans.withColumnsRenamed({"g": "rg", "branch": "rb"})
        rels = self.relations.withColumnsRenamed({"g": "rg", "branch": "rb", "rel": "rr"}).join(span, ["id", "n", "rg", "rb"])
        inline = self.groups.select("id", "n", F.col("g").alias("inner"), F.col("close").alias("inner_end"))
        pairs = self.references.join(rels.join(inline, ["id", "n", "inner"], "left"), _KEY).where("start <= pos and pos <= stop and not (rg = g and rb = branch and rr = rel and rel > 0)")
        # A query in a FROM doesn't see what it puts out itself.
        pairs = pairs.where("inner is null or at > inner or pos < inner or pos > inner_end")
        one = "c is null"
        means = F.expr(
            f"case when b is null then a when alias = lower(b) and ({one} or dataset is null) then a when not ({one}) and lower(dataset) = lower(concat(c, '.', b)) then a when {one} and lower(dataset) = lower(b) then a when not ({one}) and alias = lower(c) then b end"
        )
        pairs = pairs.withColumn("column", means).where("column is not null")
        # What a relation is known to have: a query's outputs under its own or given names, a view's, a catalogued table's.
        out = self.names.select("id", "n", F.col("g").alias("inner"), "place", "name")
        of_query = rels.where("kind = 'query'").join(out, ["id", "n", "inner"]).select("id", "n", "rg", "rb", "rr", F.lower(F.expr("coalesce(get(names, place - 1), name)")).alias("has"), "place")
        of_view = rels.where("kind = 'view'").select("id", "n", "rg", "rb", "rr", F.explode("names").alias("has"), F.lit(0).alias("place")).withColumn("has", F.lower("has"))
        of_table = rels.where("kind = 'table'").join(self.catalog.withColumnRenamed("dataset", "of"), F.expr("lower(dataset) = lower(of)")).select("id", "n", "rg", "rb", "rr", F.lower("column").alias("has"), F.lit(0).alias("place"))
        has = of_query.unionAll(of_view).unionAll(of_table)
        has = has.groupBy("id", "n", "rg", "rb", "rr", "has").agg(F.min("place").alias("place"))
        at = ["id", "n", "rg", "rb", "rr"]
        known = pairs.join(has.withColumnRenamed("has", "key").withColumnRenamed("place", "inner_place"), [*at], "left").where("key is null or key = lower(column) or key = '*'")
        exact, star = F.expr("key = lower(column)"), F.expr("key = '*'")
        known = known.groupBy(*_BLOCK, "item", "rel", "pos", "a", "b", "c", "column", "kind", "dataset", "inner", "alias", "start", "rg", "rb", "rr").agg(F.max(F.when(exact, F.col("inner_place"))).alias("exact"), F.max(F.when(star, F.col("inner_place"))).alias("star"))
        catalogued = has.select(*at).distinct().withColumn("full", F.lit(True))
        known = known.join(catalogued, at, "left").withColumn("own", F.expr("rg = g and rb = branch"))
        # 3: the name is known to be there; 2: it is qualified; 1: the relation could have it.
        sure = "case when exact is not null then 3 when b is not null then 2 when kind = 'query' and star is not null then 1 when kind in ('table', 'function') and full is null then 1 end"
        known = known.withColumn("sure", F.expr(sure)).where("sure is not null and (sure > 1 or own)")
        ref = Window.partitionBy(*_BLOCK, "item", "rel", "pos")
        # The query's own relations first, if one has the name or only one could; then the nearest around that has it.
        known = known.withColumn("many", F.sum(F.expr("cast(own and sure = 1 as int)")).over(ref))
        known = known.withColumn("prefer", F.expr("case when own and sure > 1 then struct(4, start, sure) when own and many = 1 then struct(3, start, sure) when not own then struct(2, start, sure) else struct(1, start, sure) end"))
        best = known.withColumn("most", F.max("prefer").over(ref)).where("prefer = most").withColumn("least", F.min("rr").over(ref)).where("rr = least")
        chosen = best.select(
            *_BLOCK, "item", "rel", "pos", F.col("column").alias("want"), F.expr("if(sure = 1 and many > 1, 'unknown', dataset)").alias("dataset"), F.expr("if(sure = 1 and many > 1, null, inner)").alias("inner"),
            F.expr("if(kind = 'query', coalesce(exact, star), null)").alias("inner_place"), F.when(F.expr("kind in ('view', 'function') and not (sure = 1 and many > 1)"), F.concat_ws(":", F.lit("v"), "rg", "rb", "rr")).alias("view"),
        )
        lost = self.references.join(best.select(*_BLOCK, "item", "rel", "pos"), [*_BLOCK, "item", "rel", "pos"], "left_anti")
        lost = lost.select(*_BLOCK, "item", "rel", "pos", F.col("a").alias("want"), F.expr("coalesce(concat_ws('.', c, b), '')").alias("q")).withColumn("dataset", F.expr("if(q = '', 'unknown', q)")).drop("q")
        return chosen.unionByName(lost, allowMissingColumns=True).where("dataset is not null or view is not null or inner_place is not null")

    def without_source(self) -> DataFrame:
        """C14: (id, n, item): the items of the outermost queries that name no column, and so give no row."""
        scalar = self.tokens.where("sub is not null and clause = 'SELECT' and not skip").select(*_BLOCK, "item")
        own = self.items.where("g = -1 and not star")
        with self.planned():
            return materialize(own.join(self.references.where("rel = 0").select(*_BLOCK, "item").unionAll(scalar), [*_BLOCK, "item"], "left_anti").select("id", "n", "item"), "sql-without-source")

    def derivations(self) -> DataFrame:
        """(id, n, target, place, column, source_dataset, source_column, expression, is_passthrough)."""
        with self.planned():
            return self._derivations()

    def _derivations(self) -> DataFrame:
        outs = materialize(self.outputs(), "sql-expanded")
        refs = materialize(self._resolved(), "sql-resolved")
        to = F.expr("coalesce(view, concat_ws(':', 'o', inner, inner_place))")
        step = lambda df, node: df.select("id", "n", node.alias("node"), F.expr("if(dataset is null, null, dataset)").alias("dataset"), "want", F.when(F.col("dataset").isNull(), to).alias("to"))
        place = outs.select(*_BLOCK, "item", "place")
        of_items = step(refs.where("rel = 0").join(place, [*_BLOCK, "item"]), _node("o", "place", branch=False))
        of_views = step(refs.where("rel > 0"), _node("v", "rel"))
        of_stars = step(outs.where("dataset is not null or inner is not null or view is not null").withColumn("want", F.coalesce("column", F.lit("*"))), _node("o", "place", branch=False))
        scalar = self.tokens.where("sub is not null and clause = 'SELECT' and not skip and coalesce(p1, '') not in ('IN', 'EXISTS')").select(*_BLOCK, "item", F.col("sub").alias("inner"))
        inner = self.names.select("id", "n", F.col("g").alias("inner"), F.col("place").alias("inner_place"))
        of_scalars = scalar.join(place, [*_BLOCK, "item"]).join(inner, ["id", "n", "inner"]).withColumn("dataset", F.lit(None).cast("string")).withColumn("want", F.lit("*")).withColumn("view", F.lit(None).cast("string"))
        edges = materialize(of_items.unionAll(of_views).unionAll(of_stars).unionAll(step(of_scalars, _node("o", "place", branch=False))).distinct(), "sql-edges")

        # Columns behind each output of the outermost query; a star takes the name that is asked of it.
        clean = outs.groupBy("id", "n", _node("o", "place", branch=False).alias("node")).agg(F.expr("bool_and(bare)").alias("bare"))
        final = outs.where("g = -1").groupBy("id", "n", "place").agg(F.expr("min_by(name, branch)").alias("name"), F.expr("min_by(text, branch)").alias("text"))
        new = materialize(final.select("id", "n", "place", F.concat_ws(":", F.lit("o"), F.lit(-1), "place").alias("node"), F.lit("*").alias("ask")), "sql-reach")
        seen, levels = new, [new]
        while True:
            # Asked for through a star, a column keeps its name; else the next step has its own.
            found = new.join(edges, ["id", "n", "node"]).where("to is not null").select("id", "n", "place", F.col("to").alias("node"), F.expr("if(want = '*', ask, want)").alias("ask")).distinct()
            new, n = counted(found.join(seen, ["id", "n", "place", "node", "ask"], "left_anti"), "sql-reach")
            if not n:
                break
            levels.append(new)
            seen = seen.unionAll(new)
        reached = seen.join(clean, ["id", "n", "node"], "left")
        whole = reached.groupBy("id", "n", "place").agg(F.expr("bool_and(coalesce(bare, false))").alias("clean"))
        base = seen.join(edges, ["id", "n", "node"]).where("dataset is not null").select("id", "n", "place", F.col("dataset").alias("source_dataset"), F.expr("if(want = '*', ask, want)").alias("source_column")).distinct()
        many = base.groupBy("id", "n", "place").agg(F.count(F.lit(1)).alias("many"))
        out = base.join(many, ["id", "n", "place"]).join(whole, ["id", "n", "place"]).join(final, ["id", "n", "place"]).join(self.statements.select("id", "n", "target", F.col("names").alias("listed")), _KEY)
        out = out.withColumn("through", F.expr("clean and many = 1")).select(
            "id", "n", "target", "place", F.expr("coalesce(get(listed, place - 1), name)").alias("column"), "source_dataset", "source_column", F.expr("if(through, null, text)").alias("expression"), F.col("through").alias("is_passthrough")
        )
        done = materialize(out, "sql-derivations")
        forget(outs, refs, edges, *levels)
        return done


def _node(kind: str, part: str, branch: bool = True):
    return F.concat_ws(":", F.lit(kind), "g", *(["branch"] if branch else []), part)


def extract(texts: DataFrame, id_col: str = "statement_id", sql_col: str = "sql", catalog: DataFrame | None = None) -> DataFrame:
    """(id, n, target, place, column, source_dataset, source_column, expression, is_passthrough) for every statement with
    lineage of every text: a row for each base column that an output is computed from.

    ``catalog`` (dataset, place, column) expands stars and tells which table has a bare name. A bare name
    that several uncatalogued tables could have is of the dataset ``unknown``. Null and blank texts, and
    statements that are no queries, insertions or creations, give no rows. Texts aren't checked: what is no
    SQL gives what its tokens look like. Ids must be unique.
    """
    return Extraction(texts, id_col, sql_col, catalog).derivations()


def events(run: Extraction, given: Column | None = None) -> DataFrame:
    """(id, n, target, source_datasets): a row for each statement with lineage that has a source; the tables found
    and the ``given`` ones (an array), in order and without repeats."""
    with run.planned():
        found = run.sources.groupBy(*_KEY).agg(F.collect_set("dataset").alias("found"))
        every = run.statements.where("kind <> 'other'").join(found, _KEY, "left")
        own = F.coalesce("found", F.array().cast("array<string>"))
        all_ = F.array_sort(own if given is None else F.array_union(own, given))
        return materialize(every.withColumn("source_datasets", all_).where("size(source_datasets) > 0").select(*_KEY, "target", "source_datasets"), "sql-events")


def transform_id(sql: str) -> Column:
    """C17: a text's stable id."""
    return F.substring(F.sha2(F.col(sql), 256), 1, 16)


def warehouse(dialect: str) -> Column:
    """The warehouse of a dialect."""
    return F.when(F.col(dialect).isin("redshift", "bigquery", "snowflake", "postgres"), F.col(dialect)).otherwise("generic")


_ONE = r'(?:[\p{L}_][\p{L}\p{N}_$]*|"[^"]*"|`[^`]*`)'
_NAME = f"({_ONE}(?: [.] {_ONE})*)"
#: (the change, a statement with single spaces between its tokens, where the column, the new name and the new type stand).
_CHANGES = [
    ("drop_column", f"(?i)^ALTER TABLE (?:IF EXISTS )?{_NAME} DROP (?:COLUMN )?(?:IF EXISTS )?(?!COLUMNS? ){_NAME}$", 2, 0, 0),
    ("rename_column", f"(?i)^ALTER TABLE (?:IF EXISTS )?{_NAME} RENAME COLUMN {_NAME} TO {_NAME}$", 2, 3, 0),
    ("rename_table", f"(?i)^ALTER TABLE (?:IF EXISTS )?{_NAME} RENAME TO {_NAME}$", 0, 2, 0),
    ("add_column", f"(?i)^ALTER TABLE (?:IF EXISTS )?{_NAME} ADD (?:COLUMN )?(?:IF NOT EXISTS )?(?!COLUMNS? ){_NAME} ([^ ]+(?: [(] [0-9 ,]+ [)])?)", 2, 0, 3),
    ("type_change", f"(?i)^ALTER TABLE (?:IF EXISTS )?{_NAME} (?:ALTER|CHANGE|MODIFY) (?:COLUMN )?{_NAME} (?:SET DATA )?(?:TYPE )?(?!SET |DROP |TYPE )([^ ]+(?: [(] [0-9 ,]+ [)])?)", 2, 0, 3),
    ("drop_table", f"(?i)^DROP TABLE (?:IF EXISTS )?{_NAME}", 0, 0, 0),
]


def schema_changes(texts: DataFrame, id_col: str = "statement_id", sql_col: str = "sql") -> DataFrame:
    """(id, n, dataset, column, change_type, new_name, new_type): what ALTER TABLE and DROP TABLE statements change.

    One change for each statement; others, null and blank texts give no rows. Names lose their quotes, types
    are in capitals.
    """
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ")
    s = tokens(texts, id_col, sql_col).where("sub is null").groupBy(*_KEY).agg(words.alias("text"), F.min_by("up", "pos").alias("first")).where("first in ('ALTER', 'DROP')")
    take = lambda pattern, k: F.nullif(F.regexp_extract("text", pattern, k), F.lit("")) if k else F.lit(None).cast("string")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, '["`]', ""), " [.] ", ".")
    found = [
        F.when(F.col("text").rlike(p), F.struct(plain(take(p, 1)).alias("dataset"), plain(take(p, c)).alias("column"), F.lit(kind).alias("change_type"), plain(take(p, name)).alias("new_name"), F.upper(F.replace(take(p, type_), F.lit(" "), F.lit(""))).alias("new_type")))
        for kind, p, c, name, type_ in _CHANGES
    ]
    last = F.expr("array_join(slice(split(change.dataset, '[.]'), greatest(size(split(change.dataset, '[.]')) - 1, 1), 2), '.')")
    return s.withColumn("change", F.coalesce(*found)).where("change is not null").select(*_KEY, last.alias("dataset"), F.expr("element_at(split(change.column, '[.]'), -1)").alias("column"), "change.change_type", "change.new_name", "change.new_type")
