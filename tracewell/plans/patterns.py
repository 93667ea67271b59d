"""Graph patterns as joins (J09, G15-G19): several chains, OPTIONAL MATCH, WHERE, EXISTS, WITH, RETURN.

A query's variables are columns of binding tables. Chains that share a variable extend one table, one join
with the edges for each step, from the end that is bound; chains that share none stay tables of their own
until a later chain or an EXISTS joins them, so nothing is multiplied out. OPTIONAL MATCH is a left join,
EXISTS a semi or anti join (a flag within OR), WITH a grouped table. A variable carries only the
properties that the query names.

A step of variable length gives a row for each pair of ends and each length, not for each path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.traverse import hops
from tracewell.plans.nlq import validate

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"[^\"]*\")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(<=|>=|<>|\.\.|->|<-|[-()\[\]{}:,.=<>*|;$]))")


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:].strip()[:20]!r}")
        out.append(next(g for g in m.groups() if g is not None))
        at = m.end()
    return [t for t in out if t != ";"]


@dataclass
class Node:
    var: str
    label: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Step:
    kinds: list[str] | None
    low: int
    high: int
    way: str
    path: str | None = None


class Reader:
    """Reads tokens from left to right; raises ValueError at what it doesn't know."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at, self.unnamed = tokens, 0, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        """Takes the words, if they are next, whatever their case."""
        if [self.peek(k).upper() for k in range(len(words))] == list(words):
            self.at += len(words)
            return True
        return False

    def take(self, token: str | None = None) -> str:
        found = self.peek()
        if not found or (token is not None and found != token):
            raise ValueError(f"expected {token or 'more'}, found {found or 'the end'}")
        self.at += 1
        return found

    def value(self):
        t = self.take()
        if t[0] in "'\"":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if t[0].isdigit():
            return float(t) if "." in t else int(t)
        if t.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[t.lower()]
        raise ValueError(f"{t} is no value")

    def node(self) -> Node:
        self.take("(")
        self.unnamed += 1
        n = Node(self.take() if re.match(r"[A-Za-z_]", self.peek()) else f"_{id(self)}_{self.unnamed}")
        if self.word(":"):
            n.label = self.take()
        if self.word("{"):
            while not self.word("}"):
                key = self.take()
                self.take(":")
                n.props[key] = self.value()
                self.word(",")
        self.take(")")
        return n

    def step(self) -> Step:
        back = self.word("<-") or not self.take("-")
        kinds, low, high = None, 1, 1
        if self.word("["):
            if re.match(r"[A-Za-z_]", self.peek()):
                self.take()
            if self.word(":"):
                kinds = [self.take()]
                while self.word("|"):
                    self.word(":")
                    kinds.append(self.take())
            if self.word("*"):
                low = self.value() if self.peek().isdigit() else 1
                high = self.value() if self.word("..") else low if self.tokens[self.at - 1] != "*" else 8
            self.take("]")
        ahead = self.word("->") or not self.take("-")
        if not 1 <= low <= high <= 8:
            raise ValueError("a step has one to eight hops")
        return Step(kinds, low, high, "in" if back else "out" if ahead else "both")

    def chain(self) -> tuple[list[Node], list[Step]]:
        path = None
        if self.peek(1) == "=":
            path = self.take()
            self.take("=")
        nodes, steps = [self.node()], []
        while self.peek() in ("-", "<-"):
            steps.append(self.step())
            nodes.append(self.node())
        for s in steps:
            s.path = path
        return nodes, steps

    def chains(self) -> list:
        out = [self.chain()]
        while self.word(","):
            out.append(self.chain())
        return out

    # Conditions are trees: (operator, parts).
    def condition(self):
        left = self._and()
        while self.word("OR"):
            left = ("or", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while self.word("AND"):
            left = ("and", left, self._not())
        return left

    def _not(self):
        if self.word("NOT"):
            return ("not", self._not())
        if self.word("EXISTS"):
            self.take("{")
            self.word("MATCH")
            chains = self.chains()
            where = self.condition() if self.word("WHERE") else None
            self.take("}")
            return ("exists", chains, where)
        if self.word("("):
            inner = self.condition()
            self.take(")")
            return inner
        if self.peek(1) == ":":
            var = self.take()
            self.take(":")
            return ("label", var, self.take())
        left = self.operand()
        if self.word("IS", "NOT", "NULL"):
            return ("not", ("null", left))
        if self.word("IS", "NULL"):
            return ("null", left)
        for words, name in ((("STARTS", "WITH"), "startswith"), (("ENDS", "WITH"), "endswith"), (("CONTAINS",), "contains")):
            if self.word(*words):
                return (name, left, self.operand())
        if self.word("IN"):
            self.take("[")
            values = [self.value()]
            while self.word(","):
                values.append(self.value())
            self.take("]")
            return ("in", left, values)
        return (self.take(), left, self.operand())

    def operand(self):
        if re.match(r"[A-Za-z_]", self.peek()) and self.peek().lower() not in ("true", "false", "null"):
            name = self.take()
            if self.word("("):
                distinct = self.word("DISTINCT")
                inner = None if self.word("*") else self.operand()
                self.take(")")
                if name.lower() == "labels":
                    self.take("["), self.take("0"), self.take("]")
                return ("call", name.lower(), distinct, inner)
            return ("prop", name, self.take()) if self.word(".") else ("var", name)
        return ("value", self.value())

    def items(self) -> list[tuple]:
        out = []
        while True:
            start, what = self.at, self.operand()
            name = "".join(self.tokens[start : self.at])
            out.append((what, self.take() if self.word("AS") else re.sub(r"\W+", "_", name).strip("_")))
            if not self.word(","):
                return out


class Query:
    """The binding tables of a query over nodes and edges, clause by clause."""

    def __init__(self, text: str, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges, self.tokens = nodes, edges, _tokens(text)
        self.used: dict[str, set[str]] = {}
        for a, dot, b in zip(self.tokens, self.tokens[1:], self.tokens[2:], strict=False):
            if dot == "." and re.match(r"[A-Za-z_]\w*$", a) and b in nodes.columns:
                self.used.setdefault(a, set()).add(b)
        self.tables: list[DataFrame] = []
        self.flags = 0

    def scan(self, n: Node) -> DataFrame:
        own = self.nodes
        for key, value in [("label", n.label), *n.props.items()]:
            if value is not None:
                own = own.where(F.col(key) == value)
        return own.select(F.col("node_id").alias(n.var), F.col("label").alias(f"{n.var}.label"), *[F.col(c).alias(f"{n.var}.{c}") for c in sorted(self.used.get(n.var, set()) - {"label"})])

    @staticmethod
    def _holder(tables: list[DataFrame], var: str) -> int | None:
        return next((k for k, t in enumerate(tables) if var in t.columns), None)

    def _narrowed(self, table: DataFrame, n: Node) -> DataFrame:
        """A bound variable that stands again with a label or properties."""
        if not n.label and not n.props:
            return table
        own = self.scan(Node(n.var, n.label, n.props)).select(n.var)
        return table.join(own, n.var, "left_semi")

    def _pairs(self, s: Step, starts: DataFrame | None, way: str) -> DataFrame:
        """(_a, _b, hops) of a step, from the starts (column _a) if the ends of several hops are asked for."""
        one = hops(self.edges, s.kinds, way).distinct().toDF("_a", "_b")
        if s.high == 1:
            return one.withColumn("hops", F.lit(1))
        now, parts = starts.join(one, "_a"), []
        for k in range(1, s.high + 1):
            if k > 1:
                now = now.withColumnRenamed("_b", "_m").join(one.toDF("_m", "_b"), "_m").select("_a", "_b").distinct()
            if k >= s.low:
                parts.append(now.withColumn("hops", F.lit(k)))
        return reduce(DataFrame.unionAll, parts)

    def match(self, chains: list, tables: list[DataFrame]) -> list[DataFrame]:
        for nodes, steps in chains:
            todo = list(zip(nodes, steps, nodes[1:], strict=False))
            for n in nodes:
                k = self._holder(tables, n.var)
                if k is not None:
                    tables[k] = self._narrowed(tables[k], n)
            if not steps and self._holder(tables, nodes[0].var) is None:
                tables = [*tables, self.scan(nodes[0])]
            while todo:
                bound = [t for t in todo if self._holder(tables, t[0].var) is not None or self._holder(tables, t[2].var) is not None]
                if not bound:
                    # The end that says most about itself begins.
                    n = max((todo[0][0], todo[-1][2]), key=lambda n: (len(n.props), n.label is not None))
                    tables = [*tables, self.scan(n)]
                    continue
                left, s, right = t = bound[0]
                todo.remove(t)
                if self._holder(tables, left.var) is None:
                    left, right, way = right, left, {"in": "out", "out": "in", "both": "both"}[s.way]
                else:
                    way = s.way
                a, b = self._holder(tables, left.var), self._holder(tables, right.var)
                pairs = self._pairs(s, tables[a].select(F.col(f"`{left.var}`").alias("_a")).distinct(), way)
                # Of a path of several steps the lengths add up.
                pairs = pairs.withColumnsRenamed({"_a": left.var, "_b": right.var, "hops": "_hops"}) if s.path else pairs.drop("hops").distinct().withColumnsRenamed({"_a": left.var, "_b": right.var})
                if b is None:
                    table = tables[a].join(pairs, left.var).join(self.scan(right), right.var)
                elif a == b:
                    table = tables[a].join(pairs, [left.var, right.var])
                else:
                    table = tables[a].join(pairs, left.var).join(tables[b], right.var)
                if s.path:
                    total = F.col("_hops") + (F.col(f"{s.path}_length") if f"{s.path}_length" in table.columns else 0)
                    table = table.withColumn(f"{s.path}_length", total).drop("_hops")
                tables = [t for k, t in enumerate(tables) if k not in (a, b)] + [table]
            if steps and steps[0].path:
                k = self._holder(tables, nodes[0].var)
                tables[k] = tables[k].withColumn(steps[0].path, F.array(F.col(f"`{nodes[0].var}`"), F.col(f"`{nodes[-1].var}`")))
        return tables

    def optional(self, chains: list, where) -> None:
        found = self.match(chains, [])
        table = self.joined(found, where)
        shared = [v for v in self._variables(chains) if self._holder(self.tables, v) is not None]
        k = {self._holder(self.tables, v) for v in shared}
        if len(k) != 1:
            raise ValueError("an optional match shares the variables of one match")
        at = k.pop()
        own = table.select(*shared, *[F.col(f"`{c}`") for c in table.columns if c.split(".")[0] not in shared])
        self.tables[at] = self.tables[at].join(own, shared, "left")

    @staticmethod
    def _variables(chains: list) -> list[str]:
        return list(dict.fromkeys(n.var for nodes, _ in chains for n in nodes if not n.var.startswith("_")))

    def joined(self, tables: list[DataFrame], where) -> DataFrame:
        if len(tables) != 1:
            raise ValueError("the chains share no variable")
        return self.filtered(tables, where)[0] if where is not None else tables[0]

    def filtered(self, tables: list[DataFrame], where) -> list[DataFrame]:
        """Each part of an AND goes to the table that has its variables."""
        if where[0] == "and":
            return self.filtered(self.filtered(tables, where[1]), where[2])
        negated = where[0] == "not" and where[1][0] == "exists"
        if where[0] == "exists" or negated:
            _, chains, inner = where[1] if negated else where
            shared = [v for v in self._variables(chains) if self._holder(tables, v) is not None]
            found = self.joined(self.match(chains, []), inner).select(*shared).distinct()
            held = sorted({self._holder(tables, v) for v in shared})
            if len(held) == 1:
                tables[held[0]] = tables[held[0]].join(found, shared, "left_anti" if negated else "left_semi")
                return tables
            if negated or not held:
                raise ValueError("NOT EXISTS shares the variables of one match")
            table = found
            for k in held:
                table = table.join(tables[k], [v for v in shared if v in tables[k].columns])
            return [t for k, t in enumerate(tables) if k not in held] + [table]
        names = self._names(where)
        held = {self._holder(tables, v) for v in names}
        if len(held) != 1 or None in held:
            raise ValueError(f"{', '.join(sorted(names)) or 'the condition'}: no match has all of them")
        k = held.pop()
        table, made = self._flagged(tables[k], where)
        tables[k] = table.where(self._value(made)).select(*[F.col(f"`{c}`") for c in tables[k].columns])
        return tables

    def _names(self, c) -> set[str]:
        if c[0] in ("prop", "var", "label"):
            return {c[1]}
        if c[0] == "exists":
            return {v for v in self._variables(c[1]) if any(v in t.columns for t in self.tables)} or set(self._variables(c[1])[:1])
        return set().union(*[self._names(x) for x in c[1:] if isinstance(x, tuple)])

    def _flagged(self, table: DataFrame, c) -> tuple[DataFrame, tuple]:
        """The table with a flag for each EXISTS of a condition, and the condition with the flags in place."""
        if c[0] == "exists":
            self.flags += 1
            shared, flag = [v for v in self._variables(c[1]) if v in table.columns], f"_exists{self.flags}"
            found = self.joined(self.match(c[1], []), c[2]).select(*shared).distinct().withColumn(flag, F.lit(True))
            return table.join(found, shared, "left"), ("flag", flag)
        parts = []
        for x in c[1:]:
            if isinstance(x, tuple):
                table, x = self._flagged(table, x)
            parts.append(x)
        return table, (c[0], *parts)

    def _value(self, c) -> Column:
        kind, *parts = c
        if kind == "value":
            return F.lit(parts[0])
        if kind == "var":
            return F.col(f"`{parts[0]}`")
        if kind == "prop":
            return F.col(f"`{parts[0]}.{parts[1]}`")
        if kind == "label":
            return F.coalesce(F.col(f"`{parts[0]}.label`") == parts[1], F.lit(False))
        if kind == "flag":
            return F.col(parts[0]).isNotNull()
        if kind == "call":
            name, _, inner = parts
            if name == "labels":
                return F.col(f"`{inner[1]}.label`")
            if name == "length":
                return F.col(f"`{inner[1]}_length`")
            if name in ("tolower", "toupper"):
                return {"tolower": F.lower, "toupper": F.upper}[name](self._value(inner))
            raise ValueError(f"{name} is no function of a row")
        if kind in ("and", "or"):
            left, right = map(self._value, parts)
            return left & right if kind == "and" else left | right
        if kind == "not":
            return ~self._value(parts[0])
        if kind == "null":
            return self._value(parts[0]).isNull()
        left = self._value(parts[0])
        if kind == "in":
            return left.isin(*parts[1])
        right = self._value(parts[1])
        if kind in ("startswith", "endswith", "contains"):
            return getattr(left, kind)(right)
        made = {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}
        if kind not in made:
            raise ValueError(f"{kind} is no comparison")
        return made[kind]

    _SUMS = ("count", "collect", "min", "max", "sum", "avg")

    def _sum(self, call) -> Column:
        _, name, distinct, inner = call
        if inner is None:
            return F.count(F.lit(1))
        v = self._value(inner)
        if name == "count":
            return F.count_distinct(v) if distinct else F.count(v)
        if name == "collect":
            return F.array_sort(F.collect_set(v) if distinct else F.collect_list(v))
        return {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}[name](v)

    def _is_sum(self, what) -> bool:
        return what[0] == "call" and what[1] in self._SUMS

    def only(self) -> DataFrame:
        if len(self.tables) != 1:
            raise ValueError("the matches share no variable")
        return self.tables[0]

    def carry(self, items: list[tuple], where) -> None:
        """WITH: the named variables and values go on; sums are by the others."""
        table = self.only()
        keys = [c for what, name in items if what[0] == "var" for c in table.columns if c == what[1] or c.startswith(what[1] + ".")]
        made = [self._value(what).alias(name) for what, name in items if not self._is_sum(what) and what[0] != "var"]
        keep = [F.col(f"`{c}`") for c in keys] + made
        sums = [self._sum(what).alias(name) for what, name in items if self._is_sum(what)]
        self.tables = [table.groupBy(*keep).agg(*sums) if sums else table.select(*keep)]
        if where is not None:
            self.tables = self.filtered(self.tables, where)

    def give(self, distinct: bool, items: list[tuple], order: list[tuple], limit: int | None) -> DataFrame:
        table = self.only()
        keys = [self._value(what).alias(name) for what, name in items if not self._is_sum(what)]
        sums = [self._sum(what).alias(name) for what, name in items if self._is_sum(what)]
        names = {name for _, name in items}
        # A row may be ordered by what it doesn't return, unless rows have met.
        extra = [] if sums or distinct else [(f"_order{k}", what) for k, (what, _) in enumerate(order) if not (what[0] == "var" and what[1] in names)]
        if sums:
            out = table.groupBy(*keys).agg(*sums) if keys else table.agg(*sums)
        else:
            out = table.select(*keys, *[self._value(what).alias(c) for c, what in extra])
            out = out.distinct() if distinct else out
        said = {re.sub(r"\s", "", repr(what)): name for what, name in items}
        held = {repr(what): c for c, what in extra}
        by = []
        for what, desc in order:
            name = what[1] if what[0] == "var" and what[1] in names else said.get(re.sub(r"\s", "", repr(what))) or held.get(repr(what))
            if name is None:
                raise ValueError("rows are ordered by what they return")
            by.append(F.desc(name) if desc else F.asc(name))
        out = out.orderBy(*by) if by else out
        out = out.limit(limit) if limit is not None else out
        return out.select(*[name for _, name in items])


def graph_query(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of a read-only graph pattern; ValueError for what isn't allowed or can't be read.

    Columns are named by AS, or by the words of the item. A variable that is returned is its node id. Null
    properties satisfy no comparison; a path is its two ends, its length is length(path); a variable of an OPTIONAL MATCH that found nothing is null.
    """
    errors = validate(text)
    if errors:
        raise ValueError("; ".join(errors))
    q = Query(text, nodes, edges)
    r = Reader(q.tokens)
    while True:
        if r.word("OPTIONAL", "MATCH"):
            chains = r.chains()
            q.optional(chains, r.condition() if r.word("WHERE") else None)
        elif r.word("MATCH"):
            q.tables = q.match(r.chains(), q.tables)
            if r.word("WHERE"):
                q.tables = q.filtered(q.tables, r.condition())
        elif r.word("WITH"):
            items = r.items()
            q.carry(items, r.condition() if r.word("WHERE") else None)
        elif r.word("WHERE"):
            q.tables = q.filtered(q.tables, r.condition())
        elif r.word("RETURN"):
            distinct, items, order, limit = r.word("DISTINCT"), r.items(), [], None
            if r.word("ORDER", "BY"):
                while True:
                    what = r.operand()
                    order.append((what, r.word("DESC") or (r.word("ASC") and False)))
                    if not r.word(","):
                        break
            if r.word("LIMIT"):
                limit = r.value()
            if r.peek():
                raise ValueError(f"can't read {r.peek()!r}")
            return q.give(distinct, items, order, limit)
        else:
            raise ValueError(f"can't read {r.peek() or 'an empty query'!r}")
