"""Questions in words, graph patterns, and their validation."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.model import LABELS, RELATIONSHIPS
from tracewell.operators import catalog as C
from tracewell.operators.traverse import bfs, hops
from tracewell.sources.sql_lineage import _kind, _list

#: Fixed values of the service: suggested questions, words that write, labels a query may name.
SUGGESTIONS = [
    "Show every pipeline that writes to a table used by the revenue dashboard",
    "Which ML features would be affected if I drop user_events.session_id?",
    "Find all datasets with no documented owner and more than 5 downstream dependencies",
    "What does orders.customer_id flow into?",
    "List all dbt models that read from the raw_events source",
    "Which transforms have LLM-inferred lineage flagged for review?",
    "Find columns derived from more than 3 source columns",
    "What Kafka topics feed into the user_features ML feature?",
    "How many P0 dashboards depend on the payments pipeline?",
    "Show the full lineage graph for the mrr_monthly table",
]
WRITING = ["CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP"]
ALLOWED = [*LABELS, "Snapshot"]
#: Fixed values of the service: properties that a query may name, by label.
PROPERTIES = {
    "Dataset": ["name", "project", "source_type", "created_at", "last_seen_at", "commit_id"],
    "Column": ["name", "dataset", "project", "created_at", "last_seen_at"],
    "Transform": ["transform_id", "name", "project", "pipeline_name", "source_type", "llm_inferred", "raw_sql", "commit_id"],
    "Pipeline": ["name", "project", "source_type"],
    "Dashboard": ["name", "sla_tier", "freshness_cadence", "owner"],
    "MLFeature": ["name", "project", "sla_tier", "freshness_cadence"],
}


class Translator(Protocol):
    """Turns a question into a DataFrame of the graph; a language model may stand here."""

    def __call__(self, question: str, nodes: DataFrame, edges: DataFrame) -> DataFrame | None: ...


def strip_fences(text: str) -> str:
    """J02."""
    return "\n".join(x for x in text.strip().split("\n") if not x.strip().startswith("```")).strip()


def suggested(shown: int = 6) -> list[str]:
    """The suggestions that are shown."""
    return SUGGESTIONS[:shown]


def unknown_properties(query: str) -> list[str]:
    """Errors for properties that the label of their node doesn't have, in the node's braces or after
    its variable. Nodes without a label and labels without a list may have any."""
    bare = re.sub(r"'[^']*'|\"[^\"]*\"", "''", query)
    named = re.findall(r"\(\s*(\w*)\s*:\s*(\w+)\s*(?:\{([^}]*)\})?", bare)
    used = [(label, p) for _, label, props in named for p in re.findall(r"(\w+)\s*:", props)]
    used += [(label, p) for var, label, _ in named if var for p in re.findall(rf"(?<![\w.]){var}\.(\w+)", bare)]
    return [f"unknown property: {label}.{p}" for label, p in sorted(set(used)) if p not in PROPERTIES.get(label, [p])]


def validate(query: str, semantics: str = "documented", properties: bool = False) -> list[str]:
    """Everything that is wrong with a query; nothing: it may run. With ``properties`` also J10.

    as_implemented looks at labels and types as its patterns find them; documented reads the node and
    relationship patterns themselves, so that ``count(DISTINCT x)`` is no label and ``(t:Table)`` is."""
    text = query.strip()
    if len(text) < 5:
        return ["query is empty or too short"]
    errors = []
    if semantics == "as_implemented":
        labels = [x for x in re.findall(r"\(:?(\w+)", text) if x[0].isupper() and x not in ALLOWED]
        types = re.findall(r"\[:(\w+)", text)
    else:
        bare = re.sub(r"'[^']*'|\"[^\"]*\"", "''", text)
        labels = [y for x in re.findall(r"\(\s*\w*\s*((?::\s*\w+\s*)+)", bare) for y in re.findall(r"\w+", x) if y not in ALLOWED]
        types = [y for x in re.findall(r"\[\s*\w*\s*:\s*([\w|:\s]+)", bare) for y in re.findall(r"\w+", x)]
        text = bare
    errors += [f"unknown label: {x}" for x in sorted(set(labels))]
    errors += [f"unknown relationship: {x}" for x in sorted(set(types)) if x not in RELATIONSHIPS]
    errors += [f"writing is not allowed: {w}" for w in WRITING if re.search(rf"\b{w}\b", text, re.I)]
    return errors + unknown_properties(query) if properties else errors


def validated(queries: DataFrame, column: str = "query") -> DataFrame:
    """The as-implemented checks over a table of queries: an array of errors for each."""
    label = F.filter(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\(:?([A-Z]\w*)"), 1)), lambda x: ~x.isin(*ALLOWED))
    kinds = F.filter(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\[:(\w+)"), 1)), lambda x: ~x.isin(*RELATIONSHIPS))
    words = F.array_compact(F.array(*[F.when(F.col(column).rlike(rf"(?i)\b{w}\b"), F.lit(f"writing is not allowed: {w}")) for w in WRITING]))
    whole = F.concat(F.transform(F.array_sort(label), lambda x: F.concat(F.lit("unknown label: "), x)), F.transform(F.array_sort(kinds), lambda x: F.concat(F.lit("unknown relationship: "), x)), words)
    return queries.withColumn("validation_errors", F.when(F.length(F.trim(column)) < 5, F.array(F.lit("query is empty or too short"))).otherwise(whole))


def _node(nodes, label, name):
    return nodes.where((F.col("label") == label) & (F.lower("name").isin(name.lower()) | F.lower("name").endswith("." + name.lower()))).select("node_id")


def _with(nodes, reach, label):
    return reach.join(nodes.where(F.col("label") == label), "node_id").select("name", "dataset", "level")


def _rules() -> list[tuple[str, Callable]]:
    word = r"([\w.\-]+)"
    flow = lambda e: hops(e, ["READS_FROM"], "in").unionAll(hops(e, ["WRITES_TO", "PRODUCES"])).unionAll(hops(e, ["DERIVES_FROM"], "in"))
    return [
        (rf"ml features.*(?:depend on|affected).*?\b(?:the )?{word} table", lambda n, e, m: _with(n, bfs(flow(e), _node(n, "Dataset", m[1]), 8), "MLFeature")),
        (rf"ml features.*drop {word}\.{word}\?", lambda n, e, m: _with(n, bfs(flow(e).unionAll(hops(e, ["PART_OF"])), n.where((F.col("label") == "Column") & (F.col("dataset").endswith(m[1])) & (F.col("name") == m[2])).select("node_id"), 8), "MLFeature")),
        (rf"dbt models in the {word} project", lambda n, e, m: n.where((F.col("label") == "Transform") & (F.col("source_type") == "dbt") & ((F.col("project") == m[1]) | (F.col("pipeline_name") == m[1]))).select("name", "project")),
        (rf"dbt models that read from the {word}", lambda n, e, m: C.models_reading(n, e, m[1])),
        (rf"does the {word} transform write", lambda n, e, m: _with(n, bfs(hops(e, ["WRITES_TO"]), n.where((F.col("label") == "Transform") & F.col("name").isin(m[1])).select("node_id").unionAll(n.where((F.col("label") == "Transform") & F.col("transform_id").startswith(m[1])).select("node_id")), 1), "Dataset")),
        (r"all (p\d) dashboards", lambda n, e, m: C.tier_dashboards(n, e, m[1].upper())),
        (rf"p0 dashboards depend on the {word} pipeline", lambda n, e, m: C.pipeline_dashboards(n, e).where(F.col("pipeline") == m[1])),
        (rf"sources does the {word} table depend", lambda n, e, m: _with(n, bfs(hops(e, ["WRITES_TO"], "in").unionAll(hops(e, ["READS_FROM"])), _node(n, "Dataset", m[1]), 8), "Dataset")),
        (r"transforms (?:use|have) llm-inferred", lambda n, e, m: C.inferred_transforms(n, "flagged" in m.string)),
        (rf"columns does {word} expose", lambda n, e, m: n.where((F.col("label") == "Column") & (F.col("dataset") == m[1])).select("name", "dataset")),
        (r"all kafka topics", lambda n, e, m: n.where("label = 'Dataset' and source_type = 'kafka'").select("name", "project")),
        (rf"kafka topics feed into the {word}", lambda n, e, m: _with(n, bfs(hops(e, ["WRITES_TO", "PRODUCES"], "in").unionAll(hops(e, ["READS_FROM"])), _node(n, "MLFeature", m[1]), 8), "Dataset")),
        (rf"pipelines .* (?:in|the) the {word} project|pipelines are tracked in the {word} project", lambda n, e, m: n.where((F.col("label") == "Pipeline") & ((F.col("project") == (m[1] or m[2])) | (F.col("name") == (m[1] or m[2])))).select("name", "project")),
        (rf"columns that are derived from {word}", lambda n, e, m: _with(n, bfs(hops(e, ["DERIVES_FROM"], "in"), n.where((F.col("label") == "Column") & (F.col("name") == m[1])).select("node_id"), 6), "Column")),
        (r"columns derived from more than (\d+)", lambda n, e, m: C.many_sources(n, e, int(m[1]))),
        (rf"does {word}\.{word} flow into", lambda n, e, m: _with(n, bfs(hops(e, ["DERIVES_FROM"], "in"), n.where((F.col("label") == "Column") & F.col("dataset").endswith(m[1]) & (F.col("name") == m[2])).select("node_id"), 5), "Column")),
        (r"no (?:documented )?owner .*more than (\d+)", lambda n, e, m: C.orphans(n, e, int(m[1]) + 1)),
        (r"datasets have no owner", lambda n, e, m: n.where((F.col("label") == "Dataset") & (F.coalesce("owner", F.lit("")) == "")).select("name", "project")),
        (r"how many transforms|count .*transforms .*each project", lambda n, e, m: C.transforms_per_project(n)),
        (rf"path from {word} to {word}", lambda n, e, m: bfs(flow(e), _node(n, "Dataset", m[1]), 8).join(_node(n, "Dataset", m[2]), "node_id", "left_semi")),
        (r"transforms read from more than (\w+) source", lambda n, e, m: C.wide_transforms(n, e, {"one": 1, "two": 2, "three": 3}.get(m[1]) or int(m[1]))),
        (rf"transforms .*part of the {word} pipeline", lambda n, e, m: n.where((F.col("label") == "Transform") & (F.col("pipeline_name") == m[1])).select("name", "pipeline_name")),
        (rf"pipeline that writes to a table used by the {word}", lambda n, e, m: C.shared_datasets(n, e, m[1] if "_" in m[1] else m[1] + "_dashboard")),
        (rf"lineage graph for the {word} table", lambda n, e, m: bfs(hops(e, ["READS_FROM", "WRITES_TO", "DERIVES_FROM"], "both"), _node(n, "Dataset", m[1]), 4).join(n.select("node_id", "label", "name"), "node_id").orderBy("level", "node_id").limit(100)),
    ]


def translate(question: str, nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """The deterministic translator: the questions of the suggestions and of the evaluation; None for others."""
    text = question.strip().lower()
    for pattern, build in _rules():
        m = re.search(pattern, text)
        if m:
            return build(nodes, edges, m)
    return None


def ask(question: str, nodes: DataFrame, edges: DataFrame, max_results: int = 100, translator: Translator = translate) -> dict:
    """The rows of a question, or why there are none. The limit is part of the query."""
    df = translator(question, nodes, edges) if len(question.strip()) >= 5 else None
    if df is None:
        return {"validated": False, "errors": ["the question isn't understood"], "rows": None}
    return {"validated": True, "errors": [], "rows": df.limit(max_results)}


#: Functions that a raw query may call; they compute on their arguments and reach nothing else.
_FUNCTIONS = set(
    """abs acos aggregate any any_value between mod div cube rollup grouping_sets approx_count_distinct array array_agg array_append array_compact array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove
    array_repeat array_size array_sort array_union arrays_overlap arrays_zip ascii asin atan avg bit_count bool_and bool_or bround btrim cardinality cbrt ceil ceiling char char_length coalesce collect_list collect_set concat concat_ws
    contains corr cos count count_if crc32 cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear decode degrees dense_rank element_at
    endswith every exists exp explode explode_outer extract filter find_in_set first first_value flatten floor forall format_number from_json get get_json_object greatest grouping grouping_id hash hex hour if ifnull ilike initcap inline
    instr isnan isnotnull isnull json_array_length kurtosis lag last last_day last_value lcase lead least left len length levenshtein like ln locate log log10 log2 lower lpad ltrim make_date map map_entries map_filter map_from_arrays
    map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct next_day now nth_value ntile nullif nvl nvl2 overlay parse_json percent_rank percentile percentile_approx pi pmod posexplode
    position pow power quarter radians rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rint rlike round row_number rpad rtrim second sequence sha sha1 sha2 sign signum sin size
    slice some sort_array split split_part sqrt stack startswith std stddev stddev_pop stddev_samp str_to_map struct substr substring substring_index sum tan to_date to_json to_timestamp transform translate trim trunc try_add try_divide
    try_element_at try_to_number typeof ucase unhex unix_timestamp upper var_pop var_samp variance weekday weekofyear width_bucket xxhash64 year zip_with""".split()
)


def raw_query(spark: SparkSession, query: str, params: dict | None = None, **views: DataFrame) -> DataFrame:
    """Read-only SQL over the views; ValueError if empty, PermissionError if it isn't a query, reads
    what isn't one of the views (files by path included), calls a function that isn't listed, or holds a
    node or an expression of a kind that isn't listed: what is new or unknown is refused."""
    if not query.strip():
        raise ValueError("the query is empty")
    text = query.strip().rstrip(";")
    _only_reads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), {v.lower() for v in views})
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params or {})


def _only_reads(plan, allowed: set[str]) -> None:
    """Walks the nodes, expressions and subqueries of an unresolved plan."""
    kind = _kind(plan)
    if kind == "UnresolvedWith":
        for r in _list(plan.cteRelations()):
            _only_reads(r._2().child(), allowed | ({r._1().lower()} if plan.allowRecursion() else set()))
            allowed = allowed | {r._1().lower()}
    elif kind == "UnresolvedRelation":
        parts = _list(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in allowed:
            raise PermissionError(f"{'.'.join(parts)} is none of the views")
    elif kind not in _READS:
        raise PermissionError(f"only reading is allowed, no {kind}")
    for e in _list(plan.expressions()):
        _only_values(e, allowed)
    for c in _list(plan.children()):
        _only_reads(c, allowed)


#: Nodes of the plans of queries.
_READS = {
    "Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "Join", "LateralJoin", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "UnresolvedInlineTable",
    "LocalRelation", "OneRowRelation", "WithWindowDefinition", "Generate", "Pivot", "Unpivot", "Sample", "UnresolvedOrderBy", "UnresolvedOrderByAll", "Expand", "RepartitionByExpression", "UnresolvedHint",
}
#: Expressions of a query as it is parsed.
_VALUES = {
    "UnresolvedAttribute", "AttributeReference", "UnresolvedStar", "UnresolvedFunction", "UnresolvedAlias", "UnresolvedGenerator", "UnresolvedExtractValue", "UnresolvedOrdinal", "Alias", "MultiAlias", "Literal", "Cast", "NamedParameter", "PosParameter", "EqualTo", "EqualNullSafe",
    "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Not", "And", "Or", "In", "InSubquery", "IsNull", "IsNotNull", "IsTrue", "IsUnknown", "Like", "LikeAll", "LikeAny", "ILike", "RLike", "Between", "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive",
    "BitwiseAnd", "BitwiseOr", "BitwiseXor", "BitwiseNot", "CaseWhen", "If", "Exists", "ScalarSubquery", "ListQuery", "LateralSubquery", "SortOrder", "WindowExpression", "UnresolvedWindowExpression", "WindowSpecDefinition", "WindowSpecReference", "SpecifiedWindowFrame", "UnspecifiedFrame",
    "UnboundedPreceding", "UnboundedFollowing", "CurrentRow", "LambdaFunction", "UnresolvedNamedLambdaVariable", "CreateNamedStruct", "CreateStruct", "Concat", "Substring", "StringTrim", "StringTrimLeft", "StringTrimRight", "CurrentDate", "CurrentTimestamp", "Cube", "Rollup", "GroupingSets", "AggregateExpression", "FilterExpression",
}
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


def _only_values(e, allowed: set[str]) -> None:
    kind = _kind(e)
    if kind not in _VALUES:
        raise PermissionError(f"{kind} is not allowed")
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = [x.lower() for x in (_list(e.nameParts()) if kind == "UnresolvedFunction" else [e.name().funcName()])]
        if len(name) != 1 or name[0] not in _FUNCTIONS:
            raise PermissionError(f"the function {'.'.join(name)} may not be called")
    if kind in _SUBQUERIES:
        _only_reads(e.plan(), allowed)
    for c in _list(e.children()):
        _only_values(c, allowed)


_STEP = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)|(<)?-\[\s*\w*\s*(?::\s*([\w|]+))?\s*(?:\*(\d+)?\.\.(\d+))?\s*\]-(>)?")


def pattern(query: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A subset of graph patterns: MATCH of one chain of nodes and relationships, also of variable
    length, WHERE with equalities joined by AND, RETURN [DISTINCT] of properties and of
    count(DISTINCT x), ORDER BY and LIMIT. Raises ValueError for what it can't read or mustn't run."""
    errors = validate(query)
    if errors:
        raise ValueError("; ".join(errors))
    m = re.fullmatch(r"\s*MATCH\s+(.*?)(?:\s+WHERE\s+(.*?))?\s+RETURN\s+(DISTINCT\s+)?(.*?)(?:\s+ORDER\s+BY\s+(\w+)(\s+DESC)?)?(?:\s+LIMIT\s+(\d+))?\s*;?\s*", query, re.I | re.S)
    if not m:
        raise ValueError("can't read the query")
    chain, where, distinct, items, order, desc, limit = m.groups()
    df, last, rel, at, unnamed = None, None, None, 0, 0
    for s in _STEP.finditer(chain):
        if s.start() != at:
            raise ValueError(f"can't read {chain[at : s.start()]!r}")
        at = s.end()
        if s.group().startswith("("):
            var, label, props = s.group(1), s.group(2), s.group(3)
            unnamed += var is None
            var = var or f"_{unnamed}"
            own = nodes if label is None else nodes.where(F.col("label") == label)
            for k, v in re.findall(r"(\w+)\s*:\s*'([^']*)'", props or ""):
                own = own.where(F.col(k) == v)
            own = own.select(*[F.col(c).alias(f"{var}.{c}") for c in nodes.columns])
            if df is None:
                df = own
            else:
                left, kinds, low, high = rel
                pairs = hops(edges, kinds, "in" if left else "out").distinct()
                # Each step starts from the nodes that are bound, which are fewer than all pairs.
                steps = [df.select(F.col(f"`{last}.node_id`").alias("_a")).distinct().join(pairs.toDF("_a", "_b"), "_a")]
                for _ in range(high - 1):
                    steps.append(steps[-1].join(pairs.toDF("_b", "_c"), "_b").select("_a", F.col("_c").alias("_b")).distinct())
                met = steps[low - 1]
                for x in steps[low:]:
                    met = met.unionAll(x)
                df = df.join(met.distinct(), F.col(f"`{last}.node_id`") == F.col("_a")).join(own, F.col("_b") == F.col(f"`{var}.node_id`")).drop("_a", "_b")
            last = var
        else:
            rel = (bool(s.group(4)), s.group(5).split("|") if s.group(5) else None, int(s.group(6) or 1), int(s.group(7) or s.group(6) or 1))
    if df is None or at != len(chain.rstrip()):
        raise ValueError("can't read the pattern")
    for cond in re.split(r"\s+AND\s+", where, flags=re.I) if where else []:
        c = re.fullmatch(r"\s*(\w+\.\w+)\s*(?:=\s*(?:'([^']*)'|(true|false))|(IS\s+(?:NOT\s+)?NULL))\s*", cond, re.I)
        if not c:
            raise ValueError(f"can't read {cond!r}")
        col = F.col(f"`{c[1]}`")
        df = df.where((col.isNotNull() if "NOT" in c[4].upper() else col.isNull()) if c[4] else col == (c[2] if c[2] is not None else c[3].lower() == "true"))
    keys, aggs = [], []
    for item in items.split(","):
        i = re.fullmatch(r"\s*(?:(\w+\.\w+)|count\(\s*(DISTINCT\s+)?(\w+)\s*\))(?:\s+AS\s+(\w+))?\s*", item, re.I)
        if not i:
            raise ValueError(f"can't read {item!r}")
        if i[1]:
            keys.append(F.col(f"`{i[1]}`").alias(i[4] or i[1].replace(".", "_")))
        else:
            aggs.append((F.count_distinct if i[2] else F.count)(F.col(f"`{i[3]}.node_id`")).alias(i[4] or f"count_{i[3]}"))
    df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys)
    df = df.distinct() if distinct and not aggs else df
    df = df.orderBy(F.desc(order) if desc else F.asc(order)) if order else df
    return df.limit(int(limit)) if limit else df


def evaluate(questions: list[dict], nodes: DataFrame, edges: DataFrame, translator: Translator = translate) -> dict:
    """A question passes if it is understood, has the least number of rows, and each expected
    value stands within some value of the rows."""
    results = []
    for q in questions:
        got = ask(q["question"], nodes, edges, translator=translator)
        rows = got["rows"].collect() if got["validated"] else []
        said = {str(v).lower() for r in rows for v in r if v is not None}
        missing = [x for x in q["expected_result_contains"] if not any(x.lower() in s for s in said)]
        results.append({"question": q["question"], "passed": got["validated"] and not missing and len(rows) >= q["expected_min_results"], "missing": missing, "rows": len(rows)})
    return {"accuracy": sum(r["passed"] for r in results) / max(1, len(results)), "passed": sum(r["passed"] for r in results), "total": len(results), "results": results}


def questions(spark: SparkSession, path: str) -> list[dict]:
    """A10: the questions of an evaluation, a JSON array of objects; without expectations any rows will do."""
    rows = spark.read.schema("question string, expected_result_contains array<string>, expected_min_results int").json(path, multiLine=True)
    return [{"question": r[0] or "", "expected_result_contains": r[1] or [], "expected_min_results": r[2] or 0} for r in rows.collect()]


def save_evaluation(spark: SparkSession, result: dict, path: str) -> None:
    """The result of an evaluation as one JSON row, in place of an earlier one."""
    schema = "accuracy double, passed long, total long, results array<struct<question:string,passed:boolean,missing:array<string>,rows:long>>"
    spark.createDataFrame([result], schema).coalesce(1).write.mode("overwrite").json(path)
