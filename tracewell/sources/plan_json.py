"""Spark logical plans as JSON to lineage events (A03, E01-E13). Nested trees and Catalyst's flat lists."""

from __future__ import annotations

import json

#: Class names of writes, relations and projections.
WRITES = {"InsertIntoHadoopFsRelationCommand", "SaveIntoDataSourceCommand", "InsertIntoDataSourceCommand", "AppendData", "OverwriteByExpression"}
RELATIONS = {"LogicalRelation", "HiveTableRelation", "DataSourceV2Relation", "StreamingRelation"}
PROJECTS = {"Project": "projectList", "Aggregate": "aggregateExpressions", "Window": "windowExpressions"}


def kind(node: dict) -> str:
    return str(node.get("class") or node.get("type") or "").rsplit(".", 1)[-1]


def nested(plan) -> dict:
    """A tree of a flat pre-order list with ``num-children``; lists within nodes are trees of their own."""
    if isinstance(plan, str):
        plan = json.loads(plan)
    if isinstance(plan, dict):
        return plan
    at = iter(plan)

    def build() -> dict:
        node = dict(next(at))
        for k, v in node.items():
            if isinstance(v, list) and v and isinstance(v[0], list):
                node[k] = [nested(x) for x in v]
        node["children"] = [build() for _ in range(node.pop("num-children", 0))]
        return node

    return build()


def _children(node: dict) -> list[dict]:
    return [*(node.get("children") or []), *([node["child"]] if isinstance(node.get("child"), dict) else [])]


def _attributes(e: dict) -> list[dict]:
    if kind(e) == "AttributeReference":
        return [e]
    return [a for c in _children(e) for a in _attributes(c)]


def _text(e: dict) -> str:
    """E10."""
    if kind(e) in ("AttributeReference", "Literal"):
        return str(e.get("name") if kind(e) == "AttributeReference" else e.get("value"))
    return f"{kind(e)}({', '.join(_text(c) for c in _children(e))})"


def relation_name(node: dict) -> str | None:
    """The table's identifier, or the first qualifier of its output."""
    for at in ("tableMeta", "catalogTable"):
        ident = (node.get(at) or {}).get("identifier") if isinstance(node.get(at), dict) else None
        if ident and ident.get("table"):
            return ".".join(x for x in (ident.get("database"), ident["table"]) if x)
    for a in node.get("output") or []:
        if isinstance(a, dict) and a.get("qualifier"):
            q = a["qualifier"]
            return ".".join(q[-2:]) if isinstance(q, list) else str(q)
    return None


def target_name(node: dict) -> str:
    """Path, then options, then identifier; an empty part is passed over."""
    path = node.get("outputPath") or node.get("path")
    if path:
        return str(path).rstrip("/").rsplit("/", 1)[-1]
    options = node.get("options") or {}
    if isinstance(options, dict) and (options.get("dbtable") or options.get("path")):
        return str(options.get("dbtable") or str(options["path"]).rstrip("/").rsplit("/", 1)[-1])
    parts = (node.get("tableIdent") or {}).get("multipartIdentifier") if isinstance(node.get("tableIdent"), dict) else None
    return ".".join(parts[-2:]) if parts else "unknown"


def _resolve(node: dict, sources: list[str], semantics: str) -> tuple[dict, list]:
    """(name or expression id -> base columns, derivations by target) of a subtree."""
    if kind(node) in RELATIONS:
        name = relation_name(node) or "unknown"
        if name not in sources:
            sources.append(name)
        known = {}
        for a in node.get("output") or []:
            if isinstance(a, dict):
                known |= {k: [(name, a["name"])] for k in _keys(a)}
        return known, []
    known: dict = {}
    found: list = []
    for c in node.get("children") or []:
        k, f = _resolve(c, sources, semantics)
        for key, v in k.items():
            known.setdefault(key, v)
        found += f
    if kind(node) in PROJECTS:
        items = node.get(PROJECTS[kind(node)]) or []
        if semantics == "as_implemented" and kind(node) == "Window":
            items = []
        own, derived = {}, []
        for e in items:
            if kind(e) not in ("Alias", "AttributeReference"):
                continue
            inner = (_children(e) or [e])[0] if kind(e) == "Alias" else e
            refs = _attributes(inner)
            if not refs:
                continue
            base = lambda a: next((known[k] for k in _keys(a) if k in known), [((".".join(a["qualifier"][-2:]) if a.get("qualifier") else sources[0] if sources else "unknown"), a["name"])])
            if semantics == "as_implemented":
                src = [(sources[0] if sources else "unknown", refs[0]["name"])]
            else:
                src = list(dict.fromkeys(s for a in refs for s in base(a)))
            bare = kind(inner) == "AttributeReference"
            through = bare and inner["name"] == e.get("name")
            derived.append((e.get("name"), src, None if bare else _text(inner), through))
            own |= {k: src for k in _keys(e)}
        found = [*found, *derived] if semantics == "as_implemented" else derived
        known = own if kind(node) != "Window" else known | own
        if kind(node) == "Window" and semantics != "as_implemented":
            found = [*found]
    return known, found


def _keys(a: dict) -> list:
    e = a.get("exprId")
    out = [("id", e.get("id"), e.get("jvmId"))] if isinstance(e, dict) else []
    return [*out, ("name", a.get("name"))]


def extract(plan, project: str, pipeline: str = "spark_job", job_id: str = "unknown", commit: str | None = None, semantics: str = "documented") -> list[dict]:
    """An event for each topmost write. documented resolves each column to its own relation, by
    expression id where there is one; as_implemented takes the first source and the first reference."""
    out: list[dict] = []

    def visit(node: dict) -> None:
        if kind(node) in WRITES:
            target, sources = target_name(node), []
            parts = [_resolve(c, sources, semantics)[1] for c in [*(node.get("children") or []), *([node["query"]] if isinstance(node.get("query"), dict) else [])]]
            ref = lambda d, c: {"dataset": d, "column": c, "warehouse": "generic"}
            derived = [{"source": ref(*s), "target": ref(target, n), "expression": x, "is_passthrough": t} for f in parts for n, src, x, t in f for s in src]
            out.append({"event_id": f"{job_id}_{target}@{commit}", "source_type": "spark", "project_name": project, "commit_id": commit, "transform_id": f"{job_id}_{target}", "transform_name": target, "pipeline_name": pipeline, "source_datasets": sources, "target_datasets": [target], "column_derivations": derived, "raw_sql": None, "tags": None, "llm_inferred": False, "validation_status": "ok"})
            return
        for c in node.get("children") or []:
            visit(c)

    visit(nested(plan))
    return out
