"""Results as JSON objects and as text of bounded width."""

from __future__ import annotations

import json
import shutil
import textwrap
from collections.abc import Iterable

from .operators import audit as audit_op
from .operators import overview as overview_op
from .operators import related as related_op
from .operators import search as search_op
from .operators import symbols as symbols_op
from .operators.index import Index
from .schema import CATEGORIES, KIND_LABELS, LABELS, PROJECT_KINDS, REFERENCE_KINDS, REFERENCE_LABELS, SYMBOL_KINDS

WIDTH = 83


def label(category: str) -> str:
    return LABELS[CATEGORIES.index(category)]


def summary(index: Index) -> dict:
    one = index.summary().first()
    counts = {r.label: r.files for r in index.category_counts().orderBy("ordinal").collect()}
    return {"files": one.files, "symbols": one.symbols, "unique_terms": one.unique_terms, "posting_entries": one.posting_entries, "source_tokens": one.tokens, "average_document_length": one.avg_len, "categories": counts}


def root(program: str, version: str, commands: dict[str, str]) -> dict:
    return {"command": program, "version": version, "commands": [{"name": n, "about": a} for n, a in commands.items()]}


def index(repository: str, built: Index, saved: str, exclusions: Iterable[str]) -> dict:
    rows = built.documents.select("doc_id", "relative_path", "category", "token_count").orderBy("doc_id").collect()
    docs = [{"id": r.doc_id, "path": r.relative_path, "category": label(r.category), "tokens": r.token_count} for r in rows]
    return {"command": "index", "repository": repository, "saved_path": saved, "exclusions": list(exclusions), "summary": summary(built), "documents": docs}


def search(repository: str, built: Index, query: str, match_all: bool, filters: search_op.Filters) -> dict:
    rows = search_op.ranked(built, query, match_all, filters).collect()
    results = [
        {
            "rank": r["rank"], "path": r.relative_path, "category": label(r.category), "line": r.line, "score": r.score,
            "score_factors": {"bm25": r.bm25, "file_name": r.file_name, "path": r.path, "exact_symbol": r.exact_symbol, "category": r.category_boost},
            "matched_terms": r.matched_terms, "snippet": r.snippet,
        }
        for r in rows
    ]
    used = {"categories": [label(c) for c in filters.categories], "path": filters.path, "extensions": list(filters.extensions), "limit": filters.limit}
    return {"command": "search", "repository": repository, "query": query, "match": "all" if match_all else "any", "filters": used, "results": results}


def symbol(repository: str, built: Index, name: str) -> dict:
    found = symbols_op.lookup(built, name)
    return {
        "command": "symbol", "repository": repository, "query": name,
        "parse_failures": [{"path": r.path, "message": r.message} for r in built.parse_failures.orderBy("doc_id").collect()],
        "definitions": [{"path": r.relative_path, "line": r.line, "kind": KIND_LABELS[SYMBOL_KINDS.index(r.kind)], "visibility": r.visibility.lower(), "parent": r.parent, "snippet": r.snippet} for r in found.definitions.collect()],
        "likely_references": [{"path": r.relative_path, "line": r.line, "snippet": r.snippet} for r in found.references.collect()],
    }


def overview(repository: str, built: Index) -> dict:
    one = overview_op.overview(built).first()
    n = built.summary().first()
    return {
        "command": "overview", "repository": repository, "project_type": PROJECT_KINDS[one.project_kind], "package": one.package_name, "files": n.files, "symbols": n.symbols,
        **{k: one[k] for k in overview_op.LISTS}, "likely_workflow": one.workflow, "manifest_error": one.manifest_error,
    }


def related(repository: str, built: Index, path: str, limit: int | None) -> dict:
    source = built.corpus.where(built.corpus.doc_id == related_op.source_id(built, path)).first().relative_path
    results = [
        {"path": r.relative_path, "category": label(r.category), "score": r.score, "confidence": r.confidence, "evidence": {"symbols": r.symbols, "file_terms": r.file_terms, "shared_terms": r.shared_terms}}
        for r in related_op.ranked(built, path, limit).collect()
    ]
    return {"command": "related", "repository": repository, "source": source, "results": results}


def audit(repository: str, built: Index, confidence: str, program: str, commands: Iterable[str], options: Iterable[str]) -> dict:
    from pyspark.sql import functions as F

    from .functions import text

    refs = audit_op.references(built, program)
    counts = audit_op.counters(built, refs).first()
    found = audit_op.in_order(audit_op.at_least(audit_op.unresolved(built, refs, commands, options), confidence))
    shown = found.join(built.corpus.select("doc_id", "relative_path", "content"), "doc_id").withColumn("snippet", text.snippet(F.col("content"), F.col("line")))
    rows = audit_op.in_order(shown.drop("content")).collect()
    findings = [{"path": r.relative_path, "line": r.line, "kind": REFERENCE_LABELS[REFERENCE_KINDS.index(r.kind)], "reference": r.value, "confidence": r.confidence, "reason": r.reason, "snippet": r.snippet} for r in rows]
    return {"command": "audit-docs", "repository": repository, "minimum_confidence": confidence.capitalize(), "documents_checked": counts.documents_checked, "references_checked": counts.references_checked, "findings": findings}


def stats(repository: str, snapshot) -> dict:
    return {"command": "stats", "repository": repository, "indexed_at_unix_seconds": snapshot.meta.indexed_at_unix_seconds, "exclusions": list(snapshot.meta.exclusions), "summary": summary(snapshot.index)}


def clear(repository: str, removed: bool) -> dict:
    return {"command": "clear", "repository": repository, "removed": removed}


def as_json(result: dict) -> str:
    return json.dumps(result, indent=2, ensure_ascii=False) + "\n"


def count(n: int) -> str:
    return f"{n:,}"


def _cell(x) -> str:
    if isinstance(x, bool) or x is None:
        return {True: "yes", False: "no", None: "-"}[x]
    if isinstance(x, float):
        return f"{x:.3f}"
    if isinstance(x, int):
        return count(x)
    if isinstance(x, dict):
        return "; ".join(f"{k} {_cell(v)}" for k, v in x.items() if v not in ([], 0.0))
    return ", ".join(map(_cell, x)) if isinstance(x, list) else " ".join(str(x).split())


def as_text(result: dict) -> str:
    """Facts as a two-column table, then each list of rows as entries; no line is longer than WIDTH."""
    width = min(WIDTH, max(40, shutil.get_terminal_size((WIDTH, 24)).columns))
    lines, facts, lists = [], [], []
    for k, v in result.items():
        if isinstance(v, list) and v and isinstance(v[0], dict):
            lists.append((k, v))
        elif isinstance(v, dict):
            facts += [(f"{k}: {a}" if not isinstance(b, dict) else f"{k}: {a}", b) for a, b in v.items()]
        else:
            facts.append((k, v))
    side = min(32, max((len(k) for k, _ in facts), default=0))
    rule = "+" + "-" * (width - 2) + "+"
    lines.append(rule)
    for k, v in facts:
        for i, part in enumerate(textwrap.wrap(_cell(v), width - side - 7, break_long_words=True) or [""]):
            lines.append(f"| {(k if not i else '')[:side]:<{side}} | {part:<{width - side - 7}} |")
    lines.append(rule)
    for name, rows in lists:
        lines.append(f"{name.replace('_', ' ')} ({count(len(rows))})")
        for n, r in enumerate(rows, 1):
            head = "  ".join(_cell(v) for v in list(r.values())[:4] if v is not None)
            lines += textwrap.wrap(f"{n}. {head}", width, subsequent_indent="   ")
            for k, v in list(r.items())[4:]:
                if v not in (None, [], ""):
                    lines += textwrap.wrap(f"{k}: {_cell(v)}", width, initial_indent="   ", subsequent_indent="     ")
    if result.get("command") == "search" and not result["results"]:
        lines.append("No results." if any(c.isalnum() for c in result["query"]) else "No searchable terms in the query.")
    return "\n".join(lines) + "\n"
