"""What people and programs read: JSON, text with carets, a summary, an exit code."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .findings import ordered, tally

OPTIONAL = ("note", "url", "tags", "bindings", "fix")
PUBLIC = ["rule", "severity", "message", "note", "url", "tags", "file", "startLine", "startColumn", "endLine", "endColumn", "snippet", "bindings", "fix"]


def as_records(rows: Iterable[Row]) -> list[dict]:
    """Findings as the public JSON has them: what is empty is left out, where it may be."""
    found = []
    for r in rows:
        record = {c: r[c] for c in PUBLIC}
        found.append({k: v for k, v in record.items() if k not in OPTIONAL or (v is not None if k == "fix" else v)})
    return found


def to_json(findings: DataFrame) -> str:
    """An indented array. It's for what a person asked for; ``findings.write.json`` writes any number."""
    return json.dumps(as_records(ordered(findings).toLocalIterator()), indent=2, ensure_ascii=False)


def pretty(findings: DataFrame, files: DataFrame) -> Iterable[str]:
    """Lines of text: findings by file, the line with carets below, and notes. Rows come one partition at a time."""
    src = files.select(F.col("file_id").alias("sf"), F.col("src"))
    lines = findings.join(src, F.col("file_id") == F.col("sf")).withColumn("excerpt", F.element_at(F.split("src", "\n"), F.col("startLine"))).drop("src", "sf")
    file = None
    for r in ordered(lines).toLocalIterator():
        if r["file"] != file:
            file = r["file"]
            yield file
        yield f"  {r['startLine']}:{r['startColumn']}  {r['severity']}  {r['message']}  [{r['rule']}]"
        data = (r["excerpt"] or "").encode()
        before, inside = data[: r["startColumn"] - 1], data[r["startColumn"] - 1 : r["endColumn"] - 1 if r["endLine"] == r["startLine"] else None]
        width = lambda b: sum(4 if c == "\t" else 1 for c in b.decode("utf-8", "replace"))
        yield "    " + data.decode("utf-8", "replace").replace("\t", "    ")
        yield "    " + " " * width(before) + "^" * max(1, width(inside))
        if r["note"]:
            yield f"    note: {r['note']}"


def summary(findings: DataFrame) -> str:
    counts = {r["severity"]: r["n"] for r in tally(findings).collect()}
    parts = [f"{n} {word}{'s' * (n != 1)}" for s, word in (("error", "error"), ("warning", "warning"), ("info", "info")) if (n := counts.get(s, 0))]
    return f"✖ {', '.join(parts)}" if parts else "no findings"


def exit_code(findings: DataFrame, load_errors: list[str] = (), error_on_warning: bool = False) -> int:
    """2: a rule doesn't load; 1: an error, or a warning if that counts; else 0."""
    if load_errors:
        return 2
    bad = ["error", "warning"] if error_on_warning else ["error"]
    return int(not findings.where(F.col("severity").isin(bad)).isEmpty())
