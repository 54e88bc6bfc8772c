"""Files to nodes: every file is parsed once, in the task that holds it, into rows to count or join.

Sources are stored once: an inner node has its bytes' offsets only, and leaves have their text, so a table holds a file's
text about once. Rules don't go through this table; see operators.findings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from ..langs import BY_NAME, Language
from ..langs.index import Tree
from ..langs.tree import KINDS, SIGNS, Syn, Tape

SCHEMA = (
    "file_id long, lang string, path string, pre int, stop int, parent int, depth int, kind string, named boolean, extra boolean, missing boolean, is_error boolean, has_error boolean, comment boolean, field string, "
    "sb int, eb int, sr int, sc int, er int, ec int, child_ord int, rel_ord int, named_ord int, core int, stmt int, text string"
)
_BOOL = {"named", "extra", "missing", "is_error", "has_error", "comment"}
_TEXT = {"kind", "field", "text"}
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")][3:]


def rows_of(root: Syn | Tape, source: str, lang: Language, only: Sequence[str] = COLUMNS) -> dict[str, Sequence]:
    """The columns of a tree's nodes, in pre-order; those in ``only``."""
    tree = Tree(root, source, lang)
    every = range(len(tree.nodes))
    signs = tree.nodes

    def depth() -> list[int]:
        found, parent = [0] * len(signs), tree.parent
        for i in every[1:]:
            found[i] = found[parent[i]] + 1
        return found

    def has_error() -> list[bool]:
        found = [SIGNS[n].kind == "ERROR" or SIGNS[n].missing for n in signs]
        for i in reversed(every[1:]):
            found[tree.parent[i]] |= found[i]
        return found

    def ordinal(order: Sequence[int]) -> list[int | None]:
        return [None if n < 0 else n for n in order]

    make = {
        "pre": lambda: every, "stop": lambda: tree.stop, "parent": lambda: ordinal(tree.parent), "depth": depth, "kind": lambda: [KINDS[n] for n in signs], "named": lambda: [SIGNS[n].named for n in signs],
        "extra": lambda: [SIGNS[n].extra for n in signs], "missing": lambda: [SIGNS[n].missing for n in signs], "is_error": lambda: [KINDS[n] == "ERROR" for n in signs], "has_error": has_error,
        "comment": lambda: [tree.comment(i) for i in every], "field": lambda: [SIGNS[n].field for n in signs], "sb": lambda: [tree.start(i) for i in every], "eb": lambda: [tree.end(i) for i in every],
        "sr": lambda: [tree.place(tree.start(i))[0] for i in every], "sc": lambda: [tree.place(tree.start(i))[1] for i in every], "er": lambda: [tree.place(tree.end(i))[0] for i in every], "ec": lambda: [tree.place(tree.end(i))[1] for i in every],
        "child_ord": lambda: ordinal(tree.child_ord), "rel_ord": lambda: ordinal(tree.rel_ord), "named_ord": lambda: ordinal(tree.named_ord), "core": lambda: [tree.core(i) for i in every], "stmt": lambda: [tree.statement(i) for i in every],
        "text": lambda: [None if tree.stop[i] > i + 1 else tree.text(i) for i in every],
    }
    return {c: make[c]() for c in only}


def nodes(files: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The node table of ``files`` (file_id, lang, src, path): one row per node, pre-order within a file; with ``columns``, only these of its columns, as no others are made then.

    Nothing is shuffled: a file's nodes come from the task that reads it. Null sources are empty; files of languages
    without a parser give no rows. Files with syntax errors keep their error nodes.
    """
    types = dict(c.split() for c in SCHEMA.split(", "))
    if unknown := set(columns or ()) - types.keys():
        raise ValueError(f"no such columns of nodes: {sorted(unknown)}")
    names = list(types) if columns is None else list(columns)
    own = [c for c in names if c in COLUMNS] or ["depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, held, size = [], {c: [] for c in own}, 0

            def made(files: list, held: dict[str, list]) -> pa.RecordBatch:
                columns = {c: pa.array(held[c], pa.bool_() if c in _BOOL else pa.string() if c in _TEXT else pa.int32()) for c in own}
                if "file_id" in names:
                    columns["file_id"] = pa.array([i for i, _, _, n in files for _ in range(n)], pa.int64())
                if "lang" in names:
                    columns["lang"] = pa.array([x for _, x, _, n in files for _ in range(n)], pa.string())
                if "path" in names:  # the root has it
                    columns["path"] = pa.array([p for _, _, path, n in files for p in (path, *[None] * (n - 1))], pa.string())
                return pa.RecordBatch.from_arrays([columns[c] for c in names], names)

            for i, name, source, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang = BY_NAME.get((name or "").lower())
                if lang is None or lang.parse is None:
                    continue
                columns = rows_of(lang.read(source or ""), source or "", lang, own)
                for c, values in columns.items():
                    held[c].extend(values)
                files.append((i, lang.name, path, n := len(columns[own[0]])))
                size += n
                if size >= 20_000:
                    yield made(files, held)
                    files, held, size = [], {c: [] for c in own}, 0
            if size:
                yield made(files, held)

    return files.select("file_id", "lang", "src", "path").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names))
