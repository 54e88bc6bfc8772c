"""Findings: rules over a corpus, suppressed where comments say so, in one table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import glob
from ..functions.text import any_of, template
from ..langs import BY_NAME
from ..langs.index import Tree
from ..plans.compile import Compiled, compile_rule
from ..plans.evaluate import File
from ..rules.model import Rule, RuleError
from .project import Config

SEVERITIES = ("error", "warning", "info")
COLUMNS = ["rule", "severity", "message", "note", "url", "tags", "file", "startLine", "startColumn", "endLine", "endColumn", "snippet", "bindings", "fix", "file_id", "startByte", "endByte"]
SCHEMA = "rule string, severity string, message string, note string, url string, tags array<string>, file string, startLine int, startColumn int, endLine int, endColumn int, snippet string, bindings map<string,string>, fix string, file_id long, startByte int, endByte int"

OPENING, CLOSING = re.compile(r"^\s*(?:<!--|//|/\*|#)\s*", re.A), re.compile(r"\s*(?:-->|\*/)\s*\Z", re.A)
DIRECTIVE = re.compile(r"lint:ignore(-next-line)?(?=\s|\Z)(.*)", re.A | re.S)


def in_scope(rule: Rule):
    """Whether a path is one of the rule's; ``exclude`` wins."""
    path = F.col("path")
    inside = any_of([path.rlike(glob(g)) for g in rule.paths]) if rule.paths else F.lit(True)
    return inside & ~any_of([path.rlike(glob(g)) for g in rule.exclude]) if rule.exclude else inside


def may_match(c: Compiled, prefilter: bool = True) -> Column:
    may = (F.col("lang") == c.lang.name) & in_scope(c.rule)
    for text in [c.anchor, *c.needs] if prefilter else []:
        may = may & F.contains("src", F.lit(text)) if text else may
    return may


def suppressions(tree: Tree) -> dict[int, list[list[str]]]:
    """By line, what comments suppress there: lists of rule ids, an empty one for every rule. ``lint:ignore`` is for the comment's own line."""
    found: dict[int, list[list[str]]] = {}
    for kind in tree.lang.comments:
        for i in tree.of_kind(kind):
            m = DIRECTIVE.match(CLOSING.sub("", OPENING.sub("", tree.text(i), 1), 1).strip(" "))
            if m:
                ids = [words[0] for x in m[2].split(",") if (words := x.split())]
                found.setdefault(tree.place(tree.start(i))[0] + 1 + bool(m[1]), []).append(ids)
    return found


def file_findings(tree: Tree, rules: Iterable[tuple[int, Compiled]], keep_suppressed: bool = False) -> Iterator[tuple]:
    """Rows of FOUND without the file's own columns, for the numbered rules."""
    file, silent = File(tree), None
    for number, c in rules:
        if c.lang.name != tree.lang.name:
            continue
        for m in file.run(c):
            (sr, sc), (er, ec) = tree.place(m.start), tree.place(m.end)
            if not keep_suppressed:
                silent = suppressions(tree) if silent is None else silent
                if any(not ids or c.rule.id in ids for ids in silent.get(sr + 1, ())):
                    continue
            bound = {n: b.text for n, b in sorted(m.bound.items())}
            fix = template(c.rule.fix, bound) if c.rule.fix is not None else None
            yield number, sr + 1, sc + 1, er + 1, ec + 1, tree.slice(m.start, m.end), template(c.rule.message, bound), list(bound.items()), fix, m.start, m.end


FOUND = "file_id long, file string, number int, startLine int, startColumn int, endLine int, endColumn int, snippet string, message string, bindings map<string,string>, fix string, startByte int, endByte int"
_FOUND = [pa.int64(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32()]
#: Rows and source characters that a task hands on or takes at a time.
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20


def matched(files: DataFrame, compiled: list[Compiled], keep_suppressed: bool = False) -> DataFrame:
    """Rows of FOUND for ``files`` (file_id, path, lang, src, todo: numbers of the rules to run).

    One narrow stage: the task that reads a file parses it once, runs all of its rules on the tree and hands on findings
    alone, so neither sources nor trees are shuffled or kept. Null sources are empty; files of languages without a parser
    give no rows; files with syntax errors are searched with their error nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])

        for found in batches:
            columns = found.columns
            for at in range(found.num_rows):
                file_id, path, name, source, todo = (c[at].as_py() for c in columns)
                lang = BY_NAME.get((name or "").lower())
                if lang is None or lang.parse is None or not todo:
                    continue
                source = source or ""
                tree = Tree(lang.read(source), source, lang)
                for row in file_findings(tree, [(n, compiled[n]) for n in todo], keep_suppressed):
                    rows.append((file_id, path, *row))
                    held += len(row[5])
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                        yield batch()
                        held = 0
        if rows:
            yield batch()

    return files.select("file_id", "path", "lang", "src", "todo").mapInArrow(run, FOUND)


def to_do(compiled: list[Compiled], prefilter: bool = True) -> Column:
    """The numbers of the rules that may match a file: by language, path, and a word that their pattern needs."""
    rows = [F.when(may_match(c, prefilter), F.lit(n)) for n, c in enumerate(compiled)]
    return F.filter(F.array(*rows), lambda n: n.isNotNull()) if rows else F.array().cast("array<int>")


def selected(rules: list[Rule], config: Config | None = None, languages: list[str] | None = None, tags: list[str] | None = None) -> list[Compiled]:
    """The rules that run, compiled: not disabled, with a wanted tag, in a wanted language. RuleErrors are raised together."""
    config = config or Config()
    found, errors = [], []
    for rule in rules:
        if config.disabled(rule.id) or tags and not set(tags) & set(rule.tags):
            continue
        try:
            found += [c for c in compile_rule(rule) if not languages or c.lang.name in languages]
        except RuleError as e:
            errors.append(str(e))
    if errors:
        raise RuleError("\n".join(errors))
    return found


def check(files: DataFrame, rules: list[Rule], config: Config | None = None, languages: list[str] | None = None, tags: list[str] | None = None, prefilter: bool = True, keep_suppressed: bool = False) -> DataFrame:
    """All findings of ``rules`` in ``files`` (file_id, path, lang, src), without order."""
    config = config or Config()
    compiled = selected(rules, config, languages, tags)
    if not compiled:
        return files.sparkSession.createDataFrame([], SCHEMA)
    # The filter stands below the parse, where it reaches the scan; files without work never leave the JVM.
    may = files.where(any_of([may_match(c, prefilter) for c in compiled]))
    found = matched(spread(may.withColumn("todo", to_do(compiled, prefilter))), compiled, keep_suppressed)
    return found.withColumn("about", F.get(about(compiled, config), F.col("number"))).select("about.*", *COLUMNS[6:], "message").select(*COLUMNS)


def spread(files: DataFrame) -> DataFrame:
    """``files``, dealt over all cores if their input is too small to have a split for each: parsing is the costly part. Larger
    inputs stay where they are; nothing is run to find out, as the plan knows its size."""
    spark = files.sparkSession
    session, cores = spark._jsparkSession.sessionState(), spark.sparkContext.defaultParallelism
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(cores) if size < cores * session.conf().filesMaxPartitionBytes() else files


def about(compiled: list[Compiled], config: Config) -> Column:
    """What findings say of their rule, as a constant array by number."""

    def one(c: Compiled) -> Column:
        rule, text = c.rule, lambda x: F.lit(x).cast("string")
        return F.struct(F.lit(rule.id).alias("rule"), text(config.severity(rule.id) or rule.severity).alias("severity"), text(rule.note).alias("note"), text(rule.url).alias("url"), F.array(*map(F.lit, rule.tags)).cast("array<string>").alias("tags"))

    return F.array(*map(one, compiled))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "startLine", "startColumn", "rule", "endByte", "startByte")


def tally(findings: DataFrame) -> DataFrame:
    """(severity, n); an unknown severity counts as info."""
    known = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("info")
    return findings.groupBy(known.alias("severity")).agg(F.count("*").alias("n"))
