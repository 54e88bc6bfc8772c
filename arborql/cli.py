"""python -m arborql.cli check|test|list|parse|langs: the library from a shell."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

from .langs import KNOWN_ONLY, LANGUAGES, language
from .langs.tree import Syn
from .operators import findings as found
from .operators import fixes, project, report
from .operators.testing import run_tests
from .plans.pattern import compile_pattern
from .rules import RuleError
from .sources import scan


def s_expression(node: Syn) -> str:
    inside = "".join(f" {k.field + ': ' if k.field else ''}{s_expression(k)}" for k in node.kids if k.named)
    return f"({'MISSING ' * node.missing}{node.kind}{inside})"


def explain_pattern(body: str, lang: str) -> str:
    return str(compile_pattern(body, language(lang)))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="arborql")
    parser.add_argument("--rules", default=".lint")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check")
    check.add_argument("paths", nargs="+")
    for flag in ("json", "fix", "quiet", "error-on-warning"):
        check.add_argument(f"--{flag}", action="store_true")
    for flag in ("lang", "tag"):
        check.add_argument(f"--{flag}", action="append")
    commands.add_parser("test").add_argument("ids", nargs="*")
    commands.add_parser("list")
    parse = commands.add_parser("parse")
    parse.add_argument("lang")
    parse.add_argument("file", nargs="?")
    parse.add_argument("--pattern")
    commands.add_parser("langs")
    args = parser.parse_args(argv)
    if args.command == "langs":
        for lang in (*LANGUAGES, *KNOWN_ONLY):
            print(f"{lang.name}\t{' '.join(lang.aliases)}\t{' '.join(lang.extensions)}\t{'parsed' if lang.parse else 'known by name only'}")
        return 0
    if args.command == "parse":
        try:
            print(explain_pattern(args.pattern, args.lang) if args.pattern else s_expression(language(args.lang).parse(open(args.file, encoding="utf-8").read())))
        except RuleError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    rules, errors = project.load_rules(args.rules)
    for e in errors:
        print(e, file=sys.stderr)
    if args.command == "list":
        for r in rules:
            print(f"{r.id}\t{r.severity}\t{', '.join(r.languages)}\t{r.message}")
        return 2 if errors else 0
    spark = SparkSession.builder.appName("arborql").getOrCreate()
    if args.command == "test":
        results = run_tests(spark, [r for r in rules if not args.ids or r.id in args.ids]).collect()
        for r in results:
            if not r["passed"]:
                print(f"FAIL {r['rule']} case {r['idx'] + 1} ({r['expect']}): {r['why']}")
        print(f"{sum(r['passed'] for r in results)} of {len(results)} cases passed")
        return int(bool(errors) or not all(r["passed"] for r in results))
    languages = []
    for name in args.lang or []:
        try:
            languages.append(language(name).name)
        except KeyError:
            print(f"unknown language {name!r}", file=sys.stderr)
    files = scan(spark, *args.paths)
    try:
        rows = found.check(files, rules, project.load_config(os.getcwd()), languages, args.tag).cache()
    except RuleError as e:
        print(e, file=sys.stderr)
        return 2
    if args.fix:
        fixed = fixes.fixed_sources(files, rows).where("applied > 0").join(files.select("file_id", "uri"), "file_id")
        for r in fixed.toLocalIterator():
            with open(re.sub("^file:/+", "/", r["uri"]), "w", encoding="utf-8", newline="") as f:
                f.write(r["fixed_src"])
    shown = rows.where("severity = 'error'") if args.quiet else rows
    if args.json:
        print(report.to_json(shown))
    else:
        for line in report.pretty(shown, files):
            print(line)
        print(report.summary(shown))
    return report.exit_code(rows, errors, args.error_on_warning)


if __name__ == "__main__":
    sys.exit(main())
