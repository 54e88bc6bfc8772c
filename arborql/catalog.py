"""Queries over the driver's tables, each with the SQL that it must agree with: rows and columns as documents."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .langs import language
from .operators import findings as found
from .operators import report
from .operators.fixes import fix_counts, fixed_sources
from .operators.project import Config
from .operators.testing import run_tests
from .plans.compile import compile_rule
from .plans.pattern import compile_pattern
from .rules import RuleError, read_rules
from .sources import documents, nodes, scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- corpora ---------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    return documents(_table(spark, d, "events"), "event_id", "props", "json")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """A customer as an object: id, nation, segment and balance, and two numbers to compare."""
    t = _table(spark, d, "customer")
    row = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 7).alias("a"), (F.col("c_nationkey") % 7).alias("b")))
    return documents(t, "c_custkey", row, "json", F.concat_ws("/", F.lit("data"), F.lower("c_mktsegment"), F.concat(F.col("c_custkey").cast("string"), F.lit(".json"))))


def parts(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "part")
    attribute = lambda n, c: F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))
    text = F.concat(F.lit("<part"), attribute("brand", "p_brand"), attribute("size", "p_size"), F.lit("><name>"), F.col("p_name"), F.lit("</name><type>"), F.col("p_type"), F.lit("</type></part>"))
    return documents(t, "p_partkey", text, "xml")


def _by_nation(spark: SparkSession, d: str, item: Column) -> DataFrame:
    t = _table(spark, d, "customer").select("c_nationkey", F.struct("c_custkey", item.alias("item")).alias("s"))
    return t.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["item"]).alias("items"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """A nation as an object with an array of its customers' objects."""
    item = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    text = F.concat(F.lit('{"nation": '), F.col("c_nationkey").cast("string"), F.lit(', "customers": [\n'), F.array_join("items", ",\n"), F.lit("\n]}"))
    return documents(_by_nation(spark, d, item), "c_nationkey", text, "json")


def lists(spark: SparkSession, d: str) -> DataFrame:
    """A nation's segments as a YAML list, in the order of its customers."""
    text = F.concat(F.lit("- "), F.array_join("items", "\n- "), F.lit("\n"))
    return documents(_by_nation(spark, d, F.col("c_mktsegment")), "c_nationkey", text, "yaml")


def settings(spark: SparkSession, d: str) -> DataFrame:
    """An order as YAML pairs, with a comment that asks for silence where the price is high."""
    t = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    mark = F.when(F.col("o_totalprice") > 200000, F.when(F.col("o_orderkey") % 2 == 0, F.lit("  # lint:ignore urgent, other")).otherwise(F.lit("  # lint:ignore-next-line urgent"))).otherwise("")
    text = F.concat(F.lit("status: "), F.col("o_orderstatus"), F.lit("\npriority: "), F.col("o_orderpriority"), mark, F.lit("\nkey: "), F.col("o_orderkey").cast("string"), F.lit("\n"))
    return documents(t, "o_orderkey", text, "yaml")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return documents(_table(spark, d, "pages"), "page_id", "html", "html", F.regexp_replace("url", r"^[a-z]+://", ""))


def brackets(spark: SparkSession, d: str) -> DataFrame:
    """A customer as lists: an empty one, one with a blank or with a number, and a nested one."""
    t = _table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = F.concat(F.lit('{"v": '), F.when(k % 3 == 0, "[]").when(k % 3 == 1, "[ ]").otherwise("[1]"), F.lit(', "w": [['), (k % 3).cast("string"), F.lit(", "), (n % 3).cast("string"), F.lit("], "), (k % 2).cast("string"), F.lit("]}"))
    return documents(t, "c_custkey", text, "json")


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """A supplier as a style sheet."""
    t = _table(spark, d, "supplier")
    text = F.concat(F.lit("#s"), F.col("s_suppkey").cast("string"), F.lit(" .nation"), F.col("s_nationkey").cast("string"), F.lit(" { color: "), F.when(F.col("s_acctbal") < 0, F.lit("red !important")).otherwise(F.lit("green")), F.lit("; margin: 0 "), (F.col("s_suppkey") % 9).cast("string"), F.lit("px; }"))
    return documents(t, "s_suppkey", text, "css")


def go_code(spark: SparkSession, d: str) -> DataFrame:
    """A part as a Go function that locks, compares and returns."""
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(
        F.lit("package p\n\nfunc F"), F.col("p_partkey").cast("string"), F.lit("(err error) int {\n\tfmt.Println(\""), F.col("p_brand"), F.lit("\", "), size.cast("string"), F.lit(")\n\tmu.Lock()\n"),
        F.when(size % 2 == 0, "\tdefer mu.Unlock() // as it should be\n").otherwise("\twork()\n"), F.lit("\tok := a"), (size % 3).cast("string"), F.when(size % 5 == 0, " - a").otherwise(" <= a"), (size % 2).cast("string"),
        F.lit("\n\tif err == nil {\n\t\treturn err\n\t}\n\treturn ok\n}\n"),
    )
    return documents(t, "p_partkey", text, "go")


def python_code(spark: SparkSession, d: str) -> DataFrame:
    """A part as a Python function with a default, a comparison and a handler."""
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(
        F.lit("def f(a, b="), F.when(size % 3 == 0, "[]").when(size % 3 == 1, "{}").otherwise("None"), F.lit("):\n    # "), F.col("p_name"), F.lit("\n    if a"), (size % 4).cast("string"), F.when(size % 2 == 0, " == ").otherwise(" is "),
        F.lit("None:\n        print(f'{a}', "), size.cast("string"), F.lit(")\n    try:\n        g()\n    except"), F.when(size % 5 == 0, "").otherwise(" ValueError"), F.lit(":\n        pass\n    return a\n"),
    )
    return documents(t, "p_partkey", text, "python")


def script_code(spark: SparkSession, d: str) -> DataFrame:
    """A part as a TypeScript function with types, a template and an arrow."""
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(
        F.lit("export function f(a: number, b?: string | null) {\n  var x = "), size.cast("string"), F.lit(";\n  if (a "), F.when(size % 2 == 0, "==").otherwise("==="), F.lit(" x) {\n    console."), F.when(size % 3 == 0, "log").otherwise("error"),
        F.lit("(`"), F.col("p_brand"), F.lit(": ${x}`);\n  }\n  return b! + [1].map((y) => y / x)\n}\n"),
    )
    return documents(t, "p_partkey", text, "typescript")


def java_code(spark: SparkSession, d: str) -> DataFrame:
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(F.lit("class P { boolean f(String a) { try { if (a "), F.when(size % 2 == 0, "==").otherwise("!="), F.lit(' "'), F.col("p_brand"), F.lit('") return g('), size.cast("string"), F.lit("); } catch (Exception e) { "), F.when(size % 3 == 0, "").otherwise("log(e);"), F.lit(" } return false; } }\n"))
    return documents(t, "p_partkey", text, "java")


def c_code(spark: SparkSession, d: str) -> DataFrame:
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(F.lit("#include <stdlib.h>\nint f(void) {\n  char *p = malloc("), size.cast("string"), F.lit(");\n  "), F.when(size % 2 == 0, "if (!p) return 1;").otherwise("use(p);"), F.lit("\n  return p->n"), F.when(size % 3 == 0, " == 0.5").otherwise(" + 1"), F.lit(";\n}\n"))
    return documents(t, "p_partkey", text, "c")


def cpp_code(spark: SparkSession, d: str) -> DataFrame:
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(F.lit("namespace a { template <class T> T f(const T& x) { auto p = new T["), size.cast("string"), F.lit("]; for (auto y : x) { std::cout << y"), F.when(size % 2 == 0, " << std::endl").otherwise(""), F.lit("; } return ("), F.when(size % 3 == 0, "int").otherwise("T"), F.lit(")x; } }\n"))
    return documents(t, "p_partkey", text, "cpp")


def rust_code(spark: SparkSession, d: str) -> DataFrame:
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(F.lit("fn f<'a>(x: &'a [u8]) -> Option<i32> {\n    let y = x.iter().map(|z| z."), F.when(size % 2 == 0, "unwrap").otherwise("clone"), F.lit("()).collect::<Vec<_>>();\n    if y.len() == "), size.cast("string"), F.lit(" { panic!(\""), F.col("p_brand"), F.lit("\") }\n    Some(1)\n}\n"))
    return documents(t, "p_partkey", text, "rust")


def csharp_code(spark: SparkSession, d: str) -> DataFrame:
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(F.lit("namespace N { class P { public async "), F.when(size % 2 == 0, "void").otherwise("Task"), F.lit(" F(int? a) { var r = t.Result?.X ?? 1; Console.WriteLine($\""), F.col("p_brand"), F.lit(" {r}\"); return a "), F.when(size % 3 == 0, "==").otherwise("!="), F.lit(" null; } } }\n"))
    return documents(t, "p_partkey", text, "csharp")


def kotlin_code(spark: SparkSession, d: str) -> DataFrame:
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(F.lit("class P(val a: Int?) {\n  fun f(x: List<String>): Int {\n    println(\""), F.col("p_brand"), F.lit(" ${x.size}\")\n    val r = a"), F.when(size % 2 == 0, "!!").otherwise(" ?: 1"), F.lit("\n    if (x.size == "), (size % 4).cast("string"), F.lit(") return r else x.map { it.length }\n    return 0\n  }\n}\n"))
    return documents(t, "p_partkey", text, "kotlin")


def swift_code(spark: SparkSession, d: str) -> DataFrame:
    t, size = _table(spark, d, "part"), F.col("p_size")
    text = F.concat(F.lit("final class P: Q {\n  func f(_ x: [String], by y: Int?) throws -> Int {\n    print(\""), F.col("p_brand"), F.lit(" \\(x.count)\")\n    let r = y as"), F.when(size % 2 == 0, "!").otherwise("?"), F.lit(" Int\n    guard x.count == "), (size % 4).cast("string"), F.lit(", let z = y else { return x.map { $0.count }[0] }\n    return z\n  }\n}\n"))
    return documents(t, "p_partkey", text, "swift")


def mixed_code(spark: SparkSession, d: str) -> DataFrame:
    """A part as a call in one of three languages, or as JSON."""
    t, kind = _table(spark, d, "part"), F.col("p_partkey") % 4
    by = lambda *x: F.when(kind == 0, x[0]).when(kind == 1, x[1]).when(kind == 2, x[2]).otherwise(x[3])
    n = F.col("p_size").cast("string")
    text = by(F.concat(F.lit("package p\nfunc f() { show("), n, F.lit(") }\n")), F.concat(F.lit("show("), n, F.lit(")\n")), F.concat(F.lit("show("), n, F.lit(");")), F.concat(F.lit('{"show": '), n, F.lit("}")))
    lang = by(F.lit("go"), F.lit("python"), F.lit("tsx"), F.lit("json"))
    return t.select(F.col("p_partkey").cast("long").alias("file_id"), F.concat(lang, F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), lang.alias("lang"), text.alias("src"))


# -- queries ---------------------------------------------------------------------------------------------------------


def _check(corpus: Callable, rule: str, columns: dict[str, str], spark: SparkSession, d: str) -> DataFrame:
    rows = found.check(corpus(spark, d), read_rules(rule, "query.lint"))
    return rows.select(F.col("file_id").alias("id"), *[F.expr(c).alias(n) for n, c in columns.items()])


def captured(*names: str) -> dict[str, str]:
    return {n.lower(): f"bindings['{n}']" for n in names}


CUSTOMER = "SELECT CAST(c_custkey AS BIGINT) AS id{more} FROM customer WHERE {where}"
SEGMENT = '"segment": "$S"'


def _customer(where: str, more: str = "") -> str:
    return CUSTOMER.format(more=more and f", {more}", where=where)


ORDERED = "(SELECT c_nationkey AS n, c_custkey AS k, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)"


def _list(where: str) -> str:
    return f"WITH l AS {ORDERED} SELECT CAST(n AS BIGINT) AS id, CAST(i AS INT) AS line FROM l a WHERE s = 'BUILDING' AND {where}"


def _near(condition: str, negated: bool = False) -> str:
    return f"{'NOT ' * negated}EXISTS (SELECT 1 FROM l b WHERE b.n = a.n AND b.s = 'MACHINERY' AND {condition})"


def _numbers(sign: str) -> tuple:
    return customers, f'rule r {{ in json pattern {{ "balance": $V }} where $V {sign} 5000 }}', {}, _customer(f"c_acctbal {sign} 5000")


def _counts(op: str, sign: str) -> tuple:
    group = {"count": "count(*)", "lines": "count(*)", "length": "sum(length(CAST(c_custkey AS VARCHAR))) + 2 * (count(*) - 1)"}[op]
    limit = {"count": 60, "lines": 60, "length": 300}[op]
    return (
        _ids, f"rule r {{ in json pattern {{ [$$$L] }} where $L {op} {sign} {limit} }}", {"n": "1"},
        f"SELECT CAST(c_nationkey AS BIGINT) AS id, 1 AS n FROM customer GROUP BY c_nationkey HAVING {group} {'=' if sign == '==' else sign} {limit}",
    )


def _ids(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("[\n"), F.array_join("items", ",\n"), F.lit("\n]"))
    return documents(_by_nation(spark, d, F.col("c_custkey").cast("string")), "c_nationkey", text, "json")


SIGNS = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}

#: Name: corpus, rule, expressions of the columns beside id, SQL.
CHECKS: dict[str, tuple] = {
    "json_pair_capture": (events, 'rule r { in json pattern { "k": $V } where $V > 50 message "k is $V" }', captured("V") | {"message": "message"}, "SELECT CAST(event_id AS BIGINT) AS id, json_extract_string(props, '$.k') AS v, 'k is ' || json_extract_string(props, '$.k') AS message FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50"),
    "json_key_value": (customers, 'rule r { in json pattern { "$K": $V } where $V kind number where $K not in [id, a] }', captured("K"), "SELECT CAST(c_custkey AS BIGINT) AS id, k FROM customer, (VALUES ('balance'), ('b')) v(k)"),
    "json_object_arity": (customers, 'rule r { in json pattern { {"id": $I, "segment": "$S", "balance": $_, "a": $_, "b": $B} } where $S length > 3 }', captured("I", "B"), _customer("true", "CAST(c_custkey AS VARCHAR) AS i, CAST(c_nationkey % 7 AS VARCHAR) AS b")),
    **{f"where_number_{n}": _numbers(s) for n, s in SIGNS.items() if n in ("gt", "ge", "lt", "le")},
    "where_matches": (customers, f'rule r {{ in json pattern {{ {SEGMENT} }} where $S matches "^(AUTO|BUILD).*G?$" }}', captured("S"), _customer("regexp_matches(c_mktsegment, '^(AUTO|BUILD).*G?$')", "c_mktsegment AS s")),
    "where_not_matches": (customers, f'let R = "[[:upper:]]{{8}}"\nrule r {{ in json pattern {{ {SEGMENT} }} where $S not matches @R }}', captured("S"), _customer("NOT regexp_matches(c_mktsegment, '[[:upper:]]{8}')", "c_mktsegment AS s")),
    "where_in": (customers, f'let L = [BUILDING, "MACHINERY"]\nrule r {{ in json pattern {{ {SEGMENT} }} where $S in @L }}', captured("S"), _customer("c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_mktsegment AS s")),
    "where_not_in": (customers, f"rule r {{ in json pattern {{ {SEGMENT} }} where $S not in [BUILDING, MACHINERY] }}", captured("S"), _customer("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_mktsegment AS s")),
    "where_eq_text": (customers, f'rule r {{ in json pattern {{ {SEGMENT} }} where $S == "BUILDING" }}', {}, _customer("c_mktsegment = 'BUILDING'")),
    "where_ne_text": (customers, f'rule r {{ in json pattern {{ {SEGMENT} }} where $S != "BUILDING" }}', captured("S"), _customer("c_mktsegment <> 'BUILDING'", "c_mktsegment AS s")),
    "where_eq_var": (customers, 'rule r { in json pattern { {"id": $_, "segment": $_, "balance": $_, "a": $A, "b": $B} } where $A == $B }', captured("A"), _customer("c_custkey % 7 = c_nationkey % 7", "CAST(c_custkey % 7 AS VARCHAR) AS a")),
    "where_ne_var": (customers, 'rule r { in json pattern { {"id": $_, "segment": $_, "balance": $_, "a": $A, "b": $B} } where $A != $B }', captured("A", "B"), _customer("c_custkey % 7 <> c_nationkey % 7", "CAST(c_custkey % 7 AS VARCHAR) AS a, CAST(c_nationkey % 7 AS VARCHAR) AS b")),
    "pattern_backref": (customers, 'rule r { in json pattern { {"id": $_, "segment": $_, "balance": $_, "a": $A, "b": $A} } }', captured("A"), _customer("c_custkey % 7 = c_nationkey % 7", "CAST(c_custkey % 7 AS VARCHAR) AS a")),
    "where_kind": (customers, 'rule r { in json pattern { "$K": $V } where $V kind string_content }', captured("K"), _customer("true", "'segment' AS k")),
    "where_not_kind": (customers, 'rule r { in json pattern { "$K": $V } where $V not kind number }', captured("K"), _customer("true", "'segment' AS k")),
    "where_kind_in": (customers, 'rule r { in json pattern { "$K": $V } where $V kind in [number, "true"] where $K matches "^(a|b)$" }', captured("K"), "SELECT CAST(c_custkey AS BIGINT) AS id, k FROM customer, (VALUES ('a'), ('b')) v(k)"),
    "where_not_kind_in": (customers, 'rule r { in json pattern { "$K": $V } where $V not kind in [number, array] }', captured("K"), _customer("true", "'segment' AS k")),
    **{f"where_count_{n}": _counts("count", s) for n, s in SIGNS.items()},
    **{f"where_lines_{n}": _counts("lines", s) for n, s in SIGNS.items()},
    **{f"where_length_{n}": _counts("length", s) for n, s in SIGNS.items()},
    "where_any_group": (customers, f'rule r {{ in json pattern {{ {{"id": $I, {SEGMENT}, "balance": $B, "a": $_, "b": $_}} }} where any {{ $S == "BUILDING" all {{ $B > 9000 $I <= 700 }} }} }}', captured("I", "S"), _customer("c_mktsegment = 'BUILDING' OR (c_acctbal > 9000 AND c_custkey <= 700)", "CAST(c_custkey AS VARCHAR) AS i, c_mktsegment AS s")),
    "where_all_group": (customers, f'rule r {{ in json pattern {{ {{"id": $I, {SEGMENT}, "balance": $B, "a": $_, "b": $_}} }} where all {{ $S == "BUILDING" any {{ $B > 5000 $I <= 700 }} }} }}', captured("I"), _customer("c_mktsegment = 'BUILDING' AND (c_acctbal > 5000 OR c_custkey <= 700)", "CAST(c_custkey AS VARCHAR) AS i")),
    "where_is": (nations, 'rule r { in json pattern { {"id": $I, "segment": $_, "balance": $_} } where $match is all { pattern { "balance": $B } where $B < 0 } where $match is pattern { "segment": "BUILDING" } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'"),
    "where_is_not": (nations, 'rule r { in json pattern { {"id": $I, "segment": $_, "balance": $_} } where any { $match is not pattern { "segment": $_ } $match is pattern { "segment": "BUILDING" } } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "rel_inside": (nations, 'rule r { in json pattern { "id": $I } inside pattern { {"id": $_, "segment": "BUILDING", "balance": $_} } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "rel_inside_capture": (nations, 'rule r { in json pattern { "id": $I } inside pattern { {"nation": $N, "customers": $_} } inside pattern { {"id": $_, "segment": "$S", "balance": $_} } where $N < 5 }', captured("I", "N", "S"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i, CAST(c_nationkey AS VARCHAR) AS n, c_mktsegment AS s FROM customer WHERE c_nationkey < 5"),
    "rel_not_inside": (nations, 'rule r { in json pattern { "id": $I } not inside pattern { {"id": $_, "segment": "BUILDING", "balance": $_} } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "rel_directly_inside": (nations, 'rule r { in json pattern { "balance": $B } directly inside pattern { {"id": $I, "segment": $_, "balance": $_} } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer"),
    "rel_not_directly_inside": (nations, 'rule r { in json pattern { "$K": $V } not directly inside pattern { {"id": $I, "segment": $_, "balance": $_} } }', captured("K"), "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS id, k FROM customer, (VALUES ('nation'), ('customers')) v(k)"),
    "rel_has": (nations, 'rule r { in json pattern { {"id": $I, "segment": $_, "balance": $_} } has pattern { "segment": "BUILDING" } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "rel_has_first": (nations, 'rule r { in json pattern { "customers": $L } has pattern { {"id": $I, "segment": "BUILDING", "balance": $_} } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(min(c_custkey) AS VARCHAR) AS i FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey"),
    "rel_not_has": (nations, 'rule r { in json pattern { {"id": $I, "segment": $_, "balance": $_} } not has pattern { "segment": "BUILDING" } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "rel_directly_has": (nations, 'rule r { in json pattern { [$$$] } directly has pattern { {"id": $I, "segment": "BUILDING", "balance": $_} } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(min(c_custkey) AS VARCHAR) AS i FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey"),
    "rel_not_directly_has": (nations, 'rule r { in json any { pattern { [$$$] } pattern { {"id": $_, "segment": $_, "balance": $_} } } not directly has pattern { "segment": "$S" } }', {"line": "startLine"}, "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS id, 1 AS line FROM customer"),
    "rel_precedes": (lists, "rule r { in yaml pattern { - BUILDING } precedes pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i < a.i"))),
    "rel_not_precedes": (lists, "rule r { in yaml pattern { - BUILDING } not precedes pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i < a.i", True))),
    "rel_follows": (lists, "rule r { in yaml pattern { - BUILDING } follows pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i > a.i"))),
    "rel_not_follows": (lists, "rule r { in yaml pattern { - BUILDING } not follows pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i > a.i", True))),
    "rel_directly_precedes": (lists, "rule r { in yaml pattern { - BUILDING } directly precedes pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i = a.i - 1"))),
    "rel_not_directly_precedes": (lists, "rule r { in yaml pattern { - BUILDING } not directly precedes pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i = a.i - 1", True))),
    "rel_directly_follows": (lists, "rule r { in yaml pattern { - BUILDING } directly follows pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i = a.i + 1"))),
    "rel_not_directly_follows": (lists, "rule r { in yaml pattern { - BUILDING } not directly follows pattern { - MACHINERY } }", {"line": "startLine"}, _list(_near("b.i = a.i + 1", True))),
    "rel_nearest_capture": (lists, "rule r { in yaml pattern { - BUILDING } precedes pattern { - $P } }", {"line": "startLine"} | captured("P"), f"WITH l AS {ORDERED} SELECT CAST(a.n AS BIGINT) AS id, CAST(a.i AS INT) AS line, b.s AS p FROM l a JOIN l b ON a.n = b.n AND b.i = a.i - 1 WHERE a.s = 'BUILDING'"),
    "seq_pattern": (settings, "rule r { in yaml pattern {\nstatus: F\npriority: 1-URGENT\n} }", {"line": "endLine"}, "SELECT CAST(o_orderkey AS BIGINT) AS id, 2 AS line FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "seq_variadic": (lists, "rule r { in yaml pattern {\n- BUILDING\n- $$$M\n- MACHINERY\n} where $M count <= 2 }", {"line": "startLine", "last": "endLine"}, f"WITH l AS {ORDERED} SELECT CAST(n AS BIGINT) AS id, CAST(i AS INT) AS line, CAST(j AS INT) AS last FROM (SELECT a.n, a.i, min(b.i) AS j FROM l a JOIN l b ON a.n = b.n AND b.i > a.i AND b.s = 'MACHINERY' WHERE a.s = 'BUILDING' GROUP BY a.n, a.i) WHERE j - i <= 3"),
    "any_union": (customers, 'rule r { in json any { pattern { "segment": "BUILDING" } pattern { "segment": "MACHINERY" } pattern { "segment": "BUILDING" } } }', {"snippet": "snippet"}, _customer("c_mktsegment IN ('BUILDING', 'MACHINERY')", "'\"segment\":\"' || c_mktsegment || '\"' AS snippet")),
    "all_intersect": (customers, 'rule r { in json all { pattern { {"id": $I, "segment": $_, "balance": $_, "a": $_, "b": $_} } pattern { {"id": $_, "segment": "BUILDING", "balance": $_, "a": $_, "b": $_} } } }', captured("I"), _customer("c_mktsegment = 'BUILDING'", "CAST(c_custkey AS VARCHAR) AS i")),
    "not_matcher": (customers, 'rule r { in json pattern { {"id": $I, "segment": $_, "balance": $_, "a": $_, "b": $_} } not pattern { {"id": $_, "segment": "BUILDING", "balance": $_, "a": $_, "b": $_} } }', captured("I"), _customer("c_mktsegment <> 'BUILDING'", "CAST(c_custkey AS VARCHAR) AS i")),
    "branch_where": (customers, 'rule r { in json any { all { pattern { "segment": "$S" } where $S matches "^B" } all { pattern { "balance": $B } where $B > 9000 } } message "$S $B" }', {"message": "message"}, "SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment || ' $B' AS message FROM customer WHERE c_mktsegment LIKE 'B%' UNION ALL SELECT CAST(c_custkey AS BIGINT), '$S ' || json_extract_string(json_object('b', c_acctbal), '$.b') FROM customer WHERE c_acctbal > 9000"),
    "let_matcher": (customers, 'let M = pattern { "segment": "BUILDING" }\nrule r { in json @M }', {}, _customer("c_mktsegment = 'BUILDING'")),
    "query_match": (customers, 'rule r { in json query """((pair key: (string (string_content) @k) value: (number) @v) @match (#eq? @k "balance") (#match? @v "^-[0.]*[1-9]"))""" }', captured("v"), _customer("c_acctbal < 0", "json_extract_string(json_object('b', c_acctbal), '$.b') AS v")),
    "report_capture": (customers, f'rule r {{ in json pattern {{ {SEGMENT} }} where $S == "BUILDING" report $S }}', {"snippet": "snippet", "width": "endByte - startByte"}, _customer("c_mktsegment = 'BUILDING'", "'BUILDING' AS snippet, 8 AS width")),
    "html_links": (pages, 'rule r { in html pattern { <a href="$U"> } }', captured("U"), "SELECT page_id AS id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS u FROM pages"),
    "html_title": (pages, "rule r { in html pattern { <article>$$$K</article> } has pattern { <h1> } message \"has a title\" }", {"message": "message"}, "SELECT page_id AS id, 'has a title' AS message FROM pages WHERE html LIKE '%<article><h1>%</article>%'"),
    "html_script_raw": (pages, "rule r { in html pattern { <script>$S</script> } }", captured("S"), "SELECT page_id AS id, regexp_extract(html, '<script>([^\\n]*?)</script>', 1) AS s FROM pages WHERE html LIKE '%<script>%'"),
    "html_inside_nav": (pages, "rule r { in html pattern { <a $$$> } inside pattern { <nav $$$> } }", {"snippet": "snippet"}, "SELECT page_id AS id, unnest(regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>'), '<a [^>]*>')) AS snippet FROM pages"),
    "html_no_class": (pages, "rule r { in html pattern { <div $$$> } not pattern { <div $$$ id=$_ $$$> } }", {"snippet": "snippet"}, "SELECT page_id AS id, unnest(regexp_extract_all(html, '<div [^>]*>')) AS snippet FROM pages"),
    "xml_attribute": (parts, 'rule r { in xml pattern { <part brand="$B" size="$S">$$$</part> } where $S > 25 }', captured("B", "S"), "SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS b, CAST(p_size AS VARCHAR) AS s FROM part WHERE p_size > 25"),
    "xml_text_length": (parts, "rule r { in xml pattern { <name>$N</name> } where $N length > 12 inside pattern { <part $$$A>$$$C</part> } }", captured("N"), "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS n FROM part WHERE length(p_name) > 12"),
    "css_important": (sheets, "rule r { in css pattern { $P: $$$V !important } }", captured("P", "V"), "SELECT CAST(s_suppkey AS BIGINT) AS id, 'color' AS p, 'red' AS v FROM supplier WHERE s_acctbal < 0"),
    "css_id_selector": (sheets, 'rule r { in css query "(id_selector (id_name) @n) @match" where $n matches "^s[0-9]$" }', captured("n"), "SELECT CAST(s_suppkey AS BIGINT) AS id, 's' || CAST(s_suppkey AS VARCHAR) AS n FROM supplier WHERE s_suppkey < 10"),
    "suppress_lines": (settings, "rule urgent { in yaml pattern { priority: 1-URGENT } }\nrule closed { in yaml pattern { status: F } where $match lines == 1 inside pattern {\nstatus: $_\npriority: 1-URGENT\n} }", {"rule": "rule", "line": "startLine"}, "SELECT CAST(o_orderkey AS BIGINT) AS id, 'urgent' AS rule, 2 AS line FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT (o_totalprice > 200000 AND o_orderkey % 2 = 0) UNION ALL SELECT CAST(o_orderkey AS BIGINT), 'closed', 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "path_glob": (customers, 'rule r { in json pattern { "id": $I } paths "data/*i*/**" exclude "data/building/1*.json" }', {"file": "file"}, "SELECT CAST(c_custkey AS BIGINT) AS id, f AS file FROM (SELECT c_custkey, lower(c_mktsegment) AS s, 'data/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS VARCHAR) || '.json' AS f FROM customer) WHERE s LIKE '%i%' AND NOT (s = 'building' AND f LIKE 'data/building/1%')"),
}


CHECKS |= {
    "go_call": (go_code, "rule r { in go pattern { fmt.$M($S, $N) } }", captured("M", "S", "N"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'Println' AS m, '\"' || p_brand || '\"' AS s, CAST(p_size AS VARCHAR) AS n FROM part"),
    "go_operator": (go_code, "rule r { in go pattern { $X $OP $X } }", captured("X", "OP"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'a' || CAST(p_size % 2 AS VARCHAR) AS x, CASE WHEN p_size % 5 = 0 THEN '-' ELSE '<=' END AS op FROM part WHERE p_size % 3 = p_size % 2"),
    "go_not_followed": (go_code, "rule r { in go pattern { $MU.Lock() } not directly follows pattern { defer $MU.Unlock() } }", {"line": "startLine"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 5 AS line FROM part WHERE p_size % 2 = 1"),
    "go_inside": (go_code, 'rule r { in go pattern { return $E } inside any { pattern { if $E == nil { $$$ } } pattern { if $_ := $_; $E == nil { $$$ } } } where $E matches "(?i)^ERR" }', captured("E"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'err' AS e FROM part"),
    "go_query": (go_code, 'rule r { in go query "(function_declaration name: (identifier) @N) @match" where $match lines > 9 report $N }', {"snippet": "snippet"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'F' || CAST(p_partkey AS VARCHAR) AS snippet FROM part"),
    "python_default": (python_code, 'rule r { in python query "(default_parameter value: [(list) (dictionary)]) @match" }', {"snippet": "snippet"}, "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_size % 3 WHEN 0 THEN 'b=[]' ELSE 'b={}' END AS snippet FROM part WHERE p_size % 3 < 2"),
    "python_none": (python_code, 'rule r { in python pattern { $X == None } where $X kind identifier fix "$X is None" }', {"fix": "fix"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'a' || CAST(p_size % 4 AS VARCHAR) || ' is None' AS fix FROM part WHERE p_size % 2 = 0"),
    "python_handler": (python_code, "rule r { in python pattern {\ntry:\n    $$$B\nexcept:\n    $$$H\n} inside pattern {\ndef $F($$$P):\n    $$$S\n} where $P count == 2 }", captured("B", "F", "P"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'g()' AS b, 'f' AS f, 'a, b=' || CASE p_size % 3 WHEN 0 THEN '[]' WHEN 1 THEN '{}' ELSE 'None' END AS p FROM part WHERE p_size % 5 = 0"),
    "script_console": (script_code, "rule r { in ts pattern { console.$M($A) } where $M in [log, debug] inside pattern { if ($C) { $$$ } } }", captured("A", "C"), "SELECT CAST(p_partkey AS BIGINT) AS id, '`' || p_brand || ': ${x}`' AS a, 'a ' || CASE p_size % 2 WHEN 0 THEN '==' ELSE '===' END || ' x' AS c FROM part WHERE p_size % 3 = 0"),
    "script_equals": (script_code, 'rule r { in typescript pattern { $A == $B } fix "$A === $B" }', {"fix": "fix"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'a === x' AS fix FROM part WHERE p_size % 2 = 0"),
    "script_var": (script_code, 'rule r { in ts pattern { var $N = $V; } where $V > 25 inside pattern { function $F($$$P) { $$$ } } where $P count == 2 }', captured("N", "V"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'x' AS n, CAST(p_size AS VARCHAR) AS v FROM part WHERE p_size > 25"),
    "script_non_null": (script_code, "rule r { in ts pattern { $X! } }", captured("X"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'b' AS x FROM part"),
    "java_equals": (java_code, "rule r { in java pattern { $A == $S } where $S kind string_literal fix \"$S.equals($A)\" }", {"fix": "fix"}, "SELECT CAST(p_partkey AS BIGINT) AS id, '\"' || p_brand || '\".equals(a)' AS fix FROM part WHERE p_size % 2 = 0"),
    "java_empty_catch": (java_code, 'rule r { in java query """(catch_clause body: (block "{" . "}") @match)""" }', {"width": "endByte - startByte"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 4 AS width FROM part WHERE p_size % 3 = 0"),
    "c_unchecked": (c_code, "rule r { in c pattern { $T *$P = malloc($N); } not follows pattern { if (!$P) $_; } }", captured("T", "P", "N"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'char' AS t, 'p' AS p, CAST(p_size AS VARCHAR) AS n FROM part WHERE p_size % 2 = 1"),
    "c_float_equal": (c_code, 'rule r { in c query """((binary_expression operator: "==" right: (number_literal) @n) @match (#match? @n "[.eEfF]"))""" }', {"snippet": "snippet"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'p->n == 0.5' AS snippet FROM part WHERE p_size % 3 = 0"),
    "cpp_endl": (cpp_code, "rule r { in cpp pattern { $A << std::endl } inside pattern { for ($T $X : $Y) { $$$ } } }", captured("A", "X"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'std::cout << y' AS a, 'y' AS x FROM part WHERE p_size % 2 = 0"),
    "cpp_new": (cpp_code, "rule r { in cpp pattern { new $T[$N] } where $N > 25 }", captured("T", "N"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'T' AS t, CAST(p_size AS VARCHAR) AS n FROM part WHERE p_size > 25"),
    "rust_closure": (rust_code, "rule r { in rust pattern { $X.unwrap() } inside pattern { |$A| $B } }", captured("X", "A"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'z' AS x, 'z' AS a FROM part WHERE p_size % 2 = 0"),
    "rust_macro": (rust_code, "rule r { in rust pattern { panic!($$$A) } inside pattern { if $L == $N { $$$ } } where $N > 25 }", captured("A", "N"), "SELECT CAST(p_partkey AS BIGINT) AS id, '\"' || p_brand || '\"' AS a, CAST(p_size AS VARCHAR) AS n FROM part WHERE p_size > 25"),
    "csharp_null": (csharp_code, "rule r { in csharp pattern { $X == null } fix \"$X is null\" }", {"fix": "fix"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'a is null' AS fix FROM part WHERE p_size % 3 = 0"),
    "csharp_async_void": (csharp_code, "rule r { in cs pattern { public async void $M($$$P) { $$$B } } }", captured("M", "P"), "SELECT CAST(p_partkey AS BIGINT) AS id, 'F' AS m, 'int? a' AS p FROM part WHERE p_size % 2 = 0"),
    "kotlin_not_null": (kotlin_code, "rule r { in kotlin pattern { $X!! } }", captured("X") | {"line": "startLine"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'a' AS x, 4 AS line FROM part WHERE p_size % 2 = 0"),
    "kotlin_size": (kotlin_code, "rule r { in kt pattern { $L.size == 0 } fix \"$L.isEmpty()\" }", {"fix": "fix"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'x.isEmpty()' AS fix FROM part WHERE p_size % 4 = 0"),
    "swift_cast": (swift_code, "rule r { in swift pattern { $X as! $T } }", captured("X", "T") | {"line": "startLine"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'y' AS x, 'Int' AS t, 4 AS line FROM part WHERE p_size % 2 = 0"),
    "swift_count": (swift_code, "rule r { in swift pattern { $L.count == 0 } fix \"$L.isEmpty\" }", {"fix": "fix"}, "SELECT CAST(p_partkey AS BIGINT) AS id, 'x.isEmpty' AS fix FROM part WHERE p_size % 4 = 0"),
    "any_language": (mixed_code, "rule r { pattern { show($N) } }", captured("N") | {"folder": "substring_index(file, '/', 1)"}, "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS VARCHAR) AS n, CASE p_partkey % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'tsx' END AS folder FROM part WHERE p_partkey % 4 < 3"),
    "any_test": (nations, 'rule r { in json pattern { "id": $I } inside any { pattern { {"id": $_, "segment": "BUILDING", "balance": $_} } pattern { {"id": $_, "segment": "MACHINERY", "balance": $_} } } }', captured("I"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "query_test": (nations, 'rule r { in json pattern { {"id": $I, "segment": $_, "balance": $_} } has query """((pair key: (string (string_content) @k) value: (string (string_content) @v)) @match (#eq? @k "segment") (#eq? @v "BUILDING"))""" }', captured("I", "v"), "SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS i, 'BUILDING' AS v FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "empty_node": (brackets, 'rule r { in json pattern { "v": [] } }', {"snippet": "snippet"}, "SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 3 WHEN 0 THEN '\"v\": []' ELSE '\"v\": [ ]' END AS snippet FROM customer WHERE c_custkey % 3 < 2"),
    "variadic_value": (customers, 'rule r { in json pattern { "segment": $$$V } }', captured("V"), _customer("true", "'\"' || c_mktsegment || '\"' AS v")),
    "committed_choice": (brackets, 'rule r { in json pattern { [[$$$A, $X, $$$B], $X] } }', captured("A", "X", "B"), "SELECT CAST(c_custkey AS BIGINT) AS id, '' AS a, CAST(c_custkey % 2 AS VARCHAR) AS x, CAST(c_nationkey % 3 AS VARCHAR) AS b FROM customer WHERE c_custkey % 3 = c_custkey % 2"),
}


def language_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = read_rules('rule j { in json pattern { [$$$] } }\nrule y { in yaml pattern { - BUILDING } }\nrule both { in json, yaml pattern { "id": $I } }')
    rows = found.check(nations(spark, d).unionByName(lists(spark, d)), rules, languages=["yaml"])
    return rows.select(F.col("file_id").alias("id"), "rule", F.col("startLine").alias("line"))


def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files in two folders, of which one is passed over."""
    root = f"{_scratch(spark)}/scan-{uuid.uuid4().hex}"
    rows = _table(spark, d, "customer").select("c_custkey", "c_mktsegment").repartition(4)
    for folder in ("src/deep", "node_modules"):
        rows.write.json(f"{root}/{folder}")
    files = scan(spark, root)
    known = files.select("file_id", F.regexp_extract("path", "^(.*)/part-", 1).alias("folder"))
    rows = found.check(files, read_rules('rule r { in json pattern { "c_custkey": $I } }'))
    return rows.join(known, "file_id").select(F.expr("bindings['I']").alias("i"), "folder")


def _scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one if none is set."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='arborql-')}"


def report_top(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a report, in its order."""
    rows = found.check(customers(spark, d), read_rules('rule b { in json pattern { "a": $A } }\nrule a { in json pattern { "id": $I } }'))
    return found.ordered(rows).limit(25).select("file", "startColumn", "rule")


def report_json(spark: SparkSession, d: str) -> DataFrame:
    rules = read_rules('rule r { in json tags t pattern { "nation": $N } note "n" }')
    records = json.loads(report.to_json(found.check(nations(spark, d), rules)))
    rows = [(r["file"], r["message"], r["tags"], r["bindings"]["N"], r["startColumn"], "fix" in r or "url" in r) for r in records]
    return spark.createDataFrame(rows, "file string, message string, tags array<string>, n string, startColumn int, more boolean")


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    rules = read_rules('rule e { in json severity error pattern { "balance": $B } where $B < 0 }\nrule w { in json pattern { "segment": "BUILDING" } }')
    rows = found.check(customers(spark, d), rules)
    return spark.createDataFrame([(report.summary(rows), report.exit_code(rows), report.exit_code(rows, ["bad"]))], "summary string, code int, code_with_errors int")


def rule_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is said of rules that can't run."""
    rows = []
    for n, rule in enumerate(BROKEN):
        try:
            rows.append((n, str([compile_rule(r) for r in read_rules(rule, "x.lint")] and "")))
        except RuleError as e:
            rows.append((n, str(e)))
    return spark.createDataFrame(rows, "n int, said string").withColumn("said", F.regexp_extract("said", "needs a positive matcher|has no pattern|unknown language|which nothing captures|invalid regex|inside quotes|unknown severity|undefined let", 0))


BROKEN = ['rule r { in json not pattern { 1 } }', "rule r { in json }", "rule r { in cobol pattern { 1 } }", 'rule r { in json pattern { "a": $X } report $Y }', 'rule r { in json pattern { "a": $X } where $X matches "(?=a)" }', "rule r { in xml pattern { <a b=\"$$$X\"/> } }", "rule r { severity bad }", "rule r { in json @M }", 'rule r { in json pattern { "a": $X } }']


def pattern_text(spark: SparkSession, d: str) -> DataFrame:
    rows = [(lang, body, str(compile_pattern(body, language(lang)))) for lang, body in (("json", '"k": $V'), ("html", "<a $$$>"), ("xml", "<a/><b/>"), ("yaml", "- $X"), ("css", "$P: $$$V !important"))]
    return spark.createDataFrame(rows, "lang string, body string, shape string")


def severity_tally(spark: SparkSession, d: str) -> DataFrame:
    rules = read_rules('rule low { in json severity info pattern { "balance": $B } where $B < 0 }\nrule some { in json pattern { "segment": "BUILDING" } }\nrule off { in json pattern { "id": $I } }\nrule high { in json severity info pattern { "balance": $B } where $B > 9000 }')
    config = Config(off={"off"}, severities={"high": "error"})
    return found.tally(found.check(customers(spark, d), rules, config))


def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = read_rules('rule one { in json tags money, other pattern { "balance": $B } where $B < 0 }\nrule two { in json tags other pattern { "id": $I } }')
    return found.check(customers(spark, d), rules, tags=["money"]).select(F.col("file_id").alias("id"), "rule")


def fix_apply(spark: SparkSession, d: str) -> DataFrame:
    rules = read_rules('rule r { in json pattern { "segment": "$S" } where $S == "BUILDING" report $S fix { HOUSING } }\nrule all { in json pattern { "balance": $B } where $B < 0 report $B fix "0" }')
    files = customers(spark, d)
    return fixed_sources(files, found.check(files, rules)).select(F.col("file_id").alias("id"), F.get_json_object("fixed_src", "$.segment").alias("segment"), (F.get_json_object("fixed_src", "$.balance") == "0").alias("zeroed"), "applied", "skipped")


def fix_tally(spark: SparkSession, d: str) -> DataFrame:
    rules = read_rules('rule outer { in json pattern { {"id": $I, "segment": $_, "balance": $_, "a": $_, "b": $_} } fix { {"id": $I} } }\nrule inner { in json pattern { "segment": "BUILDING" } fix { "segment": "B" } }')
    files = customers(spark, d)
    return fix_counts(fixed_sources(files, found.check(files, rules)))


def rule_tests(spark: SparkSession, d: str) -> DataFrame:
    rule = 'rule old { in xml, json, html pattern { <v>$V</v> } where $V matches "-OLD$" fix { <v>new</v> } test { match "<r><v>1-OLD</v></r>" fix { <r><v>new</v></r> } match { <r><v>a-OLD</v><v>b-OLD</v></r> } count 2 no_match "<r><v>1</v></r>" match "<r/>" } }'
    return run_tests(spark, read_rules(rule.replace("in xml, json, html", "in xml, html"))).select("rule", "idx", "expect", "n", "passed")


def node_kinds(spark: SparkSession, d: str) -> DataFrame:
    table = nodes(customers(spark, d), ["kind", "named", "depth"])
    return table.where("named").groupBy("kind").agg(F.count("*").alias("n"), F.max("depth").cast("int").alias("deepest"))


def language_scan(spark: SparkSession, d: str) -> DataFrame:
    from .sources.files import language_of

    paths = _table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".JSON").when(F.col("page_id") % 3 == 1, ".yml").otherwise(".bin")).alias("path"))
    return paths.select(F.col("page_id").alias("id"), language_of(F.col("path")).alias("lang"))


OTHERS: dict[str, tuple[Callable, str]] = {
    "language_filter": (language_filter, f"SELECT CAST(n AS BIGINT) AS id, 'y' AS rule, CAST(i AS INT) AS line FROM {ORDERED} WHERE s = 'BUILDING'"),
    "folder_scan": (folder_scan, "SELECT CAST(c_custkey AS VARCHAR) AS i, 'src/deep' AS folder FROM customer"),
    "report_top": (report_top, "SELECT f AS file, c AS \"startColumn\", r AS rule FROM (SELECT 'data/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS VARCHAR) || '.json' AS f, 2 AS c, 'a' AS r FROM customer UNION ALL SELECT 'data/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS VARCHAR) || '.json', CAST(length('{\"id\":' || CAST(c_custkey AS VARCHAR) || ',\"segment\":\"' || c_mktsegment || '\",\"balance\":' || json_extract_string(json_object('b', c_acctbal), '$.b') || ',') + 1 AS INT), 'b' FROM customer) ORDER BY f, c, r LIMIT 25"),
    "report_json": (report_json, "SELECT 'json/' || CAST(c_nationkey AS VARCHAR) AS file, 'r' AS message, ['t'] AS tags, CAST(c_nationkey AS VARCHAR) AS n, 2 AS \"startColumn\", false AS more FROM customer GROUP BY c_nationkey"),
    "report_summary": (report_summary, "SELECT '✖ ' || e || CASE e WHEN 1 THEN ' error, ' ELSE ' errors, ' END || w || CASE w WHEN 1 THEN ' warning' ELSE ' warnings' END AS summary, 1 AS code, 2 AS code_with_errors FROM (SELECT count(*) FILTER (c_acctbal < 0) AS e, count(*) FILTER (c_mktsegment = 'BUILDING') AS w FROM customer)"),
    "rule_errors": (rule_errors, "SELECT * FROM (VALUES (0, 'needs a positive matcher'), (1, 'has no pattern'), (2, 'unknown language'), (3, 'which nothing captures'), (4, 'invalid regex'), (5, 'inside quotes'), (6, 'unknown severity'), (7, 'undefined let'), (8, '')) v(n, said)"),
    "pattern_text": (pattern_text, "SELECT * FROM (VALUES ('json', '\"k\": $V', '(pair (string_content) (:) $V)'), ('html', '<a $$$>', '(start_tag (<) (tag_name) $$$ (>))'), ('xml', '<a/><b/>', 'sequence of 2 nodes: (EmptyElemTag (<) (Name) (/>)) (EmptyElemTag (<) (Name) (/>))'), ('yaml', '- $X', '(block_sequence_item (-) $X)'), ('css', '$P: $$$V !important', '(declaration $P (:) $$$V (important))')) v(lang, body, shape)"),
    "severity_tally": (severity_tally, "SELECT 'info' AS severity, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'warning', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0 UNION ALL SELECT 'error', count(*) FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 0"),
    "tag_filter": (tag_filter, _customer("c_acctbal < 0", "'one' AS rule")),
    "fix_apply": (fix_apply, _customer("c_mktsegment = 'BUILDING' OR c_acctbal < 0", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS segment, c_acctbal < 0 AS zeroed, CAST(c_mktsegment = 'BUILDING' AS INT) + CAST(c_acctbal < 0 AS INT) AS applied, 0 AS skipped")),
    "fix_tally": (fix_tally, "SELECT count(*) AS files_changed, count(*) AS fixes_applied, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS skipped FROM customer"),
    "rule_tests": (rule_tests, "SELECT * FROM (VALUES ('old', 0, 'match', CAST(1 AS BIGINT), true), ('old', 1, 'match', CAST(2 AS BIGINT), true), ('old', 2, 'no_match', CAST(0 AS BIGINT), true), ('old', 3, 'match', CAST(0 AS BIGINT), false)) v(rule, idx, expect, n, passed)"),
    "node_kinds": (node_kinds, "SELECT k AS kind, CAST(count(*) * n AS BIGINT) AS n, CAST(d AS INT) AS deepest FROM customer, (VALUES ('document', 1, 0), ('object', 1, 1), ('pair', 5, 2), ('string', 6, 3), ('string_content', 6, 4), ('number', 4, 3)) v(k, n, d) GROUP BY k, n, d"),
    "language_scan": (language_scan, "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' END AS lang FROM pages"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    checks = {name: partial(_check, corpus, rule, columns) for name, (corpus, rule, columns, _) in CHECKS.items()}
    return checks | {name: f for name, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, _, sql) in CHECKS.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
