"""Queries over tables that the small ones don't stand for: rare values, and documents that grow with the table."""

import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import against_sql

from arborql import catalog
from arborql.langs import language
from arborql.langs.index import SMALL, Tree
from arborql.operators.findings import check, file_findings, selected, to_do
from arborql.plans.compile import compile_rule
from arborql.rules import read_rules
from arborql.sources import documents, nodes


def customers(folder, balances, nations=25):
    """A folder with the table customer, one row for each balance."""
    n = len(balances)
    segments = ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
    columns = {"c_custkey": pa.array(range(n), pa.int64()), "c_name": [f"Customer#{k:09}" for k in range(n)], "c_nationkey": pa.array([k * 7 % nations for k in range(n)], pa.int32()), "c_acctbal": pa.array(balances, pa.float64()), "c_mktsegment": [segments[(k * k + k // 7) % 5] for k in range(n)]}
    pq.write_table(pa.table(columns), f"{folder}/customer.parquet")
    return str(folder)


def test_a_balance_of_minus_zero_is_not_negative(spark, tmp_path):
    folder = customers(tmp_path, [-0.0, 0.0, -0.01, 5.0, -999.99, -0.5, -10.0])
    got, want = against_sql(spark, catalog.queries()["query_match"], catalog.oracle_sql()["query_match"], folder)
    assert got == want and len(got) == 4


def nation(n):
    """A nation's document as the catalog writes it, of ``n`` customers."""
    segments = ["BUILDING", "MACHINERY", "AUTOMOBILE"]
    return '{"nation": 1, "customers": [\n' + ",\n".join(f'{{"id":{k},"segment":"{segments[k % 3]}","balance":{k % 90 - 9}.5}}' for k in range(n)) + "\n]}"


def lines(n):
    return "".join(f'{{"c_custkey":{k},"c_mktsegment":"BUILDING"}}\n' for k in range(n))


def rule_of(name):
    return catalog.CHECKS[name][1] if name in catalog.CHECKS else {"folder_scan": 'rule r { in json pattern { "c_custkey": $I } }', "report_json": 'rule r { in json tags t pattern { "nation": $N } note "n" }'}[name]


LARGE = ["rel_not_inside", "rel_directly_inside", "folder_scan", "rel_directly_has", "rel_has", "report_json", "query_test", "where_is", "any_test", "rel_not_has", "rel_inside_capture", "rel_inside", "rel_not_directly_has", "rel_has_first", "rel_not_directly_inside", "where_is_not"]


@pytest.mark.parametrize("name", LARGE)
def test_memory_of_a_large_document(name):
    """Parsing it and finding all that a rule finds takes a few times 20 bytes a node; objects for nodes took over 500."""
    source, (rule,) = lines(8000) if name == "folder_scan" else nation(5000), read_rules(rule_of(name))
    lang, (c,) = language("json"), compile_rule(rule)
    list(file_findings(Tree(lang.read("[{}]"), "[{}]", lang), [(0, c)]))
    tracemalloc.start()
    tree = Tree(lang.read(source), source, lang)
    found = sum(1 for _ in file_findings(tree, [(0, c)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and len(tree.nodes) > 100_000
    assert peak < 100 * len(tree.nodes), peak / len(tree.nodes)


SAME = [*LARGE, "rel_precedes", "rel_not_follows", "rel_directly_precedes", "rel_not_directly_follows", "rel_nearest_capture", "seq_variadic", "where_count_gt", "where_length_ge", "language_filter"]


@pytest.mark.parametrize("name", SAME)
def test_large_documents_against_sql(spark, tmp_path, name):
    """Documents over the size from which trees keep less."""
    folder = customers(tmp_path, [k * 37 % 1999 / 2 - 200.25 for k in range(2400)], nations=3)
    assert len(Tree(language("json").read(nation(800)), nation(800), language("json")).nodes) > SMALL
    got, want = against_sql(spark, catalog.queries()[name], catalog.oracle_sql()[name], folder)
    assert got == want and got


def test_node_columns_are_made_as_asked_for(spark, tmp_path):
    corpus = catalog.customers(spark, customers(tmp_path, [1.0, -2.5, -0.0]))
    every = nodes(corpus)
    for columns in (["kind", "depth"], ["file_id", "path", "text"], ["lang"], ["named", "file_id", "pre", "stop", "rel_ord"]):
        few = nodes(corpus, columns)
        assert few.columns == columns and sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, every.select(*columns).collect()), key=str)
    with pytest.raises(ValueError, match="no such columns"):
        nodes(corpus, ["kinds"])


@pytest.mark.parametrize(
    ("lang", "rule", "works"),
    [
        ("yaml", catalog.CHECKS["seq_pattern"][1], [0]),
        ("yaml", catalog.CHECKS["suppress_lines"][1], [0, 1]),
        ("yaml", "rule r { in yaml any { pattern { status: F } pattern { status: O } } }", [0, 1, 2, 3, 4]),
        ("yaml", "rule r { in yaml pattern { status: $S } not pattern { status: F } not inside pattern { priority: 3-LOW } }", [0, 1, 2, 3, 4]),
    ],
)
def test_only_files_with_all_the_texts_of_a_pattern_are_parsed(spark, lang, rule, works):
    """A file with its longest word alone has no work for a rule; what is found stays the same."""
    rows = [(0, "status: F\npriority: 1-URGENT\n"), (1, "status: P\npriority: 1-URGENT\n"), (2, "status: F\npriority: 2-HIGH\n"), (3, "priority: 3-LOW\nstatus: O\n"), (4, "# F\nstatus: O\npriority: 2-HIGH\n")]
    files, rules = documents(spark.createDataFrame(rows, "id long, src string"), "id", "src", lang), read_rules(rule)
    todo = files.withColumn("todo", to_do(selected(rules))).where("size(todo) > 0")
    assert sorted(r["file_id"] for r in todo.collect()) == works
    rows = [sorted(map(str, check(files, rules, prefilter=p).collect())) for p in (True, False)]
    assert rows[0] == rows[1] and rows[0]
