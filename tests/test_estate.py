"""Plans of the estate engine: sources from disk, the golden estate, and every query against its SQL at the smallest scale."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import checks, closure, control_flow, gaps, graph, numbering, rules
from lodestone.plans import golden, oracles, queries
from lodestone.plans.inventory import Inventory, read_member
from lodestone.sources import members

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    found = duck.execute(oracles.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect()) == want


def test_scan_from_disk(spark, tmp_path):
    for path, data in {"cbl/A.CBL": b"x\r\ny", "bin/skip.cbl": b"x", "src/b.txt": b"//S EXEC PGM=X\n", "src/deep/c.cpy": "é".encode(), "old/d.cpy": b"\xe9 caf\xe9", "odd/e.cpy": b"\x81", "n.md": b""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    files = {r.path: r for r in members.catalogue(members.scan(spark, str(tmp_path), exclude_globs=["*deep*"])).collect()}
    assert sorted(files) == ["cbl/A.CBL", "n.md", "odd/e.cpy", "old/d.cpy", "src/b.txt"]
    assert [(files[p].kind, files[p].encoding, files[p].line_ending, files[p].lines, files[p].final_newline) for p in sorted(files)] == [
        ("program", "utf-8", "crlf", 2, False), ("doc", "utf-8", "none", 0, False), ("copybook", "latin-1", "none", 1, False), ("copybook", "cp1252", "none", 1, False), ("jcl", "utf-8", "lf", 1, True),
    ]


def test_a_failing_reader_costs_one_member_only():
    assert [f for f, _ in read_member("x.jcl", "nothing", "text", False)] == ["note"]
    assert [f for f, _ in read_member("x.cbl", "program", " ", True)] == ["member"]


def test_inventory_is_repeatable(spark):
    one, two = (sorted(map(tuple, Inventory(golden.content(spark)).references.drop("issue", "candidates", "candidate_targets").collect()), key=str) for _ in range(2))
    assert one == two


def test_entries_must_be_known_and_single(spark):
    inventory = Inventory(golden.content(spark))
    with pytest.raises(ValueError):
        inventory.scope(["job:NOPE"])
    assert {r.node for r in inventory.scope(["job:PAYJOB"]).collect()} >= {"program:PAYRUN", "dataset:PROD.PAY.IN", "table:TAX_T"}


def test_closure_of_chains_and_cycles(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(14)] + [(14, 0), (20, 20)], "src int, dst int")
    found = {r.node: r.depth for r in closure.closure(edges, spark.createDataFrame([(3,), (20,)], "node int")).collect()}
    assert found == {20: 0} | {(3 + d) % 15: d for d in range(15)}
    assert closure.closure(edges, spark.createDataFrame([], "node int")).count() == 0


def test_reachability_of_paragraphs(spark):
    """Flow ends at terminal paragraphs; a performed range returns; what only dead code performs is dead."""
    paragraphs = spark.createDataFrame([("P", k, k in (1, 4)) for k in range(8)], "program string, ord int, terminal boolean")
    transfers = spark.createDataFrame([("P", 0, "PERFORM", 2, 3), ("P", 3, "GO TO", 6, 6), ("P", 5, "PERFORM", 4, 4)], "program string, ord int, type string, lo int, hi int")
    got = {r.ord: r.reachable for r in control_flow.reachable(paragraphs, transfers).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = numbering.number_rows(df, ["k"], "n").orderBy("k").select("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_branches_are_classified(spark):
    rows = [
        ("IF", "WS-TOTAL > 9999", "P1", ["MOVE 'TOO MUCH' TO WS-ERR-MSG"], ["WS-TOTAL"], "limit", 4),
        ("IF", "CUST-FS NOT = '00'", "P1", ["perform 900-X"], ["CUST-FS"], "error_handling", 1),
        ("WHEN", "WS-CODE = 'A'", "P1", ["perform 100-A"], ["WS-CODE"], "routing", 3),
        ("IF", "WS-NAME = SPACES", "P1", ["MOVE 'NAME MISSING' TO MSG-TEXT"], ["WS-NAME"], "validation", 4),
        ("PHRASE", "INVALID KEY (READ F)", "P1", ["DISPLAY 'CUSTOMER NOT FOUND'"], [], "error_handling", 3),
        ("IF", "WS-CTR = 5", "P1", ["perform X"], ["WS-CTR"], "control_flow", 1),
        ("IF", "EIBRESP = DFHRESP (NORMAL)", "P1", [], ["EIBRESP"], "error_handling", 1),
        ("IF", "WS-A = WS-B", "9000-ERROR", [], ["WS-A"], "error_handling", 2),
    ]
    df = spark.createDataFrame([r[:5] + ([],) for r in rows], "kind string, condition string, paragraph string, actions array<string>, fields array<string>, explained array<struct<condition:string,field:string>>")
    got = {r.condition: (r.category, r.significance) for r in rules.classify(df).collect()}
    assert got == {r[1]: r[5:] for r in rows}


def test_calculations_leave_counters_out(spark):
    df = spark.createDataFrame([("ADD", "ADD 1 TO WS-X", ["WS-X"], [], 0), ("ADD", "ADD WS-A TO WS-TOT", ["WS-TOT"], ["WS-A"], 1), ("COMPUTE", "COMPUTE WS-R ROUNDED = A * B", ["WS-R"], ["A", "B"], 0), ("COMPUTE", "COMPUTE WS-COUNT = 1", ["WS-COUNT"], [], 0)], "verb string, text string, writes array<string>, reads array<string>, phrases int")
    assert {(r.text, r.significance, r.rounded, r.size_error) for r in rules.calculations(df).collect()} == {("ADD WS-A TO WS-TOT", 3, False, True), ("COMPUTE WS-R ROUNDED = A * B", 4, True, False)}


def test_gaps_keep_unknown_codes(spark):
    issues = spark.createDataFrame([("error", "something_new", "m", "program:A", "a", 1, 1), ("info", "name_collision", "m", None, None, None, 2), ("warning", "missing_program", "m", None, None, None, 3)], "severity string, code string, message string, subject string, path string, line int, ord int")
    got = {r.gap_id: (r.severity, r.category, r["count"]) for r in gaps.register(issues).collect()}
    assert got == {"gap:something_new:A": ("high", "Other", 1), "gap:missing_program:system": ("high", "Missing source", 1)}


def test_one_problem_rejects_a_file(spark):
    items = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 3)], "file string, item int")
    assert [r.file for r in checks.accepted(items, spark.createDataFrame([(2, "x")], "item int, problem string")).collect()] == ["f2"]


def test_scripts_for_the_graph(spark):
    nodes = spark.createDataFrame([("program:A", "Program", "it's", False), ("program:B", "Program", 'x,"y"', True)], "id string, label string, name string, missing boolean")
    assert graph.cypher_nodes(nodes, ["name", "missing"]).first().script == "UNWIND [{`id`: 'program:A', `name`: 'it\\'s', `missing`: false}, {`id`: 'program:B', `name`: 'x,\"y\"', `missing`: true}] AS row\nMERGE (n:Program {id: row.id}) SET n += row;"
    assert [r.line for r in graph.csv_rows(nodes, ["name", "missing"]).orderBy("id").collect()] == ["program:A,it's,false,Program", 'program:B,"x,""y""",true,Program']
