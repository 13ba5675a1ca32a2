"""Programs of the golden estate beyond what the queries show: renderings, SQL checks, diagrams, the graph, exports, the command line."""

import pytest

from lodestone.__main__ import main
from lodestone.operators.mermaid import lint
from lodestone.plans import export, golden, validate
from lodestone.plans.diagrams import Diagrams
from lodestone.plans.inventory import Inventory
from lodestone.plans.logic import Logic
from lodestone.plans.programs import Programs, parse
from lodestone.plans.property_graph import PropertyGraph
from lodestone.plans.synthesis import Synthesis


@pytest.fixture(scope="module")
def logic(spark):
    return Logic(Programs(Inventory(golden.content(spark, golden.MEMBERS | golden.STRUCTURE))))


@pytest.fixture(scope="module")
def graph(logic):
    return PropertyGraph(logic)


def text(*lines):
    """Lines of fixed format; what is too long for its columns goes on in the next line at a blank."""
    out = []
    for line in lines:
        while len(line) > 65:
            cut = line.rindex(" ", 0, 65)
            out.append(line[:cut])
            line = "    " + line[cut:].strip()
        out.append(line)
    return golden._fixed(*out).replace("\r", "")


def facts(source, kind, **copybooks):
    rows = parse("p.cbl", source, [{"member": k, "path": f"{k}.cpy", "text": v} for k, v in copybooks.items()])
    return [r for f, r in rows if f == kind]


PROC = ("IDENTIFICATION DIVISION.", "PROGRAM-ID. P.", "PROCEDURE DIVISION.")


def test_copies_nest_and_end(spark):
    a = text("01 A-REC.", "COPY B REPLACING LEADING ==X== BY ==Y==.", "COPY A.")
    b = text("   05 X-ONE PIC X.", "   05 ONE-X PIC 9.")
    source = text("DATA DIVISION.", "WORKING-STORAGE SECTION.", "COPY A.", "COPY GONE.", "EXEC SQL INCLUDE SQLCA END-EXEC.")
    assert [(x["member"], x["status"], x["depth"]) for x in facts(source, "expansion", A=a, B=b)] == [("A", "expanded", 0), ("B", "expanded", 1), ("A", "recursive", 1), ("GONE", "missing", 0), ("SQLCA", "system", 0)]
    assert [f["qualified_name"] for f in facts(source, "field", A=a, B=b)] == ["A-REC", "A-REC.Y-ONE", "A-REC.ONE-X"]


def test_layout_of_usages_and_overlays():
    source = text(
        "DATA DIVISION.", "WORKING-STORAGE SECTION.", "01 R.", "  05 A PIC X(3).", "  05 B PIC S9(5) COMP.", "  05 C COMP-3.", "    10 C1 PIC 9(4).", "    10 C2 PIC S9(7)V99.", "  05 D OCCURS 2 TO 4 TIMES DEPENDING ON A INDEXED BY IX.",
        "    10 D1 PIC 9(2)PP.", "    10 D2 USAGE INDEX.", "  05 E REDEFINES D PIC X(30).", "  05 F PIC S9(3) SIGN IS TRAILING SEPARATE CHARACTER.", "  05 G PIC N(4).", "  05 H REDEFINES NOPE PIC X.", "66 Z RENAMES A THRU B.", "77 S PIC X(2) VALUE 'ABC'.",
        "77 T PIC 9(2) VALUE 123.", "77 U PIC 9 VALUE 'A'.", "01 V.",
    )
    got = {f["qualified_name"]: (f["offset"], f["size"]) for f in facts(source, "field")}
    assert got["R.B"] == (3, 4) and got["R.C"] == (7, 8) and got["R.C.C2"] == (10, 5) and got["R.D"] == (15, 6) and got["R.E"] == (15, 30) and got["R.F"] == (39, 4) and got["R.G"] == (43, 8) and got["R"] == (0, 52)
    assert sorted(p["code"] for p in facts(source, "problem")) == ["empty_record", "nonnumeric_value_for_numeric", "redefines_larger_than_target", "redefines_target_missing", "value_too_large", "value_too_long"]


def test_statements_and_their_data():
    source = text(
        *PROC, "A-SECT SECTION.", "P1.", "    MOVE X OF R TO Y Z", "    ADD A TO B GIVING C REMAINDER D", "    STRING A DELIMITED BY SIZE INTO B", "    PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3 AFTER J FROM 1 BY 1 UNTIL J > 4", "      DISPLAY I", "    END-PERFORM",
        "    PERFORM 3 TIMES EXIT PERFORM CYCLE END-PERFORM", "    SEARCH ALL T AT END CONTINUE WHEN K = 1 NEXT SENTENCE END-SEARCH", "    GO TO P1 P2 DEPENDING ON N", "    EXEC SQL SELECT A INTO :H FROM T WHERE K = :G END-EXEC", "    CALL V USING BY REFERENCE W ON EXCEPTION STOP RUN END-CALL",
        "    EVALUATE A ALSO B WHEN 1 ALSO 2 WHEN 3 ALSO ANY MOVE 1 TO E WHEN OTHER GOBACK END-EVALUATE.", "P2 SECTION.", "P3.", "    ALTER P1 TO PROCEED TO P3.", "    SORT F INPUT PROCEDURE IS P1 THRU P3.",
    )
    st = facts(source, "statement")
    flow = {s["verb"]: (s["reads"], s["writes"]) for s in st}
    assert flow["ADD"] == (["A", "B"], ["C", "D"]) and flow["STRING"] == (["A"], ["B"]) and flow["EXEC"] == (["G"], ["H", "SQLCODE", "SQLSTATE"]) and flow["CALL"] == (["W", "V"], ["W"])
    assert next(s for s in st if s["verb"] == "MOVE")["writes"] == ["Y", "Z"] and next(s for s in st if s.get("loop") == "varying")["writes"] == ["I", "J"] and next(s for s in st if s.get("loop") == "varying")["condition"] == "I > 3"
    assert [s["verb"] for s in st if s["depth"] == 1] == ["DISPLAY", "EXIT PERFORM", "CONTINUE", "NEXT SENTENCE", "STOP RUN", "MOVE", "GOBACK"]
    assert [(b["conditions"], b["other"]) for b in facts(source, "branch")] == [(["K = 1"], False), (["1 ALSO 2", "3 ALSO ANY"], False), ([], True)]
    assert [(t["type"], t["target"], t["thru"]) for t in facts(source, "transfer")] == [("GO TO", "P1", None), ("GO TO", "P2", None), ("ALTER", "P3", None), ("SORT INPUT PROCEDURE", "P1", "P3")]
    assert [p["name"] for p in facts(source, "paragraph")] == ["P1", "P3"] and [s["name"] for s in facts(source, "section")] == ["A-SECT", "P2"]


def test_broken_programs_are_told():
    source = text(*PROC, "P1.", "    PERFORM", "      DISPLAY 'X'.", "    FROBNICATE X.", "    END-IF.", "    COMPUTE A = FUNCTION BOGUS (1).")
    assert sorted(p["code"] for p in facts(source, "problem")) == ["inline_perform_without_end_perform", "unexpected_token", "unrecognised_statement"] and [f["name"] for f in facts(source, "function")] == ["BOGUS"]
    assert facts(None, "program")[0]["status"] == "failed"


def test_pseudocode_and_outline(logic):
    lines = [r.text for r in logic.programs.table("pseudocode").where("of = 'program:SALES' and paragraph in (0, 1)").orderBy("row").collect()]
    assert lines == [
        "OPEN INPUT IN-F", "WHILE NOT (AT-EOF   [AT-EOF means EOF-SW = Y]): DO READ-P", "DO CALC-P THRU CALC-X", "WHILE NOT (WS-LIMIT > 5): DO STUCK-P", "SELECT CASE TRUE", "CASE TOT > 100", "SET ERR-MSG = 'TOO BIG'", "OTHERWISE", "CONTINUE", "END-SELECT", "RETURN TO CALLER",
        "READ IN-F", "ON AT END:", "SET AT-EOF TO TRUE", "ON NOT AT END:", "ADD WS-AMT TO TOT",
    ]
    outline = [(r.kind, r.target, r.parent, list(r.when)) for r in logic.programs.table("outline").where("of = 'program:SALES'").orderBy("id").collect()]
    assert outline == [("perform", "READ-P", None, []), ("perform", "CALC-P", None, []), ("call", "SUB", 1, ["NOT (TOT > 0)"]), ("perform", "STUCK-P", None, []), ("end", "GOBACK", None, [])]


def test_sql_against_tables(spark):
    given = {
        "c/Q.cbl": text(
            "IDENTIFICATION DIVISION.", "PROGRAM-ID. Q.", "DATA DIVISION.", "WORKING-STORAGE SECTION.", "01 H-ID PIC X(8).", "01 H-BAD PIC X(3).", "01 H-REC.", "   05 H1 PIC X.", "   05 H2 PIC X.", "PROCEDURE DIVISION.", "P1.",
            "    EXEC SQL SELECT ID, AMT INTO :H-ID, :H-BAD FROM S.T WHERE NOPE = :H-ID END-EXEC", "    EXEC SQL INSERT INTO T (ID, AMT) VALUES (:H-ID) END-EXEC", "    EXEC SQL SELECT ID, AMT INTO :H-REC FROM T END-EXEC", "    GOBACK.",
        ),
        "d/t.sql": "CREATE TABLE T (ID CHAR(8), AMT DECIMAL(9,2));",
    }
    got = Programs(Inventory(golden.content(spark, given))).sql_problems
    assert sorted((r.code, r.line) for r in got.collect()) == [("host_variable_type_mismatch", 12), ("sql_column_count_mismatch", 14), ("unknown_column", 12)]


def test_diagrams_are_clean(logic):
    drawn = Diagrams(logic)
    assert drawn.problems().collect() == []
    names = {r.diagram for r in drawn.all.select("diagram").distinct().collect()}
    assert names == {"system_context", "data_lineage", "erd", "job_PAYJOB", "job_SALEJOB", *(f"program_{p}_paragraphs" for p in ("PAYRUN", "TAXCALC", "PAYONL", "SALES"))}
    context = [r.line for r in drawn.context.orderBy("ord").collect()]
    assert context[3] == "flowchart LR" and '  transaction_PAY1 -->|"starts"| program_PAYONL' in context and '  program_PAYRUN -.->|"CALL"| program_GHOST' in context
    assert '  TAX_T ||--o{ EMP_T : "TAX"' in [r.line for r in drawn.model.collect()]


def test_lint_finds_mistakes(spark):
    rows = [("a", 1, "flowchart TD"), ("a", 2, '  x["one]'), ("a", 3, "  x --> y"), ("a", 4, "  what is this"), ("b", 1, "nothing"), ("c", 1, "---"), ("d", 1, "sequenceDiagram"), ("d", 2, "participant A"), ("d", 3, "A->>B: hi"), ("d", 4, "loop x")]
    got = {(r.diagram, r.problem.split(":")[0]) for r in lint(spark.createDataFrame(rows, "diagram string, ord int, line string")).collect()}
    assert got == {("a", "unbalanced quotes"), ("a", "edge uses undeclared node y"), ("a", "unrecognised line"), ("b", "the first line declares no diagram type"), ("c", "front matter is not closed"), ("d", "message uses undeclared participant B"), ("d", "1 blocks opened but 0 closed")}


def test_graph_answers(graph):
    assert {(r.program, r.paragraph) for r in graph.unreachable_paragraphs().collect()} == {("SALES", "DEAD-P")}
    assert {(r.store, r.access, r.programs) for r in graph.readers_and_writers().collect()} >= {("PROD.SALES", "READS", "SALES"), ("TAX_T", "READS", "TAXCALC"), ("PAYF", "READS", "PAYONL")}
    assert [(r.name, r.complexity) for r in graph.most_complex(1).collect()] == [("SALES", 7)]
    assert {r.chain for r in graph.chains("SALES").collect()} == {"MAIN-P>READ-P", "MAIN-P>CALC-P", "MAIN-P>CALC-X", "MAIN-P>STUCK-P"}
    assert {(r.qualified_name, r.offset) for r in graph.fields_of("WS-REC").collect()} == {("WS-REC.WS-ID", 0), ("WS-REC.WS-AMT", 8), ("WS-REC.WS-TBL", 13), ("WS-REC.WS-TBL.WS-A", 13), ("WS-REC.WS-R", 13)}
    assert {(r.owner_kind, r.owner) for r in graph.uses_of_field("PAY-AMT").collect()} == {("Copybook", "PAYREC")}
    assert {(r.map, r.missing) for r in graph.screens().collect()} == {("PAYMAP", False), ("PAYSET.NOMAP", True)}
    assert {r.rule for r in graph.rules_of("SALES").collect()} == {"rule:SALES:24", "rule:SALES:33", "rule:SALES:36", "rule:SALES:37"} and graph.rules_that_never_run().count() == 0
    assert {r.affects for r in graph.urgent_gaps().where("gap = 'gap:missing_program:PAYRUN'").collect()} == {"PAYRUN"}


def test_nothing_is_wrong(graph):
    assert validate.everything(graph).collect() == []


def test_document_and_annotations(graph, spark):
    made = Synthesis(graph, "pay")
    lines = [r.line for r in made.document.orderBy("ord").collect()]
    assert lines[0] == "# Business requirements: pay" and "## 8. Gaps and risks" in lines and "| transaction:PAY1 | online transaction | PAYONL | cics/pay.csd |" in lines
    items = spark.createDataFrame(
        [("good", 1, "program:SALES", "summary", "sells", "high", [(None, "cbl/SALES.cbl", 3)]), ("bad", 2, "program:SALES", "note", "x", "low", [(None, "cbl/SALES.cbl", 999)]), ("bad", 3, "program:SALES", "note", "y", "low", [("program:SALES", None, None)])],
        "file string, item bigint, target string, kind string, text string, confidence string, evidence array<struct<id:string,path:string,line:int>>",
    )
    kept, problems = made.annotations(items)
    assert [r.item for r in kept.collect()] == [1] and [(r.item, r.problem) for r in problems.collect()] == [(2, "evidence line does not exist")]


def test_command_line(spark, tmp_path, capsys):
    for path, body in golden.MEMBERS.items():
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_bytes(body.encode())
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert main(["inventory", "--root", root, "--entry", "PAY1"], spark) == 0 and "program:TAXCALC" in capsys.readouterr().out
    assert main(["inventory", "--root", root, "--entry", "NOPE"], spark) == 2
    assert main(["validate-inventory", "--root", root, "--out", out], spark) == 0


def test_graph_exports(graph, spark, tmp_path):
    export.write_graph_csv(graph, str(tmp_path / "csv"))
    export.write_cypher(graph, str(tmp_path / "script"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/nodes/Program")).where("`id:ID` = 'program:SALES'").count() == 1
    assert any("CREATE CONSTRAINT program_id" in r.value for r in spark.read.text(str(tmp_path / "script")).collect())
