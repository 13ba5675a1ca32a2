"""A small estate with every kind of member, whose tables were worked out by hand from its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fixed(*lines: str) -> str:
    return "".join(f"       {line}\r\n" for line in lines)


MEMBERS = {
    "cbl/PAYRUN.cbl": _fixed(
        "IDENTIFICATION DIVISION.", "PROGRAM-ID. PAYRUN.", "ENVIRONMENT DIVISION.", "INPUT-OUTPUT SECTION.", "FILE-CONTROL.", "    SELECT PAY-FILE ASSIGN TO UT-S-PAYIN.", "    SELECT OUT-FILE ASSIGN TO PAYOUT.",
        "DATA DIVISION.", "FILE SECTION.", "FD PAY-FILE.", "COPY PAYREC.", "WORKING-STORAGE SECTION.", "01 WS-RATE-PGM PIC X(8) VALUE 'RATECALC'.", "PROCEDURE DIVISION.", "MAIN-PARA.",
        "    CALL 'TAXCALC' USING PAY-REC.", "    CALL WS-RATE-PGM.", "    CALL 'CEEDATE'.", "    CALL 'GHOST'.", "    GOBACK.",
    ),
    "cbl/TAXCALC.cbl": _fixed(
        "IDENTIFICATION DIVISION.", "PROGRAM-ID. TAXCALC.", "DATA DIVISION.", "LINKAGE SECTION.", "COPY PAYREC.", "PROCEDURE DIVISION USING PAY-REC.",
        "    EXEC SQL SELECT RATE INTO :WS-R FROM TAX_T END-EXEC", "    GOBACK.",
    ),
    "cbl/PAYONL.cbl": _fixed(
        "ID DIVISION.", "PROGRAM-ID. PAYONL.", "PROCEDURE DIVISION.", "    EXEC CICS RECEIVE MAP('PAYMAP') MAPSET('PAYSET') END-EXEC", "    EXEC CICS LINK PROGRAM('TAXCALC') END-EXEC",
        "    EXEC CICS READ FILE('PAYF') INTO(WS-X) END-EXEC", "    EXEC CICS SEND MAP('NOMAP') MAPSET('PAYSET') END-EXEC", "    EXEC CICS RETURN TRANSID('PAY1') END-EXEC", "    GOBACK.",
    ),
    "cpy/PAYREC.cpy": _fixed("01 PAY-REC.", "   05 PAY-ID PIC X(8).", "   05 PAY-AMT PIC S9(7)V99 COMP-3.", "   05 PAY-KIND PIC X.", "      88 PAY-HELD VALUE 'H'."),
    "cpy/OLDREC.cpy": _fixed("01 OLD-REC PIC X."),
    "jcl/PAYJOB.jcl": "\n".join([
        "//PAYJOB  JOB (ACCT),'PAY'", "//STEP1   EXEC PGM=PAYRUN", "//PAYIN   DD DSN=PROD.PAY.IN(+1),DISP=SHR", "//PAYOUT  DD DSN=PROD.PAY.OUT,DISP=(NEW,CATLG)", "//STEP2   EXEC PGM=IDCAMS", "//SYSIN   DD *",
        "  DEFINE CLUSTER (NAME(PROD.PAY.KSDS) KEYS(8 0) RECORDSIZE(80 80))", "/*", "//STEP3   EXEC PAYPROC", "",
    ]),
    "cics/pay.csd": "DEFINE TRANSACTION(PAY1) GROUP(PAY) PROGRAM(PAYONL)\nDEFINE PROGRAM(PAYONL) GROUP(PAY)\nDEFINE FILE(PAYF) DSNAME(PROD.PAY.KSDS)\nDEFINE PROGRAM(LOSTPGM) GROUP(PAY)\n",
    "bms/PAYSET.bms": "PAYSET   DFHMSD TYPE=MAP,MODE=INOUT\nPAYMAP   DFHMDI SIZE=(24,80)\nAMT      DFHMDF POS=(1,2),LENGTH=8\n         DFHMDF POS=(2,2),LENGTH=4\n         DFHMSD TYPE=FINAL\n",
    "ddl/pay.sql": "CREATE TABLE TAX_T (ID CHAR(2) NOT NULL, RATE DECIMAL(5,2), PRIMARY KEY (ID));\nCREATE TABLE EMP_T (ID CHAR(8), TAX CHAR(2),\n  FOREIGN KEY (TAX) REFERENCES TAX_T (ID));\n",
    "doc/readme.md": "",
}

REFERENCES = [
    ("R00001", "CICS_MAP", "program:PAYONL", "map:PAYSET.PAYMAP", "resolved", "cbl/PAYONL.cbl", 4), ("R00002", "CICS_LINK", "program:PAYONL", "program:TAXCALC", "resolved", "cbl/PAYONL.cbl", 5),
    ("R00003", "CICS_FILE", "program:PAYONL", "cics_file:PAYF", "resolved", "cbl/PAYONL.cbl", 6), ("R00004", "CICS_MAP", "program:PAYONL", "map:PAYSET.NOMAP", "unresolved", "cbl/PAYONL.cbl", 7),
    ("R00005", "CICS_RETURN_TRANSID", "program:PAYONL", "transaction:PAY1", "resolved", "cbl/PAYONL.cbl", 8), ("R00006", "COPY", "program:PAYRUN", "copybook:PAYREC", "resolved", "cbl/PAYRUN.cbl", 11),
    ("R00007", "STATIC_CALL", "program:PAYRUN", "program:TAXCALC", "resolved", "cbl/PAYRUN.cbl", 16), ("R00008", "DYNAMIC_CALL", "program:PAYRUN", None, "dynamic", "cbl/PAYRUN.cbl", 17),
    ("R00009", "STATIC_CALL", "program:PAYRUN", "program:CEEDATE", "system", "cbl/PAYRUN.cbl", 18), ("R00010", "STATIC_CALL", "program:PAYRUN", "program:GHOST", "unresolved", "cbl/PAYRUN.cbl", 19),
    ("R00011", "COPY", "program:TAXCALC", "copybook:PAYREC", "resolved", "cbl/TAXCALC.cbl", 5), ("R00012", "SQL_TABLE", "program:TAXCALC", "table:TAX_T", "resolved", "cbl/TAXCALC.cbl", 7),
    ("R00013", "CSD_TRANSACTION", "transaction:PAY1", "program:PAYONL", "resolved", "cics/pay.csd", 1), ("R00014", "CSD_FILE", "cics_file:PAYF", "dataset:PROD.PAY.KSDS", "resolved", "cics/pay.csd", 3),
    ("R00015", "DB2_FOREIGN_KEY", "table:EMP_T", "table:TAX_T", "resolved", "ddl/pay.sql", 2), ("R00016", "JCL_EXEC", "job:PAYJOB", "program:PAYRUN", "resolved", "jcl/PAYJOB.jcl", 2),
    ("R00017", "JCL_DD", "job:PAYJOB", "dataset:PROD.PAY.IN", "resolved", "jcl/PAYJOB.jcl", 3), ("R00018", "PROGRAM_DATASET", "program:PAYRUN", "dataset:PROD.PAY.IN", "resolved", "jcl/PAYJOB.jcl", 3),
    ("R00019", "JCL_DD", "job:PAYJOB", "dataset:PROD.PAY.OUT", "resolved", "jcl/PAYJOB.jcl", 4), ("R00020", "PROGRAM_DATASET", "program:PAYRUN", "dataset:PROD.PAY.OUT", "resolved", "jcl/PAYJOB.jcl", 4),
    ("R00021", "JCL_EXEC", "job:PAYJOB", "utility:IDCAMS", "system", "jcl/PAYJOB.jcl", 5), ("R00022", "IDCAMS_DEFINE", "job:PAYJOB", "dataset:PROD.PAY.KSDS", "resolved", "jcl/PAYJOB.jcl", 7),
    ("R00023", "JCL_PROC", "job:PAYJOB", "proc:PAYPROC", "external", "jcl/PAYJOB.jcl", 9),
]
PROGRAMS = [
    ("program:PAYONL", "online", "", "transaction:PAY1"),
    ("program:PAYRUN", "batch", "", "job:PAYJOB"),
    ("program:TAXCALC", "subroutine", "program:PAYONL,program:PAYRUN", ""),
]
ISSUES = [
    ("info", "dynamic_call", "program:PAYRUN", "cbl/PAYRUN.cbl", 17), ("info", "system_program", "program:PAYRUN", "cbl/PAYRUN.cbl", 18), ("warning", "missing_program", "program:PAYRUN", "cbl/PAYRUN.cbl", 19),
    ("warning", "missing_map", "program:PAYONL", "cbl/PAYONL.cbl", 7), ("info", "external_proc", "job:PAYJOB", "jcl/PAYJOB.jcl", 9), ("warning", "csd_program_without_source", "csd_program:LOSTPGM", "cics/pay.csd", 4),
    ("info", "unused_copybook", "copybook:OLDREC", "cpy/OLDREC.cpy", None),
]
FILES = [
    ("bms/PAYSET.bms", "bms", "lf", 5), ("cbl/PAYONL.cbl", "program", "crlf", 9), ("cbl/PAYRUN.cbl", "program", "crlf", 20), ("cbl/TAXCALC.cbl", "program", "crlf", 8), ("cics/pay.csd", "csd", "lf", 4),
    ("cpy/OLDREC.cpy", "copybook", "crlf", 1), ("cpy/PAYREC.cpy", "copybook", "crlf", 5), ("ddl/pay.sql", "ddl", "lf", 3), ("doc/readme.md", "doc", "none", 0), ("jcl/PAYJOB.jcl", "jcl", "lf", 9),
]
SCOPE = [("transaction:PAY1", 0), ("program:PAYONL", 1), ("map:PAYSET.PAYMAP", 2), ("mapset:PAYSET", 2), ("program:TAXCALC", 2), ("cics_file:PAYF", 2), ("map:PAYSET.NOMAP", 2), ("copybook:PAYREC", 3), ("table:TAX_T", 3), ("dataset:PROD.PAY.KSDS", 3)]
LINKS = [("PAYIN", "PROD.PAY.IN(+1)", "PAY-FILE"), ("PAYOUT", "PROD.PAY.OUT", "OUT-FILE")]

# one program with its copybook, for structure and layout
STRUCTURE = {
    "cbl/SALES.cbl": _fixed(
        "IDENTIFICATION DIVISION.", "PROGRAM-ID. SALES.", "ENVIRONMENT DIVISION.", "INPUT-OUTPUT SECTION.", "FILE-CONTROL.", "    SELECT IN-F ASSIGN TO SALESIN.", "DATA DIVISION.", "FILE SECTION.", "FD IN-F.",
        "COPY SALEREC REPLACING ==:T:== BY ==WS==.", "WORKING-STORAGE SECTION.", "01 EOF-SW PIC X VALUE 'N'.", "   88 AT-EOF VALUE 'Y'.", "01 TOT PIC S9(7)V99 COMP-3.", "01 WS-LIMIT PIC 9(5).", "01 ERR-MSG PIC X(20).",
        "PROCEDURE DIVISION.", "MAIN-P.", "    OPEN INPUT IN-F", "    PERFORM READ-P UNTIL AT-EOF", "    PERFORM CALC-P THRU CALC-X", "    PERFORM STUCK-P UNTIL WS-LIMIT > 5", "    EVALUATE TRUE", "      WHEN TOT > 100", "        MOVE 'TOO BIG' TO ERR-MSG",
        "      WHEN OTHER", "        CONTINUE", "    END-EVALUATE", "    GOBACK.", "READ-P.", "    READ IN-F", "      AT END SET AT-EOF TO TRUE", "      NOT AT END ADD WS-AMT TO TOT", "    END-READ.",
        "CALC-P.", "    IF TOT > 0", "      COMPUTE TOT ROUNDED = TOT * 2", "    ELSE", "      CALL 'SUB' USING LOST-NAME", "    END-IF.", "CALC-X.", "    EXIT.", "STUCK-P.", "    MOVE 1 TO TOT.", "DEAD-P.", "    PERFORM DEAD-P.",
    ),
    "cpy/SALEREC.cpy": _fixed("01 :T:-REC.", "   05 :T:-ID PIC X(8).", "   05 :T:-AMT PIC S9(7)V99 COMP-3.", "   05 :T:-TBL OCCURS 3 TIMES.", "      10 :T:-A PIC 9(4) COMP.", "   05 :T:-R REDEFINES :T:-TBL PIC X(6)."),
    "jcl/SALEJOB.jcl": "//SALEJOB JOB (A)\n//S1 EXEC PGM=SALES\n//SALESIN DD DSN=PROD.SALES,DISP=SHR,LRECL=20,RECFM=FB\n",
}
LAYOUT = [
    ("record:SALEREC/WS-REC", "WS-REC", 0, 19, "group"), ("record:SALEREC/WS-REC", "WS-REC.WS-ID", 0, 8, "alphanumeric"), ("record:SALEREC/WS-REC", "WS-REC.WS-AMT", 8, 5, "numeric"), ("record:SALEREC/WS-REC", "WS-REC.WS-TBL", 13, 2, "group"),
    ("record:SALEREC/WS-REC", "WS-REC.WS-TBL.WS-A", 13, 2, "numeric"), ("record:SALEREC/WS-REC", "WS-REC.WS-R", 13, 6, "alphanumeric"), ("record:SALES/EOF-SW", "EOF-SW", 0, 1, "alphanumeric"), ("record:SALES/TOT", "TOT", 0, 5, "numeric"),
    ("record:SALES/WS-LIMIT", "WS-LIMIT", 0, 5, "numeric"), ("record:SALES/ERR-MSG", "ERR-MSG", 0, 20, "alphanumeric"),
]
PARAGRAPHS = [("MAIN-P", True, 4), ("READ-P", True, 3), ("CALC-P", True, 2), ("CALC-X", True, 1), ("STUCK-P", True, 1), ("DEAD-P", False, 1)]
PARSE_ISSUES = [("info", "dead_paragraph", 45), ("warning", "recursive_perform", 45), ("warning", "undefined_data_name", 39)]
BRANCHES = [
    ("PHRASE", "AT END (READ IN-F)", "READ-P", "control_flow", 1), ("PHRASE", "NOT AT END (READ IN-F)", "READ-P", "error_handling", 1), ("WHEN", "TOT > 100", "MAIN-P", "limit", 4), ("WHEN", "OTHER", "MAIN-P", "decision", 1),
    ("IF", "TOT > 0", "CALC-P", "limit", 3),
]
LOOPS = [(20, "until", "AT-EOF", "condition_updated_in_loop"), (22, "until", "WS-LIMIT > 5", "potential_infinite")]
FLOWS = [("program:SALES", "dataset:PROD.SALES", "read")]
RULES = [("rule:SALES:24", "limit", True), ("rule:SALES:26", "decision", False), ("rule:SALES:31", "control_flow", False), ("rule:SALES:31.2", "error_handling", False), ("rule:SALES:33", "calculation", True), ("rule:SALES:36", "limit", True), ("rule:SALES:37", "calculation", True)]


def content(spark: SparkSession, given: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in (given or MEMBERS).items()], "path string, content binary")


def values(rows: list[tuple], columns: str) -> str:
    """A SELECT of the rows, for the oracle."""
    def lit(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"
