"""Business-rule candidates: classification of branches, calculations, repeated rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: verbs of the language, and what names and actions tell about a branch
VERBS = (
    "ACCEPT ADD ALLOCATE ALTER CALL CANCEL CLOSE COMPUTE CONTINUE DELETE DISPLAY DIVIDE ENTRY EVALUATE EXEC EXECUTE EXIT FREE "
    "GENERATE GO GOBACK IF INITIALIZE INITIATE INSPECT INVOKE JSON MERGE MOVE MULTIPLY NEXT OPEN PERFORM READ RELEASE RETURN "
    "REWRITE SEARCH SET SORT START STOP STRING SUBTRACT SUPPRESS TERMINATE UNSTRING USE WRITE XML"
).split()
STATUS = r"(STATUS|STAT|-FS|FILE-STAT|RESP|SQLCODE|SQLSTATE|RETURN-CODE|-RC\b|EIBRESP|DFHRESP)"
ERROR_TEXT = r"(ERR|MSG|MESSAGE|TEXT|REASON|DESC)"
LIMIT_NAME = r"(MAX|MIN|LIMIT|THRESH|CAP|CEILING|FLOOR|TOLERANCE)"
COUNTER = r"(COUNT|CTR|CNT|TOTAL-RECS|-NUM-READ|RECORDS|-SUB\b|-IDX\b|INDEX)"
NUMBER = r"(?<![\w-])[+-]?\d+(\.\d+)?(?![\w-])"
ERROR_ACTION = r"(?i)(ERROR|ABEND|9\d{3}-|FAIL|REJECT)"
ERROR_PARAGRAPH = r"(ERROR|ERR-|ABEND|EXCEPTION|^9\d{3})"
NO_NAMES = "NOT AND OR ZERO ZEROS ZEROES SPACE SPACES EQUAL TO GREATER LESS THAN OTHER TRUE FALSE".split()
NOT_FOUND = r"(?i)'[^']*(NOT FOUND|INVALID|DOES NOT|MISSING)[^']*'"
TECHNICAL = ("error_handling", "control_flow")


def classify(branches: DataFrame) -> DataFrame:
    """branches with category, significance (1 to 5), business and signals.

    branches: kind (IF, WHEN, SEARCH, PHRASE), condition, paragraph, actions ARRAY<STRING>,
    fields ARRAY<STRING>, explained ARRAY<STRUCT<condition, field>>: 88-level names and
    the fields that they test. One ordered CASE; no Python.
    """
    cond, actions, fields = F.col("condition"), F.col("actions"), F.col("fields")
    phrase = F.substring_index(cond, " (", 1)
    affirmed = ~phrase.contains("NOT")
    explained = F.size("explained") > 0
    plain = F.regexp_replace(cond, r"DFH(RESP|VALUE)\s*\(\s*[\w-]+\s*\)", "0")
    words = F.filter(F.regexp_extract_all(plain, F.lit("[A-Z][A-Z0-9-]*"), F.lit(0)), lambda w: ~w.isin(NO_NAMES))
    names = F.transform(words, lambda w: F.coalesce(F.get(F.filter("explained", lambda e: e["condition"] == w), F.lit(0))["field"], w))
    b = branches.withColumn("_names", names).withColumn("_text", F.array_join("actions", " "))
    status = lambda w: w.rlike(STATUS)
    first_status = F.coalesce(F.get("_names", F.lit(0)).rlike(STATUS), F.lit(False))
    all_status = (F.size("_names") > 0) & F.forall("_names", status)
    leads = F.filter(actions, lambda a: a.rlike("^(perform|call|CICS LINK|CICS XCTL)"))
    real = F.size(F.filter(actions, lambda a: a != "continue (no action)"))
    routing = (F.col("kind") == "WHEN") & (F.size(leads) > 0) & (F.size(leads) >= real / 2)
    sets_error = F.exists(actions, lambda a: a.startswith("MOVE '") & F.substring_index(a, " TO ", -1).rlike(ERROR_TEXT))
    rejects = sets_error | F.exists(actions, lambda a: a.rlike(ERROR_ACTION))
    numeric = cond.rlike(NUMBER)
    counters = F.forall(fields, lambda f: f.rlike(COUNTER))
    limit = F.exists(fields, lambda f: f.rlike(LIMIT_NAME)) | (numeric & cond.rlike("[<>]") & ~counters)
    comparisons = F.regexp_count(cond, F.lit("<|>|NOT =|="))
    state = F.exists(actions, lambda a: F.upper(a).startswith("SET ") & F.upper(a).endswith("TO TRUE"))
    is_phrase = F.col("kind") == "PHRASE"

    def told(category, significance, signal: Column | str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(category).alias("category"), lit(significance).alias("significance"), F.array(lit(signal)).alias("signals"))

    rank = F.when(sets_error, 4).otherwise(3)
    verdict = (
        F.when(is_phrase & phrase.contains("AT END") & affirmed, told("control_flow", 1, "end of file"))
        .when(is_phrase & phrase.contains("INVALID KEY") & affirmed, told("error_handling", F.when(F.col("_text").rlike(NOT_FOUND), 3).otherwise(2), "invalid key"))
        .when(is_phrase & phrase.contains("SIZE ERROR"), told("calculation", 3, "size error"))
        .when(is_phrase, told("error_handling", 1, F.concat(phrase, F.lit(" phrase"))))
        .when(first_status | all_status, told("error_handling", 1, "tests a status field"))
        .when(F.col("paragraph").rlike(ERROR_PARAGRAPH), told("error_handling", 2, "inside an error paragraph"))
        .when(routing, told("routing", F.when(explained | cond.contains("'"), 3).otherwise(2), "dispatches"))
        .when(limit, told("limit", rank, F.when(rejects, "rejects beyond a threshold").otherwise("compares with a threshold")))
        .when(rejects, told("validation", rank, F.when(sets_error, "sets an error message").otherwise("routes to error handling")))
        .when(explained, told(F.when(state, "state_change").otherwise("decision"), 3, "uses 88-level names"))
        .when(F.exists(fields, lambda f: f.rlike(COUNTER)) & (comparisons <= 1), told("control_flow", 1, "tests a counter"))
        .when((comparisons > 0) & (cond.contains("'") | numeric), told("decision", 2, "compares with a literal"))
        .otherwise(told("decision", 1, "no business signal"))
    )
    out = b.withColumn("_v", verdict).drop("_names", "_text")
    business = (F.col("_v.significance") >= 3) & ~F.col("_v.category").isin(*TECHNICAL)
    return out.select(*branches.columns, "_v.category", "_v.significance", business.alias("business"), "_v.signals")


def calculations(statements: DataFrame) -> DataFrame:
    """Arithmetic that is no counter: statements (verb, text, writes, reads, phrases) with significance, rounded and size_error."""
    is_counter = F.col("text").rlike("^(ADD|SUBTRACT) 1 (TO|FROM) ") | ((F.size("writes") > 0) & F.forall("writes", lambda w: w.rlike(COUNTER)))
    rounded = F.array_contains(F.split("text", r"\s+"), "ROUNDED")
    kept = statements.where(F.col("verb").isin("COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE") & ~is_counter)
    return kept.withColumns({"rounded": rounded, "size_error": F.col("phrases") > 0, "significance": F.when(rounded | F.col("text").contains("COMPUTE"), 4).otherwise(3)})


def repeated_groups(rules: DataFrame) -> DataFrame:
    """(id, category, condition, members, programs): business rules of one category and condition in more than one place.

    Numbers are ranks by size, category and condition. Only groups of two or more are
    ranked: they sort before all single ones, so their numbers are the same.
    """
    text = F.trim(F.regexp_replace("condition", r"\s+", " "))
    made = rules.where(F.col("business") & ~text.endswith("OTHER")).groupBy("category", text.alias("condition")).agg(F.count("*").alias("members"), F.count_distinct("program").alias("programs"))
    from lodestone.operators.numbering import number_rows

    ranked = number_rows(made.where("members > 1"), [F.desc("members"), "category", "condition"], "_n")
    return ranked.select(F.concat(F.lit("rulegroup:"), "_n").alias("id"), "category", "condition", "members", "programs")


def synthetic(estate) -> DataFrame:
    """Line items as rules."""
    k = F.col("l_partkey")
    cats = F.array(*map(F.lit, ("limit", "validation", "decision")))
    return estate.items().select(
        F.col("l_suppkey").alias("program"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 100 + F.col("pos")).alias("ord"),
        F.element_at(cats, (k % 3 + 1).cast("int")).alias("category"),
        F.concat(F.lit("WS-F"), k % 400, F.lit("  >   "), F.col("l_suppkey") % 7, F.when(k % 50 == 0, " OTHER").otherwise("")).alias("condition"),
        (k % 4 != 0).alias("business"),
    )


def synthetic_branches(estate) -> DataFrame:
    """Parts as branches, put together from conditions, actions and paragraphs."""
    k, n = F.col("p_partkey"), F.col("p_size")

    def pick(values: list[str], by: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))

    fields = ["WS-AMOUNT", "WS-STATUS", "WS-COUNT", "WS-MAX-AMT", "ORD-HELD", "WS-CODE"]
    conditions = ["WS-AMOUNT > 100", "WS-STATUS = '00'", "WS-COUNT > 5", "WS-AMOUNT < = WS-MAX-AMT", "ORD-HELD", "WS-CODE = 'A'", "NOT AT END (READ F)", "AT END (READ F)", "INVALID KEY (READ F)", "ON SIZE ERROR (COMPUTE X)", "WS-CODE = WS-OTHER-CODE"]
    acts = ["MOVE 'NOT FOUND' TO WS-ERR-MSG", "perform 100-PROC", "SET ORD-HELD TO TRUE", "perform 9000-ERROR", "continue (no action)"]
    at = (k % 11).cast("int")
    kind = F.when((at >= 6) & (at <= 9), "PHRASE").when(k % 5 == 0, "WHEN").otherwise("IF")
    field = F.element_at(F.array(*map(F.lit, [*fields, "F", "F", "F", "X", "WS-CODE"])), at + 1)
    none = F.array().cast("array<struct<condition:string,field:string>>")
    return estate.table("part").select(
        k.alias("branch"), kind.alias("kind"), F.element_at(F.array(*map(F.lit, conditions)), at + 1).alias("condition"),
        pick(["1000-MAIN", "9100-ERR", "ABEND-IT", "2000-CALC"], n).alias("paragraph"),
        F.array(pick(acts, n)).alias("actions"), F.array(field).alias("fields"),
        F.when(at == 4, F.array(F.struct(F.lit("ORD-HELD").alias("condition"), F.lit("ORD-FLAG").alias("field")))).otherwise(none).alias("explained"),
    )


