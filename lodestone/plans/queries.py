"""The queries of the estate engine over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import cobol_lines, picture
from lodestone.operators import checks, closure, control_flow, edges, gaps, graph, layout_checks, lineage, numbering, resolve, rules
from lodestone.plans import golden
from lodestone.plans.estate import Estate
from lodestone.plans.inventory import Inventory
from lodestone.plans.logic import Logic
from lodestone.plans.programs import Programs
from lodestone.sources import members, settled
from lodestone.sources.readers import vocabulary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id"), F.lit("."), F.coalesce("lang", F.lit(""))).alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[Estate, DataFrame]:
    e = Estate(spark, sf_dir)
    known = resolve.names(programs=e.programs(), copybooks=e.copybooks(), csd=e.csd(), tables=e.tables())
    return e, resolve.resolve(e.references(), known)


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[Estate, DataFrame]:
    """Resolved references, with the ordinal of emission for an id where only order matters."""
    e, refs = _resolved(spark, sf_dir)
    return e, refs.withColumn("ref_id", F.struct("path", "line", "type", F.coalesce("target", F.lit("")).alias("t"), "ord"))


# members and lines


@query
def file_catalog(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("path", F.encode("text", "UTF-8").alias("content"))
    return members.catalogue(docs).select("path", "kind", "size_bytes", F.col("lines").cast("bigint").alias("lines"), "sha256", "encoding", "line_ending", "final_newline")


@query
def classify_by_extension(spark, sf_dir):
    p = Estate(spark, sf_dir).table("part")
    extensions = ["cbl", "cpy", "jcl", "csd", "bms", "sql", "ams", "ctl", "md", "xyz", "prc", "dcl"]
    path = F.concat(F.lit("a.b/"), F.regexp_replace("p_name", " ", "_"), F.lit("."), F.element_at(F.array(*map(F.lit, extensions)), (F.col("p_partkey") % 12 + 1).cast("int")))
    return p.select("p_partkey", path.alias("path"), members.classify(path, F.lit("")).alias("kind"))


@query
def sniff_content(spark, sf_dir):
    """Texts with a header of some kind in front, as members without a telling extension."""
    headers = ["//STEP1 EXEC PGM=X", "       IDENTIFICATION DIVISION.", "MAP1 DFHMSD TYPE=MAP", " DEFINE TRANSACTION (AB)", "CREATE TABLE T (A INT)", " DEFINE CLUSTER (NAME(X))", "       01  REC-A.\n           05 A PIC X.", "plain", " DEFINE GDG (NAME(A.B))"]
    docs = _documents(spark, sf_dir)
    head = F.element_at(F.array(*map(F.lit, headers)), (F.col("doc_id") % 9 + 1).cast("int"))
    return docs.select("doc_id", F.coalesce(members.sniff(F.concat(head, F.lit("\n"), "text")), F.lit("none")).alias("kind"))


@query
def line_endings(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    turned = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\r\n\n"))).otherwise(F.col("text"))
    return docs.select("doc_id", members.line_ending(turned).alias("line_ending"), members.line_count(turned).cast("bigint").alias("lines"))


@query
def blank_members(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    text = F.when(F.col("doc_id") % 10 == 0, " \n\t").otherwise(F.col("text"))
    return docs.where(members.is_blank(text)).select("doc_id")


@query
def format_votes(spark, sf_dir):
    """Each text's lines, moved to where fixed format would have them for half of the texts."""
    docs = _documents(spark, sf_dir)
    moved = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("       "), F.replace("text", F.lit("\n"), F.lit("\n       ")))).otherwise(F.col("text")))
    return cobol_lines.format_votes(cobol_lines.explode_lines(moved, id_col="doc_id"), "doc_id")


@query
def keyword_hits(spark, sf_dir):
    """How often verbs of the vocabulary occur in all texts."""
    words = _documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z0-9-]+"), F.lit(0))).alias("word"))
    verbs = spark.createDataFrame([(w,) for w in rules.VERBS], "word string")
    return words.join(F.broadcast(verbs), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


# pictures and storage


@query
def picture_analysis(spark, sf_dir):
    """Pictures put together from part sizes."""
    p = Estate(spark, sf_dir).table("part")
    n, m = F.col("p_size").cast("string"), (F.col("p_partkey") % 9 + 1).cast("string")
    shapes = [F.concat(F.lit("S9("), n, F.lit(")V9("), m, F.lit(")")), F.concat(F.lit("X("), n, F.lit(")")), F.concat(F.lit("9("), m, F.lit(")PP")), F.concat(F.lit("ZZ,ZZ9.99CR")), F.concat(F.lit("A("), m, F.lit(")B")), F.concat(F.lit("N("), n, F.lit(")")), F.concat(F.lit("VPP9("), m, F.lit(")"))]
    pic = F.element_at(F.array(*shapes), (F.col("p_partkey") % 7 + 1).cast("int"))
    usages = ["DISPLAY", "COMP", "COMP-3", "COMP-5", "COMP-1"]
    usage = F.element_at(F.array(*map(F.lit, usages)), (F.col("p_partkey") % 5 + 1).cast("int"))
    told = p.select("p_partkey", pic.alias("pic"), usage.alias("usage")).withColumn("a", picture.analyse(F.col("pic")))
    return told.select("p_partkey", "pic", "usage", "a.category", "a.positions", "a.digits", "a.scale", "a.signed", picture.storage_bytes(F.col("a"), F.col("usage"), F.lit(True)).alias("bytes"))


# resolution


@query
def resolve_references(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return refs.select("ord", "type", "from_id", "target", "to_id", "resolution")


@query
def resolve_copy(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return refs.where("type = 'COPY'").select("ord", "target", "resolution", F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("candidates"))


@query
def missing_member_issues(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return refs.where("issue is not null").groupBy(F.col("issue.severity").alias("severity"), F.col("issue.code").alias("code"), "target").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query
def table_suffix_resolution(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return refs.where("type = 'SQL_TABLE'").groupBy("target", "to_id", "resolution").agg(F.count("*").alias("n"))


@query
def reference_ids(spark, sf_dir):
    refs = Estate(spark, sf_dir).references()
    numbered = numbering.number_rows(refs, ["path", "line", "type", F.coalesce("target", F.lit("")), "ord"], "_n")
    return numbered.select(F.format_string("R%05d", "_n").alias("ref_id"), "ord", "type")


@query
def first_wins_dedup(spark, sf_dir):
    refs = Estate(spark, sf_dir).references().select("from_id", "type", "target", "ord")
    return numbering.first_wins(refs, ["from_id", "type"], ["ord"])


# edges and what follows from them


@query
def edge_aggregate(spark, sf_dir):
    _, refs = _numbered(spark, sf_dir)
    return edges.aggregate_edges(refs).select("from_id", "to_id", "type", "resolution", "count")


@query
def graph_nodes(spark, sf_dir):
    e, refs = _numbered(spark, sf_dir)
    defined = e.programs().select("id", F.lit("program").alias("kind"), "name", "path").union(e.copybooks().select("id", F.lit("copybook"), "member", "path"))
    return edges.nodes(defined, refs).groupBy("kind", "status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.count("path").alias("with_path"))


@query
def called_by(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return edges.called_by(settled.settle(refs, "refs")).select("id", F.array_join("called_by", ",").alias("called_by"))


@query
def copybook_caller_expansion(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return edges.members_behind(refs)


@query
def executed_by(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return edges.executed_by(refs).select("id", F.array_join("executed_by", ",").alias("executed_by"))


@query
def copybook_map(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    return edges.used_by(refs).select("id", F.array_join("used_by", ",").alias("used_by"))


@query
def program_kind(spark, sf_dir):
    e, refs = _resolved(spark, sf_dir)
    told = edges.classify_programs(e.programs(), settled.settle(refs, "refs"), e.csd().where("type = 'PROGRAM'"))
    return told.select("id", "path", "kind", "entry_point")


@query
def unreached_programs(spark, sf_dir):
    e, refs = _resolved(spark, sf_dir)
    csd = e.csd().where("type = 'PROGRAM'")
    return edges.unreached_issues(edges.classify_programs(e.programs(), settled.settle(refs, "refs"), csd), csd).select("subject", "path", "code", "severity")


@query
def unused_copybooks(spark, sf_dir):
    e, refs = _resolved(spark, sf_dir)
    return edges.unused_copybooks(e.copybooks(), refs).select("id", "path")


@query
def name_collision(spark, sf_dir):
    """Programs and copybooks that share a name, where copybooks are named like programs."""
    e = Estate(spark, sf_dir)
    return edges.name_collisions(e.programs(), e.copybooks().withColumn("member", F.replace("member", F.lit("CPY"), F.lit("PGM"))))


@query
def duplicate_program_ids(spark, sf_dir):
    return edges.duplicate_programs(Estate(spark, sf_dir).programs()).select("program_id", "files", F.array_join("paths", ",").alias("paths"))


@query
def attach_check(spark, sf_dir):
    """With every 7th static call turned into an attach call."""
    e, refs = _resolved(spark, sf_dir)
    turned = refs.withColumn("target", F.when((F.col("type") == "STATIC_CALL") & (F.col("ord") % 7 == 0), "DSNALI").otherwise(F.col("target")))
    return edges.without_attach(e.programs(), turned).select("subject", "from_id", "path", "line")


@query
def csd_programs_without_source(spark, sf_dir):
    e = Estate(spark, sf_dir)
    known = resolve.program_names(e.programs().where("scanned"))
    return e.csd().where("type = 'PROGRAM'").join(known, "name", "left_anti").select("name", "line")


@query
def conflicting_definitions(spark, sf_dir):
    """Suppliers' parts as clusters: one name a nation, shapes from balances."""
    s = Estate(spark, sf_dir).table("supplier")
    shapes = s.select(
        F.concat(F.lit("CL."), "s_nationkey", F.lit("."), F.col("s_suppkey") % 7).alias("name"), F.lit("CLUSTER").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, "KSDS").alias("organization"),
        (F.col("s_suppkey") % 3).alias("key_length"), F.lit(0).alias("key_offset"), F.lit(None).cast("int").alias("record_size_max"),
    )
    return edges.conflicting_clusters(shapes)


# reachability


@query
def scope_reachability(spark, sf_dir):
    _, refs = _numbered(spark, sf_dir)
    return edges.scope(edges.aggregate_edges(refs), spark.createDataFrame([("transaction:T1",)], "node string")).select("node", "depth")


@query
def bounded_impact(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    calls = refs.where("to_id is not null and type in ('STATIC_CALL', 'CSD_TRANSACTION', 'COPY')").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return closure.hops(calls, spark.createDataFrame([("transaction:T1",), ("transaction:T4",)], "node string"), 5)


@query
def recursion_cycles(spark, sf_dir):
    performs = control_flow.synthetic(Estate(spark, sf_dir))[1].where("type = 'PERFORM'")
    return closure.reaches_itself(control_flow.range_members(performs).select("program", F.col("ord").alias("src"), F.col("member").alias("dst")), ["program"])


# control flow


@query
def perform_thru_range(spark, sf_dir):
    performs = control_flow.synthetic(Estate(spark, sf_dir))[1].where("type = 'PERFORM'")
    return control_flow.range_members(performs).select("program", "ord", "member", "backwards")


@query
def fall_through(spark, sf_dir):
    return control_flow.fall_through(control_flow.synthetic(Estate(spark, sf_dir))[0])


@query
def cfg_reachability(spark, sf_dir):
    paragraphs, transfers = control_flow.synthetic(Estate(spark, sf_dir))
    return control_flow.reachable(paragraphs, transfers)


@query
def cyclomatic(spark, sf_dir):
    """Statements from line items: one a line, with a verb by its part."""
    st = control_flow.synthetic_statements(Estate(spark, sf_dir))
    return control_flow.complexity(st)


@query
def statement_metrics(spark, sf_dir):
    st = control_flow.synthetic_statements(Estate(spark, sf_dir))
    return control_flow.metrics(st)


@query
def writes_closure(spark, sf_dir):
    e = Estate(spark, sf_dir)
    performs = control_flow.synthetic(e)[1].where("type = 'PERFORM'")
    writes = e.items().select(F.col("l_orderkey").alias("program"), F.col("pos").alias("ord"), F.concat(F.lit("W"), F.col("l_partkey") % 10).alias("name"))
    return control_flow.writes_closure(control_flow.range_members(performs), writes)


@query
def loop_termination(spark, sf_dir):
    e = Estate(spark, sf_dir)
    performs = control_flow.synthetic(e)[1].where("type = 'PERFORM'")
    li = e.items()
    writes = li.select(F.col("l_orderkey").alias("program"), F.col("pos").alias("ord"), F.concat(F.lit("W"), F.col("l_partkey") % 10).alias("name"))
    loops = li.select(
        F.col("l_orderkey").alias("program"), F.col("pos").alias("ord"), F.concat(F.lit("W"), F.col("l_suppkey") % 10).alias("field"),
        F.when(F.col("pos") % 4 == 0, "times").otherwise("until").alias("type"), (F.col("pos") % 5 == 0).alias("no_condition"),
    )
    return control_flow.loop_termination(loops, control_flow.range_members(performs), writes)


# datasets and flows


@query
def dd_carry_forward(spark, sf_dir):
    dds = lineage.synthetic_dds(Estate(spark, sf_dir))
    return numbering.carry_forward(dds, ["job"], ["ord"], "ddname", "dd").select("job", "ord", "dd")


@query
def dataset_lineage(spark, sf_dir):
    e = Estate(spark, sf_dir)
    return lineage.link_datasets(lineage.synthetic_steps(e), lineage.synthetic_dds(e), lineage.synthetic_selects(e)).select("job", "step", "program", "select", "ddname", "dsn")


@query
def missing_dds(spark, sf_dir):
    e = Estate(spark, sf_dir)
    return lineage.missing_dds(lineage.synthetic_steps(e), lineage.synthetic_dds(e), lineage.synthetic_selects(e)).select("job", "step", "program", "select", "ddname")


@query
def dataset_rollup(spark, sf_dir):
    e = Estate(spark, sf_dir)
    links = lineage.link_datasets(lineage.synthetic_steps(e), lineage.synthetic_dds(e), lineage.synthetic_selects(e))
    return lineage.rollup(links).select("dsn", "programs", "links", F.array_join("ddnames", ",").alias("ddnames"))


@query
def dsn_parts(spark, sf_dir):
    p = Estate(spark, sf_dir).table("part")
    k = F.col("p_partkey")
    dsn = F.concat(F.when(k % 5 == 0, "&&").otherwise(""), F.lit("PROD.D"), k, F.when(k % 3 == 0, "(+1)").when(k % 3 == 1, "(MEM1)").otherwise(""), F.when(k % 7 == 0, ".&HLQ").otherwise(""))
    return p.select("p_partkey", dsn.alias("dsn")).withColumn("d", lineage.dsn_parts(F.col("dsn"))).select("p_partkey", "dsn", "d.*")


@query
def store_access_matrix(spark, sf_dir):
    return lineage.access_matrix(lineage.synthetic_flows(Estate(spark, sf_dir))).select("entity", "direction", F.array_join("programs", ",").alias("programs"))


@query
def producer_consumer(spark, sf_dir):
    return lineage.producer_consumer(lineage.synthetic_flows(Estate(spark, sf_dir)))


@query
def open_modes(spark, sf_dir):
    e = Estate(spark, sf_dir).table("events")
    modes = F.array(*map(F.lit, ("INPUT", "OUTPUT", "EXTEND", "I-O", "WHAT")))
    text = F.concat(F.lit("OPEN "), F.element_at(modes, (F.col("event_id") % 5 + 1).cast("int")), F.lit(" FILE-A FILE-B "), F.element_at(modes, (F.col("event_id") % 3 + 1).cast("int")), F.lit(" FILE-C"))
    return lineage.open_modes(e.select("event_id", text.alias("text")), "event_id")


# data checks


@query
def type_compat(spark, sf_dir):
    return layout_checks.synthetic_pairs(Estate(spark, sf_dir)).select("p_partkey", "type", layout_checks.incompatibility().alias("reason"))


@query
def column_types(spark, sf_dir):
    p = Estate(spark, sf_dir).table("part")
    shapes = ["CHARACTER(%d)", "DEC(%d, 2)", "NUMERIC", "INT", "VARCHAR(%d)", "TIMESTAMP", "BLOB(%d)"]
    text = F.element_at(F.array(*[F.replace(F.lit(s), F.lit("%d"), F.col("p_size").cast("string")) for s in shapes]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select("p_partkey", layout_checks.column_type(text).alias("t")).select("p_partkey", "t.*")


@query
def lrecl_check(spark, sf_dir):
    p = Estate(spark, sf_dir).table("part")
    k = F.col("p_partkey")
    return p.select("p_partkey", F.col("p_size").alias("size"), (k % 50 + 1).cast("int").alias("lrecl"), F.when(k % 2 == 0, "VB").otherwise("FB").alias("recfm")).where(layout_checks.lrecl_mismatch(F.col("size"), F.col("lrecl"), F.col("recfm")))


@query
def cluster_size_check(spark, sf_dir):
    p = Estate(spark, sf_dir).table("part")
    k = F.col("p_partkey")
    shaped = p.select("p_partkey", F.col("p_size").alias("size"), (k % 30).cast("int").alias("avg"), (k % 30 + (k % 3)).cast("int").alias("max"))
    return shaped.where(layout_checks.cluster_size_mismatch(F.col("size"), F.col("avg"), F.col("max")))


@query
def vsam_key_match(spark, sf_dir):
    e = Estate(spark, sf_dir)
    clusters = e.table("supplier").select(F.concat(F.lit("CL"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 5).alias("key_offset"), (F.col("s_suppkey") % 4 + 1).alias("key_length"))
    fields = e.table("lineitem").select(F.concat(F.lit("CL"), "l_suppkey").alias("name"), F.concat(F.lit("F"), "l_partkey").alias("field"), (F.col("l_partkey") % 5).alias("offset"), (F.col("l_linenumber") % 4 + 1).cast("bigint").alias("size"))
    return layout_checks.key_mismatches(clusters, fields)


@query
def undefined_names(spark, sf_dir):
    e = Estate(spark, sf_dir)
    li = e.table("lineitem")
    uses = li.select(F.col("l_orderkey").alias("program"), F.concat(F.element_at(F.array(F.lit("N"), F.lit("EIB"), F.lit("SQL")), (F.col("l_linenumber") % 3 + 1).cast("int")), F.col("l_partkey") % 50).alias("name"), F.col("l_linenumber").alias("line"))
    defined = li.select(F.col("l_orderkey").alias("program"), F.concat(F.lit("N"), F.col("l_suppkey") % 50).alias("name"))
    return checks.undefined_names(uses, defined)


# rules and gaps


@query
def repeated_rule_groups(spark, sf_dir):
    return rules.repeated_groups(rules.synthetic(Estate(spark, sf_dir))).select("id", "category", "condition", "members", "programs")


@query
def rule_ids(spark, sf_dir):
    r = rules.synthetic(Estate(spark, sf_dir))
    return numbering.occurrence_suffix(r, ["program", "line"], ["ord"], F.concat_ws(":", F.lit("rule"), "program", "line"), "rule_id").select("rule_id", "ord")


@query
def rule_classification(spark, sf_dir):
    return rules.classify(rules.synthetic_branches(Estate(spark, sf_dir))).select("branch", "category", "significance", "business")


@query
def gap_register(spark, sf_dir):
    _, refs = _resolved(spark, sf_dir)
    issues = refs.where("issue is not null").select(F.col("issue.severity").alias("severity"), F.col("issue.code").alias("code"), F.concat_ws(" ", "type", "target").alias("message"), F.col("from_id").alias("subject"), "path", "line", "ord")
    told = lambda c, f: F.array_join(F.transform(c, f), "; ")
    return gaps.register(issues).select(
        "gap_id", "severity", "category", "code", "subject", "title", "count", "n_locations", told("details", lambda x: x).alias("details"), told("locations", lambda x: F.concat_ws(":", x["path"], x["line"])).alias("locations"), "action"
    )


@query
def gap_ranking(spark, sf_dir):
    """The first twenty gaps of the register: a report."""
    _, refs = _resolved(spark, sf_dir)
    issues = refs.where("issue is not null").select(F.col("issue.severity").alias("severity"), F.col("issue.code").alias("code"), F.concat_ws(" ", "type", "target").alias("message"), F.col("from_id").alias("subject"), "path", "line", "ord")
    return gaps.ranked(gaps.register(issues), 20).select("rank", "gap_id", "severity")


@query
def note_to_issue(spark, sf_dir):
    li = Estate(spark, sf_dir).table("lineitem")
    codes = F.array(*map(F.lit, ("nonstandard_comment", "unterminated_literal", "literal_truncated_at_column_72", "copy_without_period")))
    notes = li.select(F.concat(F.lit("cbl/"), F.col("l_orderkey")).alias("path"), F.element_at(codes, (F.col("l_partkey") % 4 + 1).cast("int")).alias("code"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("line"))
    return gaps.notes_to_issues(notes).select("path", "severity", "code", "line", "count", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


# checks and statistics


@query
def annotation_gate(spark, sf_dir):
    e = Estate(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    files = docs.select(F.col("doc_id").cast("string").alias("path"), members.line_count(F.col("text")).alias("lines"))
    labels = e.table("labels")
    items = labels.select(
        F.col("doc_id").alias("item"), F.concat(F.lit("d"), F.col("doc_id") % 97).alias("target"), F.when(F.col("doc_id") % 11 == 0, "guess").otherwise("note").alias("kind"),
        F.when(F.col("doc_id") % 13 == 0, " ").otherwise("text").alias("text"), F.when(F.col("doc_id") % 17 == 0, "sure").otherwise("high").alias("confidence"),
        F.when(F.col("doc_id") % 19 == 0, F.array().cast("array<struct<id:string,path:string,line:int>>")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("id"), (F.col("doc_id") + F.col("quality")).cast("string").alias("path"), (F.col("toxic") * 40 + 1).cast("int").alias("line")))).alias("evidence"),
    )
    ids = spark.range(90).select(F.concat(F.lit("d"), "id").alias("id"))
    return checks.annotation_problems(items, ids, files)


@query
def inventory_stats(spark, sf_dir):
    e, refs = _resolved(spark, sf_dir)
    return checks.count_by(refs, ["type", "resolution"])


@query
def validate_stats(spark, sf_dir):
    """Stored statistics of which some are wrong, against those that the rows give."""
    _, refs = _resolved(spark, sf_dir)
    fresh = checks.count_by(refs, ["type"])
    stored = fresh.withColumn("value", F.when(F.col("metric").contains("COPY"), F.col("value") + 1).otherwise(F.col("value"))).where(~F.col("metric").contains("JCL"))
    return checks.stat_mismatches(stored, fresh)


@query
def referential_checks(spark, sf_dir):
    e, refs = _numbered(spark, sf_dir)
    there = e.programs().select("id").union(e.copybooks().select("id"))
    return checks.dangling_edges(edges.aggregate_edges(refs), there).groupBy("type", "side").agg(F.count("*").alias("n"))


@query
def top_k_complex(spark, sf_dir):
    """The ten most complex programs: a report."""
    st = control_flow.synthetic_statements(Estate(spark, sf_dir))
    return control_flow.complexity(st).groupBy("program").agg((F.sum(F.col("complexity") - 1) + 1).alias("complexity")).orderBy(F.desc("complexity"), "program").limit(10)


# property graph and its queries


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, refs = _numbered(spark, sf_dir)
    defined = e.programs().select("id", F.lit("Program").alias("label"), "name").union(e.copybooks().select("id", F.lit("Copybook"), "member")).union(
        e.csd().where("type = 'TRANSACTION'").select(F.concat(F.lit("transaction:"), "name"), F.lit("Transaction"), "name")
    ).union(e.table("orders").select(F.concat(F.lit("job:JOB"), "o_orderkey"), F.lit("Job"), F.concat(F.lit("JOB"), "o_orderkey"))).union(e.tables().select("id", F.lit("DataStore"), "name"))
    return graph.build(defined, edges.aggregate_edges(refs))


@query
def graph_counts(spark, sf_dir):
    nodes, rels = _graph(spark, sf_dir)
    return nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"), F.count_if("missing").alias("missing")).union(rels.groupBy("type").agg(F.count("*"), F.lit(0).cast("bigint")))


@query
def entry_points(spark, sf_dir):
    return graph.entry_points(*_graph(spark, sf_dir))


@query
def missing_callees(spark, sf_dir):
    return graph.missing_callees(*_graph(spark, sf_dir))


@query
def copybook_impact(spark, sf_dir):
    return graph.copybook_impact(*_graph(spark, sf_dir), "CPY10")


@query
def graph_csv_rows(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return graph.csv_rows(nodes.where("label = 'Program'"), ["name", "missing"]).select("header", "line")


@query
def cypher_batches(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return graph.batches(nodes, ["label"], ["id"]).groupBy("label", "batch").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def foreign_keys(spark, sf_dir):
    """Nations refer to regions; graph query over REFERENCES."""
    e = Estate(spark, sf_dir)
    nodes = e.table("nation").select(F.concat(F.lit("table:"), "n_name").alias("id"), F.lit("DataStore").alias("label"), F.col("n_name").alias("name"), F.lit(False).alias("missing")).union(
        e.table("region").select(F.concat(F.lit("table:"), "r_name"), F.lit("DataStore"), "r_name", F.lit(False)))
    rels = e.table("nation").join(F.broadcast(e.table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("table:"), "n_name").alias("from_id"), F.lit("REFERENCES").alias("type"), F.concat(F.lit("table:"), "r_name").alias("to_id"))
    return graph.foreign_keys(nodes, rels)


@query
def paragraph_chains(spark, sf_dir):
    """Call chains of one to four hops from paragraphs that nobody performs."""
    paragraphs, transfers = control_flow.synthetic(Estate(spark, sf_dir))
    performs = control_flow.range_members(transfers.where("type = 'PERFORM'")).select("program", F.col("ord").alias("src"), F.col("member").alias("dst"))
    return graph.chains(performs, 4)


# the golden estate, read from its members


def _golden(spark) -> Inventory:
    return Inventory(golden.content(spark))


@query
def golden_files(spark, sf_dir):
    return _golden(spark).files.select("path", "kind", "line_ending", "lines")


@query
def golden_references(spark, sf_dir):
    return _golden(spark).references.select("ref_id", "type", "from_id", "to_id", "resolution", "path", "line")


@query
def golden_programs(spark, sf_dir):
    return _golden(spark).classified.select("id", "kind", F.array_join("called_by", ",").alias("called_by"), F.array_join("executed_by", ",").alias("executed_by"))


@query
def golden_issues(spark, sf_dir):
    return _golden(spark).issues


@query
def reserved_words(spark, sf_dir):
    """The vocabulary as rows."""
    kinds = (("verb", vocabulary.STARTING), ("scope end", vocabulary.ENDING), ("figurative", vocabulary.FIGURATIVE), ("usage", vocabulary.USAGES))
    rows = [(w, next((k for k, words in kinds if w in words), "clause"), vocabulary.is_name(w)) for w in vocabulary.RESERVED]
    return spark.createDataFrame(rows, "word string, kind string, name boolean")


@query
def golden_scope(spark, sf_dir):
    return _golden(spark).scope(["PAY1"])


@query
def golden_links(spark, sf_dir):
    return _golden(spark).links.select("ddname", "dsn", "select")


def _structure(spark) -> Logic:
    return Logic(Programs(Inventory(golden.content(spark, golden.STRUCTURE))))


@query
def golden_layout(spark, sf_dir):
    return _structure(spark).programs.fields.select("record", "qualified_name", "offset", "size", "category")


@query
def golden_paragraphs(spark, sf_dir):
    p = _structure(spark).programs
    told = p.paragraphs.select("program", "ord", "name").join(p.reachable, ["program", "ord"]).join(p.complexity.withColumnRenamed("paragraph", "ord"), ["program", "ord"])
    return told.select("name", "reachable", F.col("complexity").cast("int").alias("complexity"))


@query
def golden_parse_issues(spark, sf_dir):
    return _structure(spark).programs.issues.select("severity", "code", "line")


@query
def golden_branches(spark, sf_dir):
    return rules.classify(_structure(spark).branches).select("kind", "condition", "paragraph", "category", "significance")


@query
def golden_rules(spark, sf_dir):
    return _structure(spark).rules.select("rule_id", "category", "business")


@query
def golden_loops(spark, sf_dir):
    return _structure(spark).loops.select("line", "type", "condition", "termination")


@query
def golden_flows(spark, sf_dir):
    return _structure(spark).flows.select("program", "entity", "direction")


@query
def golden_record_lengths(spark, sf_dir):
    return _structure(spark).length_mismatches.select("program", "ddname", "size", "lrecl")


def queries() -> dict[str, Query]:
    return dict(QUERIES)
