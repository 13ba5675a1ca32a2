"""Resolution of references: every reference type at once, by two joins with one table of names.

Each reference asks for one name of one family (program, copybook, map, table ...), and
where that fails may ask for a second (a table by its short name, a program in place of a
copybook). So all dimensions are one table (family, name) and the references are joined
with it twice, whatever the number of types.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: routines that the system supplies, by prefix and by name; utilities; system includes and schemas
SYSTEM_PREFIXES = "CEE IGZ ILBO DSN DFH CSQ EZA BPX IRX IKJ".split()
SYSTEM_PROGRAMS = "CBLTDLI AIBTDLI AERTDLI PLITDLI MQCONN MQCONNX MQOPEN MQPUT MQPUT1 MQGET MQCLOSE MQDISC MQINQ MQSET MQCMIT MQBACK".split()
UTILITIES = (
    "IDCAMS IEFBR14 IEBGENER IEBCOPY IEBUPDTE IEBPTPCH IEHLIST IEHPROGM SORT ICEMAN DFSORT SYNCSORT ICETOOL ADRDSSU "
    "IKJEFT01 IKJEFT1A IKJEFT1B DFSRRC00 DSNUTILB DSNTIAUL DSNTEP2 DSNTEP4 IRXJCL BPXBATCH FTP IEBDG IGYCRCTL "
    "IEWL HEWL IEWBLINK DSNHPC DFHECP1$ AMASPZAP"
).split()
SYSTEM_INCLUDES = ("SQLCA", "SQLDA")
SYSTEM_SCHEMAS = ("SYSIBM.", "SYSCAT.", "SYSSTAT.", "SYSIBMADM.")
PROGRAM_TYPES = ("STATIC_CALL", "DYNAMIC_CALL", "CICS_LINK", "CICS_XCTL", "CICS_LOAD", "CSD_TRANSACTION", "JCL_RUN", "JCL_EXEC")
TRANSACTION_TYPES = ("CICS_RETURN_TRANSID", "CICS_START_TRANSID")
TABLE_TYPES = ("SQL_TABLE", "DB2_FOREIGN_KEY", "DB2_VIEW_BASE")
DATASET_TYPES = ("JCL_DD", "CSD_FILE", "IDCAMS_DEFINE", "PROGRAM_DATASET")

_NAMES = "family string, name string, id string, n bigint, paths array<string>"


def is_system_program(name: Column) -> Column:
    return reduce(lambda a, p: a | name.startswith(p), SYSTEM_PREFIXES, name.isin(SYSTEM_PROGRAMS))


def program_names(programs: DataFrame) -> DataFrame:
    """name, id, n, paths: PROGRAM-IDs, and members where no program has that id; the first in path order stands for them."""
    by_id = programs.where("program_id is not null").select(F.col("program_id").alias("name"), "id", "path", F.lit(0).alias("rank"))
    by_member = programs.select(F.col("member").alias("name"), "id", "path", F.lit(1).alias("rank"))
    each = by_id.union(by_member).groupBy("name", "rank").agg(F.min_by("id", "path").alias("id"), F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    best = each.groupBy("name").agg(F.min_by(F.struct("id", "n", "paths"), "rank").alias("b"))
    return best.select("name", "b.id", "b.n", "b.paths")


def names(programs=None, copybooks=None, procs=None, csd=None, maps=None, tables=None, procedures=None) -> DataFrame:
    """The table (family, name, id, n, paths) of all that a reference can name. Any dimension may be missing."""
    parts: list[DataFrame] = []

    def add(family: str, df: DataFrame | None) -> None:
        if df is not None:
            parts.append(df.select(F.lit(family).alias("family"), "name", "id", F.col("n").cast("bigint").alias("n"), "paths"))

    def counted(df: DataFrame, name: str, id_: Column, path: str = "path") -> DataFrame:
        return df.groupBy(F.col(name).alias("name")).agg(F.min_by(id_, path).alias("id"), F.count("*").alias("n"), F.sort_array(F.collect_list(path)).alias("paths"))

    if programs is not None:
        add("program", program_names(programs))
    if copybooks is not None:
        add("copybook", counted(copybooks, "member", F.col("id")))
    if procs is not None:
        add("proc", counted(procs, "name", F.col("id")))
    if csd is not None:
        add("transaction", counted(csd.where("type = 'TRANSACTION'"), "name", F.concat(F.lit("transaction:"), "name")))
        add("cics_file", counted(csd.where("type = 'FILE'"), "name", F.concat(F.lit("cics_file:"), "name")))
    if maps is not None:  # mapset, name, path
        add("map", counted(maps.withColumn("_key", F.concat_ws(".", "mapset", "name")), "_key", F.concat(F.lit("map:"), "_key")))
        add("map_name", counted(maps, "name", F.concat_ws("", F.lit("map:"), "mapset", F.lit("."), "name")))
        add("mapset", counted(maps, "mapset", F.concat(F.lit("mapset:"), "mapset")))
    if tables is not None:  # tables and views: name, id, path
        add("table", counted(tables, "name", F.col("id")))
        add("table_short", counted(tables.withColumn("_short", F.substring_index("name", ".", -1)), "_short", F.col("id")))
    if procedures is not None:
        add("procedure", counted(procedures, "name", F.concat(F.lit("procedure:"), "name")))
    return reduce(DataFrame.unionByName, parts)


def resolve(refs: DataFrame, known: DataFrame, has_csd: bool = True, has_tables: bool = True) -> DataFrame:
    """refs with to_id, resolution, issue (severity and code, or null) and candidates.

    refs: type, target, and where they apply mapset, operation and temporary. A type
    without rules of its own is resolved. Missing transactions, files and tables are
    issues only where the estate defines any.
    """
    kind, target = F.col("type"), F.col("target")
    optional = {"mapset": "string", "operation": "string", "temporary": "boolean"}
    for name, sql_type in optional.items():
        if name not in refs.columns:
            refs = refs.withColumn(name, F.lit(None).cast(sql_type))
    short = F.substring_index(target, ".", -1)
    mapped = F.col("mapset").isNotNull()
    family = (
        F.when(kind.isin(*PROGRAM_TYPES), "program")
        .when(kind.isin("COPY", "SQL_INCLUDE"), "copybook")
        .when(kind == "JCL_PROC", "proc")
        .when(kind.isin(*TRANSACTION_TYPES), "transaction")
        .when(kind == "CICS_FILE", "cics_file")
        .when((kind == "CICS_MAP") & mapped, "map")
        .when(kind == "CICS_MAP", "map_name")
        .when(kind.isin(*TABLE_TYPES), "table")
        .when(kind == "SQL_CALL", "procedure")
    )
    asked = F.when((kind == "CICS_MAP") & mapped, F.concat_ws(".", "mapset", "target")).otherwise(target)
    second = F.when(kind == "COPY", "program").when(kind.isin(*TABLE_TYPES), "table_short").when((kind == "CICS_MAP") & mapped, "mapset")
    asked_second = F.when(kind == "COPY", target).when(kind.isin(*TABLE_TYPES), short).when(kind == "CICS_MAP", F.col("mapset"))

    def side(prefix: str) -> DataFrame:
        return known.select(F.col("family").alias(f"{prefix}family"), F.col("name").alias(f"{prefix}asked"), *[F.col(c).alias(f"{prefix}{c}") for c in ("id", "n", "paths")])

    wide = refs.withColumns({"_1family": family, "_1asked": asked, "_2family": second, "_2asked": asked_second})
    wide = wide.join(side("_1"), ["_1family", "_1asked"], "left").join(side("_2"), ["_2family", "_2asked"], "left")
    found, n, other, n_other = F.col("_1id"), F.col("_1n"), F.col("_2id"), F.col("_2n")

    is_program, is_table, is_map = kind.isin(*PROGRAM_TYPES), kind.isin(*TABLE_TYPES), kind == "CICS_MAP"
    utility = (kind == "JCL_EXEC") & target.isin(UTILITIES)
    temporary = is_table & ((F.col("operation") == "DECLARE_TEMPORARY") | target.startswith("SESSION."))
    system_table = is_table & reduce(lambda a, s: a | target.startswith(s), SYSTEM_SCHEMAS, F.lit(False))
    short_id = F.when(n_other == 1, other)
    include = (kind == "SQL_INCLUDE") & target.isin(*SYSTEM_INCLUDES)
    map_found = F.when(mapped | (n == 1), found)
    dynamic_types = is_program | kind.isin(*TRANSACTION_TYPES, "CICS_FILE", "CICS_QUEUE", "CICS_MAP", "SQL_CALL")

    resolution = (
        F.when(target.isNull() & dynamic_types, "dynamic")
        .when(utility | include, "system")
        .when(is_program, F.when(found.isNotNull(), "resolved").when(is_system_program(target), "system").otherwise("unresolved"))
        .when(kind == "COPY", F.when(found.isNull(), "unresolved").when(n > 1, "ambiguous").otherwise("resolved"))
        .when(kind.isin("SQL_INCLUDE", "CICS_FILE", *TRANSACTION_TYPES), F.when(found.isNull(), "unresolved").otherwise("resolved"))
        .when(is_map, F.when(map_found.isNull(), "unresolved").otherwise("resolved"))
        .when(kind == "JCL_PROC", F.when(found.isNull(), "external").otherwise("resolved"))
        .when(kind == "JCL_INCLUDE", "external")
        .when(temporary, "temporary")
        .when(system_table, "system")
        .when(is_table, F.when(F.coalesce(found, short_id).isNull(), "undefined").otherwise("resolved"))
        .when(kind == "SQL_CALL", F.when(found.isNull(), "undefined").otherwise("resolved"))
        .when((kind == "JCL_DD") & F.coalesce("temporary", F.lit(False)), "temporary")
        .otherwise("resolved")
    )

    def node(prefix: str) -> Column:
        return F.concat(F.lit(f"{prefix}:"), target)

    to_id = (
        F.when(target.isNull() & dynamic_types, None)
        .when(utility, node("utility"))
        .when(include, node("system_include"))
        .when(is_program, F.coalesce(found, node("program")))
        .when(kind.isin("COPY", "SQL_INCLUDE"), node("copybook"))
        .when(kind == "JCL_PROC", node("proc"))
        .when(kind == "JCL_INCLUDE", node("jcl_include"))
        .when(kind.isin(*TRANSACTION_TYPES), node("transaction"))
        .when(kind == "CICS_FILE", node("cics_file"))
        .when(kind == "CICS_QUEUE", node("queue"))
        .when(is_map, F.coalesce(map_found, F.concat(F.lit("map:"), F.coalesce("mapset", F.lit("?")), F.lit("."), target)))
        .when(temporary | system_table, node("table"))
        .when(is_table, F.coalesce(found, short_id, node("table")))
        .when(kind == "SQL_CALL", node("procedure"))
        .when(kind.isin(*DATASET_TYPES), node("dataset"))
        .otherwise(node("unknown"))
    )

    wide = wide.withColumn("to_id", to_id).withColumn("resolution", resolution)
    r = F.col("resolution")
    missing_program = F.when(kind == "CSD_TRANSACTION", "csd_program_missing").when(kind == "JCL_EXEC", "missing_jcl_program").otherwise("missing_program")
    issue = (
        F.when(is_program, F.when(r == "dynamic", _issue("info", "dynamic_call")).when((r == "system") & ~utility, _issue("info", "system_program")).when(r == "unresolved", _issue("warning", missing_program)))
        .when(kind == "COPY", F.when(r == "ambiguous", _issue("warning", "ambiguous_member")).when(r == "unresolved", _issue("warning", F.when(other.isNotNull(), "copy_target_is_program").otherwise("missing_copybook"))))
        .when((kind == "SQL_INCLUDE") & (r == "unresolved"), _issue("warning", "missing_include"))
        .when((kind == "JCL_PROC") & (r == "external"), _issue("info", "external_proc"))
        .when(is_map & (r == "unresolved"), _issue("warning", F.when(mapped & other.isNull(), "missing_mapset").otherwise("missing_map")))
        .when((kind == "CICS_FILE") & (r == "unresolved") & F.lit(has_csd), _issue("warning", "missing_cics_file"))
        .when(kind.isin(*TRANSACTION_TYPES) & (r == "unresolved") & F.lit(has_csd), _issue("warning", "missing_transaction"))
        .when(is_table & (r == "undefined") & F.lit(has_tables), _issue("info", "undefined_table"))
    )
    candidates = F.when((is_program | (kind == "COPY")) & (n > 1), F.col("_1paths"))
    return wide.withColumn("issue", issue).withColumn("candidates", candidates).select(*refs.columns, "to_id", "resolution", "issue", "candidates")


def _issue(severity: str, code) -> Column:
    return F.struct(F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"))
