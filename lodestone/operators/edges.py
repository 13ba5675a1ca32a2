"""What follows from resolved references: edges, nodes, callers, copybook users, program kinds, anti-join checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.closure import closure

# fixed values: edge types that scope follows, calls that attach a batch program to the database
FOLLOWED = (
    "JCL_EXEC JCL_RUN JCL_PROC JCL_DD IDCAMS_DEFINE CSD_TRANSACTION CSD_FILE COPY SQL_INCLUDE STATIC_CALL DYNAMIC_CALL "
    "CICS_LINK CICS_XCTL CICS_LOAD CICS_RETURN_TRANSID CICS_START_TRANSID CICS_MAP CICS_FILE CICS_QUEUE SQL_TABLE SQL_CALL "
    "PROGRAM_DATASET DB2_VIEW_BASE DB2_FOREIGN_KEY"
).split()
ATTACH_CALLS = ("DSNALI", "DSNRLI", "DSNHLI", "DSNHLI2", "DSNELI")
CALLING = ("STATIC_CALL", "CICS_LINK", "CICS_XCTL", "CICS_LOAD")
_FOUND = "resolution in ('resolved', 'ambiguous')"


def aggregate_edges(refs: DataFrame) -> DataFrame:
    """from_id, to_id, type, resolution (of the first reference), count, references (ids in order)."""
    return (
        refs.where("to_id is not null")
        .groupBy("from_id", "to_id", "type")
        .agg(F.min_by("resolution", "ref_id").alias("resolution"), F.count("*").alias("count"), F.sort_array(F.collect_list("ref_id")).alias("references"))
    )


def node_status(resolution: Column) -> Column:
    return F.when(resolution.isin("resolved", "ambiguous"), "defined").when(resolution == "unresolved", "missing").otherwise(resolution)


def nodes(defined: DataFrame, refs: DataFrame) -> DataFrame:
    """id, kind, name, status, path: what is defined (id, kind, name, path), and other ends of references by their first mention."""
    far = refs.where("to_id is not null").select(F.col("to_id").alias("id"), node_status(F.col("resolution")).alias("status"), F.col("ref_id").alias("o"), F.lit(0).alias("side"))
    near = refs.where("to_id is not null").select(F.col("from_id").alias("id"), F.lit("defined").alias("status"), F.col("ref_id").alias("o"), F.lit(1).alias("side"))
    ends = far.union(near).groupBy("id").agg(F.min_by("status", F.struct("o", "side")).alias("status"))
    own = defined.groupBy("id").agg(F.min_by(F.struct("kind", "name", "path"), F.coalesce("path", F.lit(""))).alias("d"))
    all_ = ends.join(own, "id", "full")
    return all_.select(
        "id",
        F.coalesce("d.kind", F.substring_index("id", ":", 1)).alias("kind"),
        F.coalesce("d.name", F.regexp_replace("id", "^[^:]*:", "")).alias("name"),
        F.when(F.col("d").isNotNull(), "defined").otherwise(F.col("status")).alias("status"),
        F.col("d.path").alias("path"),
    )


def members_behind(refs: DataFrame) -> DataFrame:
    """(copybook, program): programs that copy a copybook, directly or through other copybooks."""
    copies = refs.where(_FOUND).where("type = 'COPY'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), F.col("to_id").alias("node")).distinct()
    start = copies.select(F.col("src").alias("seed"), "node").where("seed like 'copybook:%'").distinct()
    by_seed = copies.select("src", "dst").distinct()
    # each copybook's own closure over "is copied by"; programs end it
    reach = _pairwise(start, by_seed)
    return reach.where("node like 'program:%'").select(F.col("seed").alias("copybook"), F.col("node").alias("program")).distinct()


def _pairwise(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node) pairs reached over edges from each seed."""
    from lodestone.sources.settled import settle

    seen = settle(start, "pairs")
    frontier = seen
    while not frontier.isEmpty():
        steps = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = settle(steps.join(seen, ["seed", "node"], "left_anti"), "pairs")
        seen = seen.union(frontier)
    return seen


def called_by(refs: DataFrame) -> DataFrame:
    """(id, called_by): callers of each program; a call within a copybook is also made by every program that copies it."""
    calls = refs.where(_FOUND).where(F.col("type").isin(*CALLING)).select(F.col("to_id").alias("id"), F.col("from_id").alias("caller")).distinct()
    through = calls.join(members_behind(refs), F.col("caller") == F.col("copybook")).select("id", F.col("program").alias("caller"))
    return calls.union(through).groupBy("id").agg(F.sort_array(F.collect_set("caller")).alias("called_by"))


def executed_by(refs: DataFrame) -> DataFrame:
    """(id, executed_by): jobs and transactions that start each program."""
    return refs.where(_FOUND).where(F.col("type").isin("JCL_EXEC", "JCL_RUN", "CSD_TRANSACTION")).groupBy(F.col("to_id").alias("id")).agg(F.sort_array(F.collect_set("from_id")).alias("executed_by"))


def used_by(refs: DataFrame) -> DataFrame:
    """(id, used_by): names of the members that copy each copybook."""
    used = refs.where(_FOUND).where(F.col("type").isin("COPY", "SQL_INCLUDE"))
    return used.groupBy(F.col("to_id").alias("id")).agg(F.sort_array(F.collect_set(F.regexp_replace("from_id", "^[^:]*:", ""))).alias("used_by"))


def classify_programs(programs: DataFrame, refs: DataFrame, csd_programs: DataFrame) -> DataFrame:
    """programs with called_by, executed_by, entry_point and kind: unknown, online, batch or subroutine."""
    jobs = refs.where(_FOUND).where(F.col("type").isin("JCL_EXEC", "JCL_RUN")).select(F.col("to_id").alias("id")).distinct().withColumn("_in_job", F.lit(True))
    listed = csd_programs.select("name").distinct().withColumn("_in_csd", F.lit(True))
    none = F.array().cast("array<string>")
    wide = programs.join(called_by(refs), "id", "left").join(executed_by(refs), "id", "left").join(jobs, "id", "left").join(listed, "name", "left")
    wide = wide.withColumn("called_by", F.coalesce("called_by", none)).withColumn("executed_by", F.coalesce("executed_by", none))
    kind = (
        F.when(~F.col("scanned"), "unknown")
        .when(F.col("has_cics") | F.col("_in_csd").isNotNull(), "online")
        .when(F.col("_in_job").isNotNull(), "batch")
        .when(F.col("has_using") | (F.size("called_by") > 0), "subroutine")
        .otherwise("batch")
    )
    return wide.withColumn("kind", kind).withColumn("entry_point", F.size("executed_by") > 0).drop("_in_job", "_in_csd")


def unreached_issues(programs: DataFrame, csd_programs: DataFrame, has_jobs: bool = True) -> DataFrame:
    """Issues for classified programs that nobody reaches: subroutines, batch programs, online programs that are not listed."""
    wide = programs.join(csd_programs.select("name").distinct().withColumn("_in_csd", F.lit(True)), "name", "left")
    alone = F.size("called_by") == 0
    code = (
        F.when((F.col("kind") == "subroutine") & alone, "subroutine_without_callers")
        .when((F.col("kind") == "batch") & alone & (F.size("executed_by") == 0) & F.lit(has_jobs), "program_not_executed")
        .when((F.col("kind") == "online") & F.col("_in_csd").isNull(), "online_program_not_in_csd")
    )
    out = wide.select(F.col("id").alias("subject"), "path", code.alias("code")).where("code is not null")
    return out.withColumn("severity", F.when(F.col("code") == "online_program_not_in_csd", "warning").otherwise("info"))


def unused_copybooks(copybooks: DataFrame, refs: DataFrame) -> DataFrame:
    return copybooks.join(used_by(refs).select("id"), "id", "left_anti")


def name_collisions(programs: DataFrame, copybooks: DataFrame) -> DataFrame:
    """Names that a program and a copybook share."""
    return programs.select("name").intersect(copybooks.select(F.col("member").alias("name")))


def duplicate_programs(programs: DataFrame) -> DataFrame:
    """(program_id, files, paths) of PROGRAM-IDs that several files declare."""
    return programs.where("program_id is not null").groupBy("program_id").agg(F.count("*").alias("files"), F.sort_array(F.collect_list("path")).alias("paths")).where("files > 1")


def without_attach(programs: DataFrame, refs: DataFrame) -> DataFrame:
    """(subject, from_id, path, line): batch runs of programs with SQL that neither run under the attach nor call it."""
    runs = refs.where("type = 'JCL_EXEC' and resolution = 'resolved'").select(F.col("to_id").alias("id"), "from_id", F.col("path").alias("run_path"), "line")
    attached = refs.where(F.col("type") == "STATIC_CALL").where(F.col("target").isin(*ATTACH_CALLS)).select(F.col("from_id").alias("id")).distinct()
    risky = programs.where("has_sql and not has_cics").select("id").distinct().join(attached, "id", "left_anti")
    return runs.join(risky, "id").select(F.col("id").alias("subject"), "from_id", F.col("run_path").alias("path"), "line")


def conflicting_clusters(definitions: DataFrame) -> DataFrame:
    """(name, definitions): clusters that are defined with different keys or record sizes."""
    shape = F.struct("organization", "key_length", "key_offset", "record_size_max")
    return definitions.where("kind = 'CLUSTER'").groupBy("name").agg(F.count("*").alias("definitions"), F.size(F.collect_set(shape)).alias("shapes")).where("shapes > 1").select("name", "definitions")


def scope(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth) reached from the starting nodes over followed edge types; a map brings its mapset along."""
    reach = closure(edges.where(F.col("type").isin(FOLLOWED)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), starts)
    sets = reach.where("node like 'map:%'").select(F.concat(F.lit("mapset:"), F.substring_index(F.regexp_replace("node", "^map:", ""), ".", 1)).alias("node"), "depth")
    return reach.union(sets).groupBy("node").agg(F.min("depth").alias("depth"))


def resolve_entries(nodes_: DataFrame, entries: list[str]) -> list[str]:
    """Node ids of entry points given as kind:NAME or as a bare name of a job, transaction, program or proc; ValueError if none or several fit."""
    wanted: dict[str, list[str]] = {}
    for e in entries:
        kind, colon, name = e.partition(":")
        wanted[e] = [f"{kind.lower()}:{name.upper()}"] if colon else [f"{k}:{e.upper()}" for k in ("job", "transaction", "program", "proc")]
    there = {r.id for r in nodes_.where(F.col("id").isin([n for ids in wanted.values() for n in ids])).select("id").distinct().collect()}
    out = []
    for e, ids in wanted.items():
        hits = [n for n in ids if n in there]
        if not hits:
            raise ValueError(f"entry point {e} is not in the inventory")
        if len(hits) > 1:
            raise ValueError(f"entry point {e} could be {' or '.join(hits)}; put the kind in front")
        out += hits
    return out
