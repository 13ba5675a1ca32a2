"""Datasets: DD statements, the files of programs, what reads and writes a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.numbering import carry_forward, first_wins


def dsn_parts(dsn: Column) -> Column:
    """STRUCT<base, generation, member, temporary, symbolic> of a dataset name."""
    generation = F.regexp_extract(dsn, r"^.*\(([+-]?[0-9]+)\)$", 1)
    member = F.regexp_extract(dsn, r"^.*\(([A-Z0-9#@$]{1,8})\)$", 1)
    base = F.when((generation != "") | (member != ""), F.regexp_extract(dsn, r"^(.*)\([^(]*\)$", 1)).otherwise(dsn)
    return F.struct(
        base.alias("base"),
        F.when(generation != "", generation).alias("generation"),
        F.when((generation == "") & (member != ""), member).alias("member"),
        dsn.startswith("&&").alias("temporary"),
        F.regexp_replace(dsn, "^&+", "").contains("&").alias("symbolic"),
    )


def ddname_of(assign: Column) -> Column:
    """The DD name of an ASSIGN operand, null for paths and dataset names: the part after device and organisation prefixes."""
    upper = F.upper(assign)
    stripped = F.when(upper.rlike(r"^((UT|UR|DA|S|AS|D|I|R|V)-)+[^-]*$"), F.substring_index(upper, "-", -1)).otherwise(upper)
    return F.when(~upper.rlike(r"[/\\.]"), stripped)


def step_dds(dds: DataFrame) -> DataFrame:
    """The DDs of each step by name: unnamed ones belong to the name above, of a name the first counts."""
    named = carry_forward(dds, ["job", "step"], ["ord"], "ddname", "_dd").where("_dd is not null").withColumn("ddname", F.col("_dd")).drop("_dd")
    return first_wins(named, ["job", "step", "ddname"], ["ord"])


def _needs(steps: DataFrame, selects: DataFrame) -> DataFrame:
    """(job, step, program, select, ddname): the DD that each file of a step's program needs."""
    return steps.where("program is not null").join(selects.where("ddname is not null"), "program").select("job", "step", "program", "select", "ddname")


def link_datasets(steps: DataFrame, dds: DataFrame, selects: DataFrame) -> DataFrame:
    """Program file, DD and dataset of every step: the DD rows joined to what the steps' programs need."""
    return _needs(steps, selects).join(step_dds(dds), ["job", "step", "ddname"])


def missing_dds(steps: DataFrame, dds: DataFrame, selects: DataFrame) -> DataFrame:
    return _needs(steps, selects).join(step_dds(dds).select("job", "step", "ddname"), ["job", "step", "ddname"], "left_anti")


def rollup(links: DataFrame) -> DataFrame:
    """(dsn, programs, links, ddnames) of each dataset."""
    return links.where("dsn is not null").groupBy("dsn").agg(F.count_distinct("program").alias("programs"), F.count("*").alias("links"), F.sort_array(F.collect_set("ddname")).alias("ddnames"))


def open_modes(statements: DataFrame, id_col: str) -> DataFrame:
    """(id_col, file, access) for the files of OPEN statements: each under the last mode before it; a first word that is no mode opens for nothing."""
    words = statements.select(id_col, F.posexplode(F.split(F.regexp_replace("text", r"^OPEN\s+", ""), r"\s+")).alias("pos", "word"))
    mode = F.when(F.col("word").isin("INPUT", "OUTPUT", "EXTEND", "I-O"), F.col("word"))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = words.withColumn("mode", F.last(mode, ignorenulls=True).over(w)).where(mode.isNull() & F.col("mode").isNotNull())
    access = F.when(F.col("mode") == "INPUT", "read").when(F.col("mode") == "I-O", "update").otherwise("write")
    return told.select(id_col, F.col("word").alias("file"), access.alias("access"))


def access_matrix(flows: DataFrame) -> DataFrame:
    """(entity, direction, programs) of each store."""
    return flows.groupBy("entity", "direction").agg(F.sort_array(F.collect_set("program")).alias("programs"))


def producer_consumer(flows: DataFrame) -> DataFrame:
    """(producer, entity, consumer): a store that one program writes or updates and another reads, each once."""
    made = flows.where("direction in ('write', 'update')").select(F.col("program").alias("producer"), "entity").distinct()
    used = flows.where("direction = 'read'").select(F.col("program").alias("consumer"), "entity").distinct()
    return made.join(used, "entity").where("producer <> consumer").select("producer", "entity", "consumer")


def synthetic_steps(estate) -> DataFrame:
    """Orders as jobs of one step, that runs a program by customer."""
    return estate.table("orders").select(F.col("o_orderkey").alias("job"), F.lit(1).alias("step"), F.concat(F.lit("PGM"), F.col("o_custkey") % 50).alias("program"))


def synthetic_dds(estate) -> DataFrame:
    """Line items as DDs: every third has no name of its own."""
    li = estate.items()
    name = F.when(F.col("pos") % 3 != 0, F.concat(F.lit("DD"), F.col("l_suppkey") % 4))
    return li.select(F.col("l_orderkey").alias("job"), F.lit(1).alias("step"), F.col("pos").alias("ord"), name.alias("ddname"), F.when(F.col("l_partkey") % 6 != 0, F.concat(F.lit("PROD.D"), F.col("l_partkey") % 200)).alias("dsn"))


def synthetic_selects(estate) -> DataFrame:
    """Two files for each of fifty programs."""
    ids = estate.spark.range(50)
    one = ids.select(F.concat(F.lit("PGM"), "id").alias("program"), F.lit("IN-FILE").alias("select"), ddname_of(F.concat(F.lit("UT-S-DD"), F.col("id") % 4)).alias("ddname"))
    return one.union(ids.select(F.concat(F.lit("PGM"), "id"), F.lit("OUT-FILE"), ddname_of(F.concat(F.lit("DD"), F.col("id") % 3, F.when(F.col("id") % 5 == 0, ".X").otherwise("")))))


def synthetic_flows(estate) -> DataFrame:
    """Line items as accesses of a supplier's program to the store of a part's brand and nation."""
    li = estate.table("lineitem").join(estate.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    direction = F.element_at(F.array(*map(F.lit, ("read", "write", "update", "delete"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return li.select(F.concat(F.lit("PGM"), F.col("l_suppkey") % 40).alias("program"), F.concat_ws(":", F.lit("dataset"), "p_brand", F.col("l_partkey") % 3).alias("entity"), direction.alias("direction"))
