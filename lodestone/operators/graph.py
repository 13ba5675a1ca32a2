"""The property graph: nodes and relationships, its query library, and rows for its exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.numbering import number_rows
from lodestone.sources.settled import settle

# fixed values: relationship of each edge type, label of nodes that edges may add, rows of a batch
RELATIONSHIPS = {
    "JCL_EXEC": "RUNS", "JCL_RUN": "RUNS", "CSD_TRANSACTION": "STARTS", "STATIC_CALL": "CALLS", "DYNAMIC_CALL": "CALLS", "CICS_LINK": "LINKS", "CICS_XCTL": "XCTL",
    "COPY": "COPIES", "SQL_INCLUDE": "INCLUDES", "CICS_MAP": "USES_MAP", "DB2_FOREIGN_KEY": "REFERENCES",
}
ADDED_LABELS = {"program": "Program", "copybook": "Copybook", "map": "Map", "table": "DataStore"}
BATCH = 200


def _chosen(mapping: dict[str, str], of: Column) -> Column:
    return F.coalesce(*[F.when(of == k, v) for k, v in mapping.items()])


def build(defined: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, relationships) from defined (id, label, name) and aggregated edges.

    An end that is not defined is added as missing where its kind has a label; other
    edges are left out, as are edges from nodes that are not there.
    """
    known = defined.groupBy("id").agg(F.first("label").alias("label"), F.min("name").alias("name")).withColumn("missing", F.lit(False))
    mapped = edges.withColumn("rel", _chosen(RELATIONSHIPS, F.col("type"))).where("rel is not null")
    label = _chosen(ADDED_LABELS, F.substring_index("id", ":", 1))
    added = mapped.select(F.col("to_id").alias("id")).distinct().join(known.select("id"), "id", "left_anti").select("id", label.alias("label"), F.regexp_replace("id", "^[^:]*:", "").alias("name"), F.lit(True).alias("missing"))
    nodes = settle(known.union(added.where("label is not null")), "nodes")
    there = nodes.select("id")
    rels = mapped.select("from_id", F.col("rel").alias("type"), "to_id", "count").join(there, F.col("from_id") == F.col("id"), "left_semi").join(there, F.col("to_id") == F.col("id"), "left_semi")
    rels = rels.groupBy("from_id", "type", "to_id").agg(F.sum("count").alias("count"))
    return nodes, settle(rels, "rels")


def _end(nodes: DataFrame, side: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def entry_points(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(kind, entry, program): jobs and transactions with the programs that they start."""
    out = rels.where("type in ('RUNS', 'STARTS')").join(_end(nodes, "from", "label", "name"), "from_id").join(_end(nodes, "to", "name", "label"), "to_id")
    return out.where("to_label = 'Program'").select(F.col("from_label").alias("kind"), F.col("from_name").alias("entry"), F.col("to_name").alias("program"))


def missing_callees(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(caller, missing): programs that call one that is not there."""
    gone = _end(nodes.where("label = 'Program' and missing"), "to", "name")
    own = _end(nodes.where("label = 'Program'"), "from", "name")
    return rels.where("type in ('CALLS', 'LINKS', 'XCTL')").join(gone, "to_id").join(own, "from_id").select(F.col("from_name").alias("caller"), F.col("to_name").alias("missing")).distinct()


def copybook_impact(nodes: DataFrame, rels: DataFrame, copybook: str) -> DataFrame:
    """(program, entry_points): programs that copy a copybook, with what starts them."""
    target = nodes.where((F.col("label") == "Copybook") & (F.col("name") == copybook)).select(F.col("id").alias("to_id"))
    users = rels.where("type = 'COPIES'").join(F.broadcast(target), "to_id").join(_end(nodes.where("label = 'Program'"), "from", "name"), "from_id").select(F.col("from_id").alias("user"), F.col("from_name").alias("program")).distinct()
    starts = rels.where("type in ('RUNS', 'STARTS')").join(_end(nodes, "from", "name"), "from_id").select(F.col("to_id").alias("user"), F.col("from_name").alias("entry"))
    return users.join(starts, "user", "left").groupBy("program").agg(F.array_join(F.sort_array(F.collect_set("entry")), ",").alias("entry_points"))


def foreign_keys(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    stores = nodes.where("label = 'DataStore'")
    return rels.where("type = 'REFERENCES'").join(_end(stores, "from", "name"), "from_id").join(_end(stores, "to", "name"), "to_id").select(F.col("from_name").alias("table"), F.col("to_name").alias("refers_to"))


def reached_programs(nodes: DataFrame, rels: DataFrame, transaction: str, most: int = 5) -> DataFrame:
    """(program, length): programs that a transaction reaches, with every length of up to so many hops."""
    from lodestone.operators.closure import hops

    steps = rels.where("type in ('STARTS', 'LINKS', 'CALLS', 'XCTL')").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    start = nodes.where((F.col("label") == "Transaction") & (F.col("name") == transaction)).select(F.col("id").alias("node"))
    return hops(steps, start, most).join(_end(nodes.where("label = 'Program'"), "to", "name"), F.col("node") == F.col("to_id")).select(F.col("to_name").alias("program"), F.col("depth").alias("length"))


def chains(performs: DataFrame, most: int) -> DataFrame:
    """(program, chain) of paths of 1 to most steps from nodes that no step leads to, as in a graph query: no step twice on a path.

    performs: program, src, dst. One program's paths at a time are what this is for; it
    joins by program, so programs with very many paths stay apart.
    """
    steps = settle(performs.select("program", "src", "dst").distinct(), "steps")
    roots = steps.select("program", F.col("src").alias("node")).distinct().join(steps.select("program", F.col("dst").alias("node")).distinct(), ["program", "node"], "left_anti")
    level = roots.select("program", "node", F.array("node").alias("path"))
    out = None
    for _ in range(most):
        level = level.join(steps, ["program"]).where("node = src")
        again = F.exists(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b")), lambda s: (s["a"] == F.col("src")) & (s["b"] == F.col("dst")))
        level = settle(level.where(~F.coalesce(again, F.lit(False))).select("program", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "paths")
        out = level if out is None else out.union(level)
    return out.select("program", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("chain"))


def csv_value(value: Column, kind: str) -> Column:
    """A value in the bulk import format: booleans as words, null as nothing, quoted where need be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return text if kind in ("boolean", "int", "bigint") else F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(nodes: DataFrame, properties: Sequence[str]) -> DataFrame:
    """(id, header, line) of the import file of one label."""
    kinds = dict(nodes.dtypes)
    suffix = {"boolean": ":boolean", "int": ":int", "bigint": ":int"}
    header = ",".join(["id:ID", *[p + suffix.get(kinds[p], "") for p in properties], ":LABEL"])
    line = F.concat_ws(",", csv_value(F.col("id"), "string"), *[csv_value(F.col(p), kinds[p]) for p in properties], F.col("label"))
    return nodes.select("id", F.lit(header).alias("header"), line.alias("line"))


def batches(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with batch: 0, 1, ... within each group, BATCH rows of the order each.

    Rows are numbered over all groups at once and the group's first number taken off, so a
    group of any size is never in one task.
    """
    numbered = settle(number_rows(rows, [*group, *order], "_n"), "numbered")
    first = numbered.groupBy(*group).agg(F.min("_n").alias("_first"))
    return numbered.join(F.broadcast(first), list(group)).withColumn("batch", F.floor((F.col("_n") - F.col("_first")) / BATCH).cast("bigint")).drop("_n", "_first")


def cypher_literal(value: Column, kind: str) -> Column:
    if kind in ("boolean", "int", "bigint", "double"):
        return value.cast("string")
    text = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("'"), text, F.lit("'"))


def cypher_nodes(nodes: DataFrame, properties: Sequence[str]) -> DataFrame:
    """(label, batch, script): one UNWIND and MERGE for each batch of nodes."""
    kinds = dict(nodes.dtypes)
    pairs = [F.concat(F.lit(f"`{p}`: "), cypher_literal(F.col(p), kinds[p])) for p in ("id", *properties)]
    made = batches(nodes, ["label"], ["id"]).withColumn("_map", F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "_map"))), lambda x: x["_map"]), ", ")
    merge = F.concat(F.lit("UNWIND ["), rows, F.lit("] AS row\nMERGE (n:"), F.first("label"), F.lit(" {id: row.id}) SET n += row;"))
    return made.groupBy("label", "batch").agg(merge.alias("script"))


