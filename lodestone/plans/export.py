"""Sinks: tables as Parquet or JSON lines, documents as text, the graph as bulk-import CSV and as a script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans.logic import Logic
from lodestone.plans.property_graph import LABELS, PropertyGraph

FACTS = ("job", "step", "dd", "csd", "mapset", "map", "field", "table", "column", "foreign_key", "view", "index", "object", "vsam", "select")


def tables(logic: Logic) -> dict[str, DataFrame]:
    """Every table of an estate by name."""
    i, p = logic.inventory, logic.programs
    out = {"files": i.files.drop("text"), "programs": i.classified, "copybooks": i.copybooks, "references": i.references, "edges": i.edges, "nodes": i.nodes, "issues": i.issues.union(p.issues)}
    out |= {f"inventory_{f}": i.table(f) for f in FACTS}
    out |= {f"program_{f}": p.table(f) for f in ("expansion", "entry", "file", "section", "pseudocode", "outline", "branch", "phrase")}
    return out | {"statements": p.statements, "paragraphs": p.paragraphs, "records": p.records, "fields": p.fields, "branches": logic.branches, "rules": logic.rules, "loops": logic.loops, "io": logic.io, "flows": logic.flows}


def write_tables(logic: Logic, folder: str, fmt: str = "parquet") -> None:
    for name, df in tables(logic).items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
    # one folder a program, as readers of single programs want it
    logic.programs.statements.withColumn("program", F.regexp_replace("of", "^program:", "")).write.mode("overwrite").partitionBy("program").format(fmt).save(f"{folder}/statements_by_program")


def write_lines(lines: DataFrame, folder: str, by: str | None = None) -> None:
    """Lines in order as text, one file; with by, a folder for each of its values."""
    if by is None:
        lines.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(folder)
    else:
        lines.repartition(by).sortWithinPartitions(by, "ord").select(by, "line").write.mode("overwrite").partitionBy(by).text(folder)


def write_graph_csv(g: PropertyGraph, folder: str) -> None:
    """Bulk-import files: a folder for each label and each relationship type."""
    for label, properties in LABELS.items():
        own = g.nodes.where(F.col("label") == label)
        columns = [F.col("id").alias("id:ID"), *[F.coalesce(F.col("name") if p == "name" else F.element_at("properties", p), F.lit("")).alias(p) for p in properties.split()], F.col("missing"), F.col("label").alias(":LABEL")]
        own.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/nodes/{label}")
    g.rels.select(F.col("from_id").alias(":START_ID"), F.col("count").alias("count:int"), F.col("to_id").alias(":END_ID"), F.col("type").alias(":TYPE"), F.col("type").alias("rel")).write.mode("overwrite").option("header", True).partitionBy("rel").csv(f"{folder}/rels")


def write_cypher(g: PropertyGraph, folder: str) -> None:
    """A script: constraints, nodes and relationships in batches."""
    nodes = graph.cypher_nodes(g.nodes.drop("properties"), ["name", "missing"]).select(F.lit(1).alias("part"), F.col("label").alias("a"), F.lit("").alias("b"), "batch", "script")
    labels = g.nodes.select("label").distinct().select(F.lit(0).alias("part"), F.col("label").alias("a"), F.lit("").alias("b"), F.lit(0).cast("bigint").alias("batch"), F.concat(F.lit("CREATE CONSTRAINT "), F.lower("label"), F.lit("_id IF NOT EXISTS FOR (n:"), "label", F.lit(") REQUIRE n.id IS UNIQUE;")).alias("script"))
    ends = [g.nodes.select(F.col("id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label")) for s in ("from", "to")]
    rels = graph.batches(g.rels.join(ends[0], "from_id").join(ends[1], "to_id"), ["type", "from_label", "to_label"], ["from_id", "to_id"])
    one = F.concat(F.lit("{a: "), graph.cypher_literal(F.col("from_id"), "string"), F.lit(", b: "), graph.cypher_literal(F.col("to_id"), "string"), F.lit(", n: "), "count", F.lit("}"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from_id", "to_id", one.alias("one")))), lambda x: x["one"]), ", ")
    drawn = rels.groupBy("type", "from_label", "to_label", "batch").agg(listed.alias("rows")).select(F.lit(2), "type", F.concat("from_label", "to_label"), "batch", F.concat(F.lit("UNWIND ["), "rows", F.lit("] AS row\nMATCH (a:"), "from_label", F.lit(" {id: row.a}) MATCH (b:"), "to_label", F.lit(" {id: row.b}) MERGE (a)-[r:"), "type", F.lit("]->(b) SET r.count = row.n;")))
    labels.union(nodes).union(drawn).orderBy("part", "a", "b", "batch").select("script").coalesce(1).write.mode("overwrite").text(folder)
