"""Constraint queries over an estate's tables: each row is a problem (check, subject, problem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import checks
from lodestone.plans.diagrams import Diagrams
from lodestone.plans.inventory import Inventory
from lodestone.plans.logic import Logic
from lodestone.plans.property_graph import PropertyGraph


def _told(df: DataFrame, check: str, subject: Column | str, problem: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), F.lit(problem).alias("problem"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def inventory(i: Inventory) -> DataFrame:
    refs, nodes = i.references, i.nodes
    return _all([
        _told(checks.duplicates(refs, "ref_id"), "inventory", "ref_id", "reference id is used twice"),
        _told(checks.missing_keys(refs, "path", i.files, "path"), "inventory", "ref_id", "cites a file that is not there"),
        _told(refs.where("line is null or line < 1"), "inventory", "ref_id", "has no line"),
        _told(refs.where("resolution in ('resolved', 'ambiguous') and to_id is null"), "inventory", "ref_id", "is resolved without a target"),
        _told(checks.missing_keys(refs, "from_id", nodes, "id"), "inventory", "ref_id", "comes from no node"),
        _told(checks.missing_keys(refs, "to_id", nodes, "id"), "inventory", "ref_id", "leads to no node"),
        _told(i.edges.where("count <> size(references)"), "inventory", F.concat_ws(" ", "from_id", "type", "to_id"), "count is not the number of references"),
        _told(checks.duplicates(i.copybooks, "id"), "inventory", "id", "copybook id is used twice"),
        _told(checks.missing_keys(i.issues, "path", i.files, "path"), "inventory", "code", "issue cites a file that is not there"),
    ])


def programs(logic: Logic) -> DataFrame:
    p = logic.programs
    lines = logic.inventory.files.select(F.col("path").alias("file"), "lines")
    st = p.statements
    return _all([
        _told(st.join(lines, "file", "left").where("lines is null or line > lines"), "parser", F.concat_ws(":", "file", "line"), "statement is beyond its file"),
        _told(checks.duplicates(st.select(F.concat_ws("/", "of", "id").alias("k")), "k"), "parser", "k", "statement id is used twice"),
        _told(st.where("parent is not null and parent >= id"), "parser", F.concat_ws("/", "of", "id"), "statement comes before its parent"),
        _told(p.paragraphs.where("end_line < line"), "parser", F.concat_ws("/", "program", "name"), "paragraph ends before it begins"),
        _told(p.flow_edges.join(p.paragraphs.select("program", F.col("ord").alias("lo")), ["program", "lo"], "left_anti"), "parser", F.concat_ws("/", "program", "ord"), "transfer leads to no paragraph"),
    ])


def data(logic: Logic) -> DataFrame:
    p = logic.programs
    sizes = p.records.groupBy("id").agg(F.max("size").alias("whole")).withColumnRenamed("id", "record")
    return _all([
        _told(p.fields.join(sizes, "record").where("whole is not null and size is not null and offset is not null and offset + size * coalesce(occurs, 1) > whole"), "data", "id", "field ends beyond its record"),
        _told(checks.missing_keys(p.fields, "record", p.records, "id"), "data", "id", "field has no record"),
        _told(checks.missing_keys(logic.flows, "program", logic.inventory.programs, "id"), "data", F.concat_ws(" ", "program", "entity"), "flow has no program"),
    ])


def rules(logic: Logic) -> DataFrame:
    r = logic.rules
    return _all([
        _told(checks.duplicates(logic.branches, "id"), "logic", "id", "branch id is used twice"),
        _told(checks.duplicates(r, "rule_id"), "rules", "rule_id", "rule id is used twice"),
        _told(r.where("business and category in ('error_handling', 'control_flow')"), "rules", "rule_id", "technical rule is marked business"),
        _told(r.where("significance not between 1 and 5"), "rules", "rule_id", "significance is out of range"),
    ])


def diagrams(d: Diagrams) -> DataFrame:
    return d.problems().select(F.lit("diagrams").alias("check"), F.col("diagram").alias("subject"), "problem")


def graph(g: PropertyGraph) -> DataFrame:
    return _all([
        _told(checks.duplicates(g.nodes, "id"), "graph", "id", "node id is used twice"),
        _told(checks.missing_keys(g.rels, "from_id", g.nodes, "id"), "graph", "from_id", "relationship begins nowhere"),
        _told(checks.missing_keys(g.rels, "to_id", g.nodes, "id"), "graph", "to_id", "relationship ends nowhere"),
    ])


def everything(g: PropertyGraph) -> DataFrame:
    return _all([inventory(g.inventory), programs(g.logic), data(g.logic), rules(g.logic), diagrams(Diagrams(g.logic)), graph(g)])
