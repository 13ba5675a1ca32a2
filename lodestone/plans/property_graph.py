"""The property graph of an estate: nodes of twelve labels, relationships, and the queries that are asked of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import control_flow, gaps, graph
from lodestone.plans.logic import Logic
from lodestone.sources.settled import settle

# fixed values: labels with their properties, and the relationship of each direction of a flow
LABELS = {
    "Program": "name kind path entry_point complexity paragraphs", "Copybook": "name path content_kind", "Job": "name path", "Transaction": "name path", "Paragraph": "name program path line reachable complexity",
    "Record": "name size path line", "Field": "name qualified_name category picture usage size offset", "Condition": "name values", "DataStore": "name kind", "Rule": "category significance business reachable condition path line",
    "Map": "name mapset", "Gap": "severity category title",
}
FLOWS = {"read": "READS", "write": "WRITES", "update": "UPDATES", "delete": "DELETES"}


class PropertyGraph:
    """nodes (id, label, name, missing, properties) and rels (from_id, type, to_id, count)."""

    def __init__(self, logic: Logic) -> None:
        self.logic, self.programs, self.inventory = logic, logic.programs, logic.inventory

    @staticmethod
    def _nodes(df: DataFrame, label: str, id_: str, name: str, **properties) -> DataFrame:
        pairs = [x for key, value in properties.items() for x in (F.lit(key), value.cast("string"))]
        held = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        return df.select(F.expr(id_).alias("id"), F.lit(label).alias("label"), F.expr(name).alias("name"), F.lit(False).alias("missing"), held.alias("properties"))

    @cached_property
    def gaps(self) -> DataFrame:
        found = self.inventory.issues.union(self.programs.issues)
        loops = self.logic.loops.where("termination = 'potential_infinite'").select(F.lit("warning"), F.lit("potential_infinite_loop").alias("code"), F.col("of").alias("subject"), "file", "line")
        lengths = self.logic.length_mismatches.select(F.lit("warning"), F.lit("record_length_mismatch").alias("code"), F.col("program").alias("subject"), F.lit(None).cast("string"), F.lit(None).cast("int"))
        more = loops.union(lengths)
        issues = settle(found.union(more.withColumn("message", gaps.message(F.col("code"), F.col("subject")))).withColumn("ord", F.coalesce("line", F.lit(0))), "issues")
        dead = self.logic.rules.where("business and not reachable").select(F.col("of").alias("program"), F.col("file").alias("path"), "line", F.col("line").alias("ord"))
        return settle(gaps.register(issues, dead), "gaps")

    @cached_property
    def _parts(self) -> tuple[DataFrame, DataFrame]:
        c = F.col
        names = self.inventory.programs.select(c("id").alias("program"), c("name").alias("program_name")).distinct()
        totals = self.programs.complexity.groupBy("program").agg((F.sum(c("complexity") - 1) + 1).alias("complexity"), F.count("*").alias("paragraphs"))
        programs = self.inventory.classified.join(totals, c("id") == c("program"), "left")
        told = self.programs.paragraphs.join(self.programs.reachable, ["program", "ord"]).join(self.programs.complexity.withColumnRenamed("paragraph", "ord"), ["program", "ord"]).join(names, "program")
        paragraph = F.concat_ws(":", F.lit("paragraph"), "program_name", "name")
        told = told.withColumn("node", paragraph)
        records = self.programs.records
        once = records.groupBy("id").agg(F.min(F.struct("name", "size", "file", "line")).alias("r")).select("id", "r.*")
        fields = self.programs.fields
        conditions = self.programs.table("condition").join(fields.select("of", "path", "record_ord", c("qualified_name").alias("field"), c("id").alias("field_id"), c("level").alias("field_level")), ["of", "path", "record_ord", "field"])
        conditions = conditions.withColumn("node", F.concat(F.lit("condition:"), F.regexp_replace("field_id", "^field:", ""), F.lit(":"), "name"))
        flows = self.logic.flows
        stores = flows.select(c("entity").alias("id")).union(self.inventory.table("table").select("id")).union(self.inventory.csd.where("type = 'FILE'").select(F.concat(F.lit("cics_file:"), "name"))).distinct()
        rules = self.logic.rules.where("business")
        parts = [
            self._nodes(programs, "Program", "id", "name", kind=c("kind"), path=c("path"), entry_point=c("entry_point"), complexity=c("complexity"), paragraphs=c("paragraphs")),
            self._nodes(self.inventory.copybooks, "Copybook", "id", "name", path=c("path"), content_kind=c("content_kind")),
            self._nodes(self.inventory.table("job").where("kind = 'job'"), "Job", "id", "name", path=c("path")),
            self._nodes(self.inventory.csd.where("type = 'TRANSACTION'"), "Transaction", "concat('transaction:', name)", "name", path=c("path")),
            self._nodes(self.inventory.table("map"), "Map", "id", "name", mapset=c("mapset")),
            self._nodes(stores, "DataStore", "id", "regexp_replace(id, '^[^:]*:', '')", kind=F.substring_index("id", ":", 1)),
            self._nodes(told, "Paragraph", "node", "name", program=c("program_name"), path=c("file"), line=c("line"), reachable=c("reachable"), complexity=c("complexity")),
            self._nodes(once, "Record", "id", "name", size=c("size"), path=c("file"), line=c("line")),
            self._nodes(fields.where("level <> 1"), "Field", "id", "name", qualified_name=c("qualified_name"), category=c("category"), picture=c("picture"), usage=c("usage"), size=c("size"), offset=c("offset")),
            self._nodes(conditions, "Condition", "node", "name", **{"values": F.array_join("values", ", ")}),
            self._nodes(rules, "Rule", "rule_id", "condition", category=c("category"), significance=c("significance"), business=c("business"), reachable=c("reachable"), path=c("file"), line=c("line")),
            self._nodes(self.gaps, "Gap", "gap_id", "code", severity=c("severity"), category=c("category"), title=c("title")),
        ]
        nodes = parts[0]
        for p in parts[1:]:
            nodes = nodes.union(p)
        nodes = nodes.groupBy("id").agg(F.min_by("label", F.to_json("properties")).alias("label"), F.min_by("name", F.to_json("properties")).alias("name"), F.bool_and("missing").alias("missing"), F.min_by("properties", F.to_json("properties")).alias("properties"))
        nodes = settle(nodes, "nodes")
        e = self.inventory.edges.withColumn("rel", graph._chosen(graph.RELATIONSHIPS, c("type"))).where("rel is not null")
        added = e.select(c("to_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").withColumn("label", graph._chosen(graph.ADDED_LABELS, F.substring_index("id", ":", 1))).where("label is not null")
        nodes = settle(nodes.union(added.select("id", "label", F.regexp_replace("id", "^[^:]*:", ""), F.lit(True), F.create_map().cast("map<string,string>"))), "nodes")
        owner = F.when(c("copybook").isNotNull(), F.concat(F.lit("copybook:"), "copybook")).otherwise(c("of"))
        member = control_flow.range_members(self.programs.flow_edges.where("type = 'PERFORM'"))
        at = told.select("program", c("ord"), c("node").alias("caller"))
        performs = member.join(at, ["program", "ord"]).join(told.select("program", c("ord").alias("member"), c("node").alias("called")), ["program", "member"])
        one = F.lit(1).cast("bigint")
        rels = [
            e.select("from_id", c("rel").alias("type"), "to_id", "count"),
            flows.where(c("direction").isin(*FLOWS)).select("program", graph._chosen(FLOWS, c("direction")), "entity", one),
            records.select(owner, F.lit("DEFINES"), "id", one), fields.where("level <> 1").select("record", F.lit("HAS_FIELD"), "id", one), conditions.select("field_id", F.lit("HAS_CONDITION"), "node", one),
            told.select("program", F.lit("HAS_PARAGRAPH"), "node", one), performs.select("caller", F.lit("PERFORMS"), "called", one),
            rules.select("rule_id", F.lit("IN_PARAGRAPH"), F.concat_ws(":", F.lit("paragraph"), "program", "paragraph"), one), self.gaps.select("gap_id", F.lit("AFFECTS"), "subject", one),
        ]
        all_ = rels[0]
        for r in rels[1:]:
            all_ = all_.union(r)
        there = nodes.select("id")
        all_ = all_.join(there, c("from_id") == c("id"), "left_semi").join(there, c("to_id") == c("id"), "left_semi").groupBy("from_id", "type", "to_id").agg(F.sum("count").alias("count"))
        return nodes, settle(all_, "rels")

    @property
    def nodes(self) -> DataFrame:
        return self._parts[0]

    @property
    def rels(self) -> DataFrame:
        return self._parts[1]

    # the queries

    def _hop(self, *types: str, left: str = "a", right: str = "b") -> DataFrame:
        ends = [self.nodes.select(F.col("id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label"), F.col("name").alias(f"{s}_name"), F.col("missing").alias(f"{s}_missing"), F.col("properties").alias(f"{s}_p")) for s in (left, right)]
        own = self.rels.where(F.col("type").isin(*types)).select(F.col("from_id").alias(f"{left}_id"), "type", F.col("to_id").alias(f"{right}_id"))
        return own.join(ends[0], f"{left}_id").join(ends[1], f"{right}_id")

    def readers_and_writers(self) -> DataFrame:
        return self._hop(*FLOWS.values()).groupBy(F.col("b_name").alias("store"), F.col("type").alias("access")).agg(F.array_join(F.sort_array(F.collect_set("a_name")), ",").alias("programs"))

    def producers_and_consumers(self) -> DataFrame:
        writes = self._hop("WRITES", "UPDATES").select(F.col("a_name").alias("producer"), F.col("b_name").alias("store"))
        reads = self._hop("READS").select(F.col("a_name").alias("consumer"), F.col("b_name").alias("store"))
        return writes.join(reads, "store").where("producer <> consumer").distinct()

    def rules_of(self, program: str) -> DataFrame:
        return self._hop("IN_PARAGRAPH").where(F.col("b_p.program") == program).select(F.col("a_id").alias("rule"), F.col("a_p.category").alias("category"), F.col("a_p.reachable").alias("reachable"), F.col("b_name").alias("paragraph"))

    def rules_that_never_run(self) -> DataFrame:
        return self._hop("IN_PARAGRAPH").where("a_p.reachable = 'false'").select(F.col("b_p.program").alias("program"), F.col("b_name").alias("paragraph"), F.col("a_id").alias("rule"))

    def unreachable_paragraphs(self) -> DataFrame:
        return self._hop("HAS_PARAGRAPH").where("b_p.reachable = 'false'").select(F.col("a_name").alias("program"), F.col("b_name").alias("paragraph"))

    def most_complex(self, most: int = 10) -> DataFrame:
        p = self.nodes.where("label = 'Program' and properties.complexity is not null").select("name", F.col("properties.complexity").cast("int").alias("complexity"))
        return p.orderBy(F.desc("complexity"), "name").limit(most)

    def fields_of(self, record: str) -> DataFrame:
        f = self._hop("HAS_FIELD").where(F.col("a_name") == record).select(F.col("b_id").alias("field"), F.col("b_p.qualified_name").alias("qualified_name"), F.col("b_p.offset").cast("int").alias("offset"), F.col("b_p.size").cast("int").alias("size"))
        c = self._hop("HAS_CONDITION").groupBy(F.col("a_id").alias("field")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "b_name", F.col("b_p.values")))), ",").alias("conditions"))
        return f.join(c, "field", "left").drop("field")

    def uses_of_field(self, field: str) -> DataFrame:
        f = self._hop("HAS_FIELD").where(F.col("b_name") == field).select(F.col("a_id").alias("record"), F.col("b_p.qualified_name").alias("field"))
        owners = self._hop("DEFINES").select(F.col("b_id").alias("record"), F.col("a_label").alias("owner_kind"), F.col("a_name").alias("owner"))
        return f.join(owners, "record").select("field", "record", "owner_kind", "owner").distinct()

    def urgent_gaps(self) -> DataFrame:
        g = self.nodes.where("label = 'Gap' and properties.severity = 'high'").select(F.col("id").alias("gap"), F.col("properties.category").alias("category"))
        hit = self._hop("AFFECTS").select(F.col("a_id").alias("gap"), F.col("b_name").alias("affects"))
        return g.join(hit, "gap", "left")

    def chains(self, program: str, most: int = 4) -> DataFrame:
        """Call chains of a program's paragraphs, from those that nobody performs."""
        own = self._hop("PERFORMS").where(F.col("a_p.program") == program).select(F.lit(program).alias("program"), F.col("a_name").alias("src"), F.col("b_name").alias("dst"))
        return graph.chains(own, most)

    def screens(self) -> DataFrame:
        return self._hop("USES_MAP").select(F.col("a_name").alias("program"), F.col("b_name").alias("map"), F.col("b_missing").alias("missing"))


