"""Diagrams of an estate as line tables: system context, data lineage, jobs, the data model, paragraph structure."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.mermaid import flowchart, label, lint, node_id
from lodestone.plans.logic import Logic
from lodestone.sources.settled import settle

# fixed values: what an edge of the context says
SAYS = {"JCL_EXEC": "runs", "JCL_RUN": "runs (DSN)", "CSD_TRANSACTION": "starts", "STATIC_CALL": "CALL", "CICS_LINK": "LINK", "CICS_XCTL": "XCTL"}


def _choose(mapping: dict[str, str], of: Column) -> Column:
    return F.coalesce(*[F.when(of == k, v) for k, v in mapping.items()])


class Diagrams:
    def __init__(self, logic: Logic) -> None:
        self.logic, self.inventory, self.programs = logic, logic.inventory, logic.programs

    def _title(self, diagram: str, title: str) -> DataFrame:
        return self.inventory.files.sparkSession.createDataFrame([(diagram, title)], "diagram string, title string")

    @cached_property
    def context(self) -> DataFrame:
        e = self.inventory.edges.where(F.col("type").isin(*SAYS))
        kinds = self.inventory.classified.select(F.col("id"), F.col("kind").alias("program_kind")).groupBy("id").agg(F.first("program_kind").alias("program_kind"))
        ids = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct().join(kinds, "id", "left")
        kind, name = F.substring_index("id", ":", 1), F.regexp_replace("id", "^[^:]*:", "")
        text = F.when(kind.isin("program", "utility"), name).otherwise(F.concat_ws(" ", kind, name))
        shape = F.when(kind == "job", "para").when(kind == "transaction", "hex").when(kind == "utility", "sub").when((kind == "program") & F.col("program_kind").isNull(), "hex").otherwise("box")
        cls = F.when(kind == "program", F.coalesce("program_kind", F.lit("missing"))).when(kind == "utility", "subroutine").otherwise(kind)
        nodes = ids.select(F.lit("system_context").alias("diagram"), node_id(F.col("id")).alias("id"), text.alias("text"), shape.alias("shape"), cls.alias("cls"))
        says = F.concat(_choose(SAYS, F.col("type")), F.when(F.col("count") > 1, F.concat(F.lit(" x"), "count")).otherwise(""))
        drawn = e.select(F.lit("system_context").alias("diagram"), node_id(F.col("from_id")).alias("src"), node_id(F.col("to_id")).alias("dst"), says.alias("text"), F.when(F.col("resolution").isin("resolved", "ambiguous"), "-->").otherwise("-.->").alias("style"), F.lit(0).alias("ord"))
        return flowchart(nodes, drawn, self._title("system_context", "System context: jobs, transactions and program calls"), "LR")

    @cached_property
    def lineage(self) -> DataFrame:
        f = self.logic.flows.select("program", "entity", "direction").distinct()
        short = F.regexp_replace("program", "^[^:]*:", "")
        stores = f.select(F.lit("data_lineage").alias("diagram"), node_id(F.col("entity")).alias("id"), F.replace("entity", F.lit(":"), F.lit(" ")).alias("text"), F.lit("db").alias("shape"), F.lit("store").alias("cls"))
        programs = f.select(F.lit("data_lineage"), node_id(F.col("program")), short, F.lit("box"), F.lit("batch"))
        reads = F.col("direction") == "read"
        p, s = node_id(F.col("program")), node_id(F.col("entity"))
        drawn = f.select(F.lit("data_lineage").alias("diagram"), F.when(reads, s).otherwise(p).alias("src"), F.when(reads, p).otherwise(s).alias("dst"), F.col("direction").alias("text"), F.lit("-->").alias("style"), F.lit(0).alias("ord"))
        return flowchart(stores.union(programs), drawn, self._title("data_lineage", "Data lineage: which programs read and write which data stores"), "LR")

    @cached_property
    def jobs(self) -> DataFrame:
        """One diagram a job: its steps, and the datasets of their DDs."""
        steps = self.inventory.table("step").where("owner like 'job:%'").select("owner_name", "owner", "step_order", "name", "utility", F.coalesce("run_program", "program", "proc", F.lit("?")).alias("runs"))
        diagram = F.concat(F.lit("job_"), node_id(F.col("owner_name")))
        job, step = node_id(F.lit("job"), F.col("owner_name")), node_id(F.lit("step"), F.col("owner_name"), F.coalesce("name", F.col("step_order").cast("string")))
        jobs = steps.select(diagram.alias("diagram"), job.alias("id"), F.concat(F.lit("job "), "owner_name").alias("text"), F.lit("para").alias("shape"), F.lit("job").alias("cls"))
        boxes = steps.select(diagram, step, F.concat(F.lit("step "), F.coalesce("name", F.lit("?")), F.lit(": "), "runs"), F.lit("box"), F.when(F.col("utility"), "sub").otherwise("batch"))
        dds = self.inventory.table("dd").where("dsn is not null").select("owner", "step_order", "dd_order", F.col("name").alias("ddname"), "dsn", "disp").join(steps, ["owner", "step_order"])
        store = node_id(F.lit("dataset"), F.col("dsn"))
        stores = dds.select(diagram, store, "dsn", F.lit("db"), F.lit("store"))
        runs = steps.select(diagram.alias("diagram"), job.alias("src"), step.alias("dst"), F.concat(F.lit("step "), "step_order").alias("text"), F.lit("-->").alias("style"), F.col("step_order").alias("ord"))
        uses = dds.select(diagram, step, store, F.trim(F.concat_ws(" ", "ddname", "disp")), F.lit("-->"), F.col("step_order") * 1000 + F.col("dd_order"))
        titles = steps.select(diagram.alias("diagram"), F.concat(F.lit("Batch job "), "owner_name").alias("title")).distinct()
        return flowchart(jobs.union(boxes).union(stores), runs.union(uses), titles, "LR")

    @cached_property
    def model(self) -> DataFrame:
        """The database's tables with their keys."""
        tables = self.inventory.table("table").select(F.col("name").alias("table"), "primary_key")
        keys = self.inventory.table("foreign_key")
        foreign = keys.select("table", F.explode("columns").alias("name")).distinct().withColumn("is_foreign", F.lit(True))
        columns = self.inventory.table("column").select("table", "position", "name", "type").join(tables, "table").join(foreign, ["table", "name"], "left")
        kind = F.regexp_replace(F.regexp_replace("type", "[^A-Za-z0-9]", "_"), "^_+|_+$", "")
        marks = F.array_join(F.array_compact(F.array(F.when(F.array_contains("primary_key", F.col("name")), "PK"), F.when(F.col("is_foreign").isNotNull(), "FK"))), ",")
        column = F.rtrim(F.concat(F.lit("    "), F.when(kind == "", "UNKNOWN").otherwise(kind), F.lit(" "), node_id(F.col("name")), F.lit(" "), marks))
        name = node_id(F.col("table"))
        body = tables.select("table", F.lit(0).alias("part"), F.concat(F.lit("  "), name, F.lit(" {")).alias("line")).union(columns.select("table", "position", column)).union(tables.select("table", F.lit(1 << 20), F.lit("  }")))
        links = keys.select(F.col("table"), F.lit(1 << 21), F.concat(F.lit("  "), node_id(F.col("references")), F.lit(" ||--o{ "), name, F.lit(" : "), label(F.array_join("columns", ", "))))
        rows = body.withColumn("block", F.lit(1)).union(links.withColumn("block", F.lit(2)))
        head = self.inventory.files.sparkSession.createDataFrame([("", k, x, 0) for k, x in enumerate(("---", "title: Data model", "---", "erDiagram"))], "table string, part int, line string, block int")
        order = Window.orderBy("block", "table", "part", "line")  # one diagram: as many rows as it has lines
        return head.union(rows).select(F.lit("erd").alias("diagram"), F.row_number().over(order).alias("ord"), "line")

    @cached_property
    def paragraphs(self) -> DataFrame:
        """One diagram a program: paragraphs, and where they transfer control; what never runs and what is not defined are marked."""
        p = self.programs.paragraphs.join(self.programs.reachable, ["program", "ord"])
        short = F.regexp_replace("program", "^[^:]*:", "")
        diagram = F.concat(F.lit("program_"), node_id(short), F.lit("_paragraphs"))
        at = node_id(F.lit("p"), F.col("name"))
        nodes = p.select(diagram.alias("diagram"), at.alias("id"), F.concat("name", F.when(F.col("reachable"), "").otherwise(" (never runs)")).alias("text"), F.lit("box").alias("shape"), F.when(F.col("ord") == 0, "entry").when(~F.col("reachable"), "dead").alias("cls"))
        moves = self.programs.resolved_transfers
        lost = moves.where("missing is not null").select(diagram, node_id(F.lit("p"), F.col("missing")), F.concat("missing", F.lit(" (not defined)")), F.lit("hex"), F.lit("missing"))
        sources = p.select("program", F.col("ord").alias("paragraph"), F.col("name").alias("source_name"))
        targets = p.select("program", F.col("ord").alias("lo"), F.col("name").alias("target_name"))
        wide = moves.join(sources, ["program", "paragraph"]).join(targets, ["program", "lo"], "left")
        says = F.concat(
            F.coalesce(_choose({"PERFORM": "perform", "GO TO": "go to", "CICS HANDLE": "on CICS condition", "ALTER": "altered"}, F.col("type")), F.lower("type")),
            F.coalesce(F.concat(F.lit(" thru "), "thru"), F.lit("")), F.coalesce(F.concat(F.lit(" ("), "loop", F.lit(")")), F.lit("")),
        )
        drawn = wide.select(diagram.alias("diagram"), node_id(F.lit("p"), F.col("source_name")).alias("src"), node_id(F.lit("p"), F.coalesce("target_name", "missing")).alias("dst"), says.alias("text"), F.when((F.col("type") == "PERFORM") & F.col("missing").isNull(), "-->").otherwise("-.->").alias("style"), F.col("paragraph").alias("ord")).distinct()
        titles = p.select(diagram.alias("diagram"), F.concat(short, F.lit(": paragraph structure")).alias("title")).distinct()
        return flowchart(nodes.union(lost), drawn, titles, "TD")

    @cached_property
    def all(self) -> DataFrame:
        return settle(self.context.union(self.lineage).union(self.jobs).union(self.model).union(self.paragraphs), "diagrams")

    def problems(self) -> DataFrame:
        return lint(self.all)
