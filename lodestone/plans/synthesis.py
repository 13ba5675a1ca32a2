"""What an estate adds up to: entry points, the register of gaps, annotations, and a requirements document as lines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import checks, gaps
from lodestone.plans.diagrams import Diagrams
from lodestone.plans.property_graph import PropertyGraph

#: Gaps and rules that a chapter lists.
LISTED = 15


def cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |"))


class Synthesis:
    def __init__(self, graph: PropertyGraph, system: str = "estate") -> None:
        self.graph, self.logic, self.inventory, self.system = graph, graph.logic, graph.inventory, system
        self.spark = self.inventory.files.sparkSession

    @cached_property
    def entry_points(self) -> DataFrame:
        """(id, kind, programs, path, line) of jobs and transactions."""
        runs = self.inventory.table("step").groupBy(F.col("owner").alias("id")).agg(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("step_order", F.coalesce("run_program", "program").alias("p")))), lambda x: x["p"])).alias("programs"))
        jobs = self.inventory.table("job").where("kind = 'job'").select("id", F.lit("batch job").alias("kind"), "path", "line").join(runs, "id", "left")
        starts = self.inventory.csd.where("type = 'TRANSACTION'").select(F.concat(F.lit("transaction:"), "name").alias("id"), F.lit("online transaction").alias("kind"), "path", "line", F.array_compact(F.array(F.element_at("attributes", "PROGRAM"))).alias("programs"))
        return jobs.unionByName(starts)

    @cached_property
    def register(self) -> DataFrame:
        return gaps.ranked(self.graph.gaps)

    def annotations(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted items, problems): a file with any problem is rejected as a whole; of a target and kind the last counts."""
        files = self.inventory.files.select("path", "lines")
        problems = checks.annotation_problems(items, self.graph.nodes.select("id"), files)
        return checks.accepted(items, problems), problems

    def _chapter(self, number: int, title: str, body: DataFrame) -> DataFrame:
        """(chapter, key, line) of a heading and a body of (key, line)."""
        head = self.spark.createDataFrame([(number, "", f"## {number}. {title}"), (number, " ", "")], "chapter int, key string, line string")
        return head.union(body.select(F.lit(number), F.concat(F.lit("!"), "key"), "line"))

    def _table(self, df: DataFrame, columns: list[str], key: Column) -> DataFrame:
        heads = self.spark.createDataFrame([(" 0", "| " + " | ".join(columns) + " |"), (" 1", "|" + "-|" * len(columns))], "key string, line string")
        return heads.union(df.select(key.cast("string"), row(*[F.col(c) for c in columns])))

    @cached_property
    def document(self) -> DataFrame:
        """(ord, line) of the requirements document."""
        files = checks.count_by(self.inventory.files, ["kind"])
        programs = self.inventory.classified.select("name", "kind", "path", F.array_join("called_by", ", ").alias("called_by"), F.array_join("executed_by", ", ").alias("executed_by"))
        rules = self.logic.rules.where("business").select("rule_id", "category", "significance", "paragraph", F.col("condition"), "reachable")
        chapters = [
            ("Scope", self._table(files, ["metric", "value"], F.col("metric"))),
            ("Entry points", self._table(self.entry_points.withColumn("programs", F.array_join("programs", ", ")), ["id", "kind", "programs", "path"], F.col("id"))),
            ("Programs", self._table(programs, ["name", "kind", "path", "called_by", "executed_by"], F.col("name"))),
            ("Data stores", self._table(self.graph.readers_and_writers(), ["store", "access", "programs"], F.concat_ws("/", "store", "access"))),
            ("Lineage", self._table(self.graph.producers_and_consumers(), ["producer", "store", "consumer"], F.concat_ws("/", "store", "producer", "consumer"))),
            ("Business rules", self._table(rules, ["rule_id", "category", "significance", "paragraph", "condition", "reachable"], F.concat_ws("/", F.lit(9) - F.col("significance"), "rule_id"))),
            ("Record layouts", self._table(self.logic.programs.fields, ["record", "qualified_name", "offset", "size", "picture", "usage"], F.concat_ws("/", "record", F.lpad(F.col("row").cast("string"), 9, "0")))),
            ("Gaps and risks", self._table(self.register.where(F.col("rank") <= LISTED), ["rank", "severity", "category", "code", "subject", "count"], F.lpad(F.col("rank").cast("string"), 9, "0"))),
        ]
        out = self.spark.createDataFrame([(0, "", f"# Business requirements: {self.system}"), (0, " ", "")], "chapter int, key string, line string")
        for number, (title, body) in enumerate(chapters, 1):
            out = out.union(self._chapter(number, title, body))
        diagrams = Diagrams(self.logic).all.where("diagram in ('system_context', 'data_lineage')").select(F.concat_ws("/", "diagram", F.lpad(F.col("ord").cast("string"), 9, "0")).alias("key"), "line")
        out = out.union(self._chapter(len(chapters) + 1, "Diagrams", diagrams))
        return out.withColumn("ord", F.row_number().over(Window.orderBy("chapter", "key", "line"))).select("ord", "line")
