"""python -m lodestone COMMAND --root DIR [--out DIR] ...: stages of an estate, their checks, and the annotation gate.

Exit codes: 0 all well, 1 problems found, 2 a wrong call.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import export, validate
from lodestone.plans.diagrams import Diagrams
from lodestone.plans.inventory import Inventory
from lodestone.plans.logic import Logic
from lodestone.plans.programs import Programs
from lodestone.plans.property_graph import PropertyGraph
from lodestone.plans.synthesis import Synthesis
from lodestone.sources import members

STAGES = ("inventory", "parse", "data", "logic", "rules", "diagrams", "synthesize", "graph")
CHECKED = {"validate-inventory": "inventory", "validate-parser": "programs", "validate-data": "data", "validate-logic": "rules", "validate-rules": "rules"}
#: Problems that are shown.
SHOWN = 100


class Run:
    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.args = spark, args
        self.inventory = Inventory(members.scan(spark, args.root, exclude_globs=args.exclude))
        self.logic = Logic(Programs(self.inventory, args.program or None))
        self.graph = PropertyGraph(self.logic)

    def told(self, problems: DataFrame) -> int:
        found = problems.limit(SHOWN).collect()
        for p in found:
            print(*p, sep="\t")
        return int(bool(found))

    def inventory_(self) -> int:
        if self.args.entry:
            self.inventory.scope(self.args.entry).orderBy("depth", "node").show(SHOWN, False)
        self.inventory.issues.groupBy("severity", "code").count().orderBy("severity", "code").show(SHOWN, False)
        return self.told(validate.inventory(self.inventory))

    def run(self, command: str) -> int:
        out = self.args.out
        if command == "run-all":
            return max(self.run(c) for c in STAGES)
        if command in CHECKED:
            what = CHECKED[command]
            return self.told(validate.inventory(self.inventory) if what == "inventory" else getattr(validate, what)(self.logic))
        if command == "inventory":
            return self.inventory_()
        if command == "parse":
            self.logic.programs.table("program").groupBy("status").count().show()
            return self.told(validate.programs(self.logic))
        if command == "data":
            return self.told(validate.data(self.logic))
        if command == "logic":
            if out:
                export.write_tables(self.logic, f"{out}/tables", self.args.format)
            return 0
        if command == "rules":
            self.logic.rules.where("business").orderBy("rule_id").select("rule_id", "category", "significance", "condition").show(SHOWN, False)
            return self.told(validate.rules(self.logic))
        if command == "diagrams":
            drawn = Diagrams(self.logic)
            if out:
                export.write_lines(drawn.all, f"{out}/diagrams", by="diagram")
            return self.told(validate.diagrams(drawn))
        if command == "synthesize":
            made = Synthesis(self.graph, self.args.system)
            if out:
                export.write_lines(made.document, f"{out}/document")
            made.register.where("rank <= 8").select("rank", "severity", "code", "subject", "count").show(8, False)
            return 0
        if command == "check-annotations":
            items = self.spark.read.schema("file string, item bigint, target string, kind string, text string, confidence string, evidence array<struct<id:string,path:string,line:int>>").json(self.args.annotations)
            return self.told(Synthesis(self.graph).annotations(items)[1])
        if out:
            export.write_graph_csv(self.graph, f"{out}/graph")
            export.write_cypher(self.graph, f"{out}/script")
        return self.told(validate.graph(self.graph))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("command", choices=[*STAGES, *CHECKED, "run-all", "check-annotations"])
    parser.add_argument("--root", required=True)
    parser.add_argument("--out")
    parser.add_argument("--entry", action="append", default=[])
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--program", action="append", default=[])
    parser.add_argument("--system", default="estate")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json"])
    parser.add_argument("--annotations")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        return Run(spark, args).run(args.command)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
