"""The inventory of an estate: members in, tables out.

One pass of Python workers reads every member into fact rows (path, fact, ord, data as
JSON); everything after that is joins and aggregates. Tables are read lazily from the
settled facts, each with its own schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import edges, gaps, lineage, resolve
from lodestone.operators.numbering import number_rows
from lodestone.sources import members
from lodestone.sources.settled import settle

#: The columns of each fact.
SCHEMAS = {
    "member": "id string, kind string, name string, program_id string, member string, format string, `using` array<string>, has_sql boolean, has_cics boolean, has_dli boolean, "
    "terminators array<string>, nested array<string>, ends_cleanly boolean, content_kind string, line int, scanned boolean",
    "select": "owner string, select string, assign string, ddname string, organization string, line int",
    "ref": "type string, from_id string, target string, line int, division string, mapset string, operation string, temporary boolean, variable string, candidate_targets array<string>, "
    "step string, step_order int, ddname string, details string",
    "note": "code string, line int, subject string, details string",
    "job": "id string, kind string, name string, line int, instream boolean",
    "step": "owner string, owner_name string, step_order int, name string, line int, program string, proc string, run_program string, utility boolean",
    "dd": "owner string, step_order int, dd_order int, name string, line int, dsn string, disp string, sysout string, dummy boolean, recfm string, lrecl int, instream_lines int",
    "csd": "type string, name string, line int, attributes map<string,string>",
    "mapset": "id string, name string, line int",
    "map": "id string, mapset string, name string, line int, size string, field_count int",
    "field": "map string, name string, line int, pos string, length int, attrb string",
    "table": "id string, name string, line int, primary_key array<string>, comment string",
    "column": "table string, position int, name string, type string, nullable boolean, comment string",
    "foreign_key": "table string, columns array<string>, references string, referenced_columns array<string>, line int",
    "view": "id string, name string, line int, base_tables array<string>",
    "index": "name string, table string, columns array<string>, unique boolean, line int",
    "object": "kind string, name string, line int",
    "vsam": "id string, kind string, name string, line int, organization string, key_length int, key_offset int, record_size_avg int, record_size_max int, related_to string, source string",
}


class _Facts:
    """The facts of one member, in the order in which they are found."""

    def __init__(self, path: str) -> None:
        self.path, self.rows = path, []
        self.stem = path.rpartition("/")[2].rpartition(".")[0].upper() or path.rpartition("/")[2].upper()

    def add(self, fact: str, **data: object) -> None:
        self.rows.append((fact, json.dumps(data)))

    def notes(self, notes: list, subject: str | None) -> None:
        for n in notes:
            self.add("note", code=n.code, line=n.line, subject=subject, details=json.dumps(n.details))

    def cobol(self, lines: list[str], kind: str) -> None:
        from lodestone.sources.readers.cobol import Scan

        scan = Scan(lines)
        pid = scan.program_ids[0][0] if scan.program_ids and kind == "program" else None
        name = pid or self.stem
        node = f"{kind}:{name}"
        self.add(
            "member", id=node, kind=kind, name=name, program_id=pid, member=self.stem, format=scan.format, using=scan.using, has_sql="SQL" in scan.languages, has_cics="CICS" in scan.languages,
            has_dli=bool(scan.languages & {"DLI", "SQLIMS"}), terminators=sorted(scan.terminators), nested=[p for p, _ in scan.program_ids[1:]], ends_cleanly=scan.ends_cleanly,
            content_kind=scan.content, line=scan.program_ids[0][1] if pid else None, scanned=True,
        )
        for s in scan.selects:
            self.add("select", owner=node, **s)
        for r in scan.references:
            d = r.pop("details")
            given = {k: d.get(k) for k in ("mapset", "operation", "variable", "candidate_targets")}
            self.add("ref", from_id=node, **r, **given, details=json.dumps(d))
        self.notes(scan.notes, node)

    program = lambda self, lines: self.cobol(lines, "program")
    copybook = lambda self, lines: self.cobol(lines, "copybook")

    def jcl(self, lines: list[str]) -> None:
        from lodestone.sources.readers.control import Jcl, idcams

        read = Jcl(lines)
        owners = [("job", j, j["name"]) for j in read.jobs] + [("proc", p, p["name"] or self.stem) for p in read.procs]
        for kind, owner, name in owners:
            node = f"{kind}:{name}"
            self.add("job", id=node, kind=kind, name=name, line=owner["line"], instream=owner.get("instream", False))
            for step in owner["steps"]:
                at = {"step": step["name"], "step_order": step["order"]}
                self.add("step", owner=node, owner_name=name, step_order=step["order"], utility=step["program"] in resolve.UTILITIES, **{k: step[k] for k in ("name", "line", "program", "proc", "run_program")})
                for type_, key in (("JCL_EXEC", "program"), ("JCL_PROC", "proc"), ("JCL_RUN", "run_program")):
                    if step[key]:
                        self.add("ref", type=type_, from_id=node, target=step[key], line=step["line"], **at)
                current = None
                for k, dd in enumerate(step["dds"], 1):
                    current = dd["name"] or current
                    data = dd.pop("data")
                    self.add("dd", owner=node, step_order=step["order"], dd_order=k, instream_lines=None if data is None else len(data), **dd)
                    if dd["dsn"]:
                        self.add("ref", type="JCL_DD", from_id=node, target=dd["dsn"], line=dd["line"], ddname=current, temporary=dd["dsn"].startswith("&&"), **at)
                    if data and step["program"] == "IDCAMS" and current == "SYSIN":
                        for d in idcams(data, dd["line"] + 1):
                            self.vsam(d, f"{node} step {step['name']}")
                            self.add("ref", type="IDCAMS_DEFINE", from_id=node, target=d["name"], line=d["line"], **at)
        first = next((f"job:{j['name']}" for j in read.jobs), f"proc:{self.stem}")
        for name, line in read.includes:
            self.add("ref", type="JCL_INCLUDE", from_id=first, target=name, line=line)
        self.notes(read.notes, first if read.jobs else None)

    def vsam(self, d: dict, source: str) -> None:
        self.add("vsam", id=f"dataset:{d['name']}", source=source, **{k: v for k, v in d.items() if k != "attributes"})

    def csd(self, lines: list[str]) -> None:
        from lodestone.sources.readers.control import csd

        for r in csd(lines):
            self.add("csd", **r)
            given = r["attributes"]
            if r["type"] == "TRANSACTION" and given.get("PROGRAM"):
                self.add("ref", type="CSD_TRANSACTION", from_id=f"transaction:{r['name']}", target=given["PROGRAM"].upper(), line=r["line"])
            elif r["type"] == "FILE" and given.get("DSNAME"):
                self.add("ref", type="CSD_FILE", from_id=f"cics_file:{r['name']}", target=given["DSNAME"].upper(), line=r["line"])

    def bms(self, lines: list[str]) -> None:
        from lodestone.sources.readers.control import bms

        mapsets, notes = bms(lines)
        for ms in mapsets:
            name = ms["name"] or self.stem
            self.add("mapset", id=f"mapset:{name}", name=name, line=ms["line"])
            for m in ms["maps"]:
                node = f"map:{name}.{m['name']}"
                self.add("map", id=node, mapset=name, name=m["name"], line=m["line"], size=m["size"], field_count=len(m["fields"]))
                for f in m["fields"]:
                    if f["name"]:
                        self.add("field", map=node, **f)
        self.notes(notes, f"mapset:{mapsets[0]['name']}" if mapsets else None)

    def ddl(self, lines: list[str]) -> None:
        from lodestone.sources.readers.control import Ddl

        read = Ddl(lines)
        for t in read.tables:
            self.add("table", id=f"table:{t['name']}", **{k: t[k] for k in ("name", "line", "primary_key", "comment")})
            for k, c in enumerate(t["columns"], 1):
                self.add("column", table=t["name"], position=k, **c)
            for fk in t["foreign_keys"]:
                self.add("foreign_key", table=t["name"], line=t["line"], **fk)
                self.add("ref", type="DB2_FOREIGN_KEY", from_id=f"table:{t['name']}", target=fk["references"], line=t["line"])
        for v in read.views:
            self.add("view", id=f"view:{v['name']}", **v)
            for base in v["base_tables"]:
                self.add("ref", type="DB2_VIEW_BASE", from_id=f"view:{v['name']}", target=base, line=v["line"])
        for kind, rows in (("index", read.indexes), ("object", read.objects)):
            for r in rows:
                self.add(kind, **r)
        self.notes(read.notes, None)

    def idcams(self, lines: list[str]) -> None:
        from lodestone.sources.readers.control import idcams

        for d in idcams(lines):
            self.vsam(d, self.path)


READ = ("program", "copybook", "jcl", "csd", "bms", "ddl", "idcams")


def read_member(path: str, kind: str, text: str, blank: bool) -> list[tuple[str, str]]:
    """(fact, JSON) rows of a member. A reader that fails is a note, not the end of the pass."""
    facts = _Facts(path)
    if blank:
        if kind == "program":
            facts.add("member", id=f"program:{facts.stem}", kind=kind, name=facts.stem, member=facts.stem, has_sql=False, has_cics=False, has_dli=False, using=[], ends_cleanly=True, scanned=False)
        return facts.rows
    try:
        getattr(facts, kind)(text.splitlines())
    except Exception as e:  # one member's defect must not cost the others
        facts.add("note", code="reader_failed", line=1, subject=None, details=json.dumps({"error": f"{type(e).__name__}: {e}"}))
    return facts.rows


_FACTS = "path string, fact string, ord int, data string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for path, kind, text, blank in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "text", "blank"))):
            for k, (fact, data) in enumerate(read_member(path, kind, text, blank)):
                for column, value in zip(out, (path, fact, k, data)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["path", "fact", "ord", "data"])


class Inventory:
    """Tables of an estate, from members (path, content)."""

    def __init__(self, content: DataFrame) -> None:
        self.files = settle(members.catalogue(content), "files")
        read = self.files.where(F.col("kind").isin(*READ)).select("path", "kind", "text", "blank")
        self.facts = settle(read.mapInArrow(_read, _FACTS), "facts")

    def table(self, fact: str) -> DataFrame:
        """(path, ord, ...) of one kind of fact."""
        own = self.facts.where(F.col("fact") == fact)
        return own.select("path", "ord", F.from_json("data", SCHEMAS[fact]).alias("d")).select("path", "ord", "d.*")

    @cached_property
    def programs(self) -> DataFrame:
        return self.table("member").where("kind = 'program'").withColumn("has_using", F.size("using") > 0).drop("kind")

    @cached_property
    def copybooks(self) -> DataFrame:
        return self.table("member").where("kind = 'copybook'").select("path", "id", "name", "member", "format", "content_kind", "has_sql", "has_cics")

    @cached_property
    def csd(self) -> DataFrame:
        return self.table("csd")

    @cached_property
    def tables(self) -> DataFrame:
        return self.table("table").select("id", "name", "path").union(self.table("view").select("id", "name", "path"))

    @cached_property
    def known(self) -> DataFrame:
        procs = self.table("job").where("kind = 'proc'").select("id", "name", "path")
        return resolve.names(self.programs, self.copybooks, procs, self.csd, self.table("map").select("mapset", "name", "path"), self.tables, self.table("object").where("kind = 'PROCEDURE'").select("name", "path"))

    @cached_property
    def links(self) -> DataFrame:
        """Program files with the DDs and datasets of every step that runs the program."""
        runs = self.table("step").select(F.col("owner").alias("job"), F.col("step_order").alias("step"), F.coalesce("run_program", "program").alias("name"), F.col("name").alias("step_name"))
        found = resolve.program_names(self.programs).select("name", F.col("id").alias("program"))
        steps = runs.join(found, "name").select("job", "step", "step_name", "program")
        dds = self.table("dd").select(F.col("owner").alias("job"), F.col("step_order").alias("step"), F.col("dd_order").alias("ord"), F.col("name").alias("ddname"), "dsn", "disp", "line", "path", "recfm", "lrecl")
        selects = self.table("select").select(F.col("owner").alias("program"), "select", "ddname")
        return settle(lineage.link_datasets(steps, dds, selects), "links")

    @cached_property
    def missing_dds(self) -> DataFrame:
        runs = self.table("step").select("path", F.col("owner").alias("job"), F.col("step_order").alias("step"), F.coalesce("run_program", "program").alias("name"), "line")
        found = resolve.program_names(self.programs).select("name", F.col("id").alias("program"))
        steps = runs.join(found, "name")
        dds = self.table("dd").select(F.col("owner").alias("job"), F.col("step_order").alias("step"), F.col("dd_order").alias("ord"), F.col("name").alias("ddname"))
        selects = self.table("select").select(F.col("owner").alias("program"), "select", "ddname")
        return lineage.missing_dds(steps, dds, selects).join(steps.select("job", "step", "program", "path", "line"), ["job", "step", "program"])

    @cached_property
    def references(self) -> DataFrame:
        """All references, resolved and numbered R00001, ... by path, line, type and target."""
        raw = self.table("ref").withColumn("target", F.when(F.col("type") == "JCL_DD", lineage.dsn_parts(F.col("target"))["base"]).otherwise(F.col("target")))
        base = lineage.dsn_parts(F.col("dsn"))["base"]
        nothing = {c: F.lit(None).cast(t) for c, t in raw.dtypes}
        linked = self.links.where("dsn is not null").select(
            *[x.alias(c) for c, x in (nothing | {"path": F.col("path"), "ord": F.lit(1 << 30), "type": F.lit("PROGRAM_DATASET"), "from_id": F.col("program"), "target": base, "line": F.col("line"), "ddname": F.col("ddname")}).items()]
        )
        has = [not self.facts.where(F.col("fact").isin(*kinds)).isEmpty() for kinds in (("csd",), ("table", "view"))]
        resolved = resolve.resolve(raw.unionByName(linked), self.known, *has)
        numbered = number_rows(resolved, ["path", "line", "type", F.coalesce("target", F.lit("")), "ord"], "_n")
        return settle(numbered.withColumn("ref_id", F.format_string("R%05d", "_n")).drop("_n"), "references")

    @cached_property
    def edges(self) -> DataFrame:
        return settle(edges.aggregate_edges(self.references), "edges")

    @cached_property
    def nodes(self) -> DataFrame:
        parts = [
            self.programs.select("id", F.lit("program").alias("kind"), "name", "path"), self.copybooks.select("id", F.lit("copybook"), "name", "path"), self.table("job").select("id", "kind", "name", "path"),
            self.csd.where("type = 'TRANSACTION'").select(F.concat(F.lit("transaction:"), "name"), F.lit("transaction"), "name", "path"), self.csd.where("type = 'FILE'").select(F.concat(F.lit("cics_file:"), "name"), F.lit("cics_file"), "name", "path"),
            self.table("mapset").select("id", F.lit("mapset"), "name", "path"), self.table("map").select("id", F.lit("map"), F.concat_ws(".", "mapset", "name"), "path"),
            self.table("table").select("id", F.lit("table"), "name", "path"), self.table("view").select("id", F.lit("view"), "name", "path"), self.table("vsam").select("id", F.lit("dataset"), "name", "path"),
        ]
        defined = parts[0]
        for p in parts[1:]:
            defined = defined.union(p)
        return settle(edges.nodes(defined, self.references), "nodes")

    @cached_property
    def classified(self) -> DataFrame:
        return settle(edges.classify_programs(self.programs, self.references, self.csd.where("type = 'PROGRAM'")), "classified")

    @cached_property
    def issues(self) -> DataFrame:
        """severity, code, subject, path, line and message of everything found."""
        columns = ("severity", "code", "subject", "path", "line")

        def rows(df: DataFrame, severity, code, subject, path="path", line="line", count=None) -> DataFrame:
            lit = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
            values = (lit(severity), lit(code), subject if subject is None else F.col(subject) if isinstance(subject, str) else subject, F.col(path) if path else None, F.col(line) if line else None)
            told = [(F.lit(None) if v is None else v).cast("int" if c == "line" else "string").alias(c) for c, v in zip(columns, values)]
            return df.select(*told, gaps.message(told[1], F.coalesce(told[2], told[3]), count).alias("message"))

        refs, progs, csd = self.references, self.classified, self.csd.where("type = 'PROGRAM'")
        has_jobs = not self.facts.where("fact = 'job'").isEmpty()
        has_csd = not self.facts.where("fact = 'csd'").isEmpty()
        notes = self.table("note")
        subjects = notes.groupBy("path", "code").agg(F.min("subject").alias("subject"))
        found = [
            rows(members.empty_file_issues(self.files), "warning", "empty_file", None, line=None),
            rows(gaps.notes_to_issues(notes).join(subjects, ["path", "code"]), F.col("severity"), F.col("code"), "subject", count=F.col("count")),
            rows(refs.where("issue is not null"), F.col("issue.severity"), F.col("issue.code"), "from_id"),
            rows(self.programs.where("scanned and program_id is null"), "warning", "program_without_program_id", "id", line=None),
            rows(self.programs.where("program_id <> member"), "info", "program_id_differs_from_member", "id"),
            rows(self.programs.where("format = 'free'"), "info", "free_format_source", "id", line=None),
            rows(self.programs.where("not ends_cleanly"), "warning", "possibly_truncated_source", "id", line=None),
            rows(self.missing_dds, "warning", "missing_dd_for_file", "program"),
            rows(edges.duplicate_programs(self.programs), "error", "duplicate_program_id", F.concat(F.lit("program:"), "program_id"), path=None, line=None),
            rows(edges.name_collisions(self.programs, self.copybooks), "info", "name_collision", F.concat(F.lit("copybook:"), "name"), path=None, line=None),
            rows(edges.unused_copybooks(self.copybooks, refs), "info", "unused_copybook", "id", line=None),
            rows(self.misplaced_copybooks, "warning", "procedure_copybook_in_data_division", "id", line=None),
            rows(edges.without_attach(self.programs, refs), "warning", "db2_program_without_attach", "subject"),
            rows(edges.conflicting_clusters(self.table("vsam")), "warning", "conflicting_vsam_definitions", F.concat(F.lit("dataset:"), "name"), path=None, line=None),
            rows(csd.join(resolve.program_names(self.programs), "name", "left_anti"), "warning", "csd_program_without_source", F.concat(F.lit("csd_program:"), "name")),
        ]
        unreached = edges.unreached_issues(progs, csd, has_jobs)
        unreached = unreached if has_csd else unreached.where("code <> 'online_program_not_in_csd'")
        found.append(rows(unreached, F.col("severity"), F.col("code"), "subject", line=None))
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return settle(out, "issues")

    @cached_property
    def misplaced_copybooks(self) -> DataFrame:
        """Copybooks with procedure code that are copied into a data division."""
        used = self.references.where("type in ('COPY', 'SQL_INCLUDE') and resolution in ('resolved', 'ambiguous') and division = 'DATA'").select(F.col("to_id").alias("id")).distinct()
        return self.copybooks.where("content_kind in ('procedure', 'mixed')").join(used, "id", "left_semi")

    def scope(self, entries: list[str]) -> DataFrame:
        """(node, depth) that the entry points reach."""
        starts = edges.resolve_entries(self.nodes, entries)
        spark = self.files.sparkSession
        return edges.scope(self.edges, spark.createDataFrame([(s,) for s in starts], "node string"))
