"""Programs of an estate: parsed with their copybooks, laid out, and their control flow.

The copybooks that a program needs, to any depth, are found by joins first; they travel
with the program's row to one Python worker, which expands, parses and lays it out. Its
rows - entries, records, fields, paragraphs, statements - are then tables like any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import checks, control_flow, edges, gaps
from lodestone.operators.closure import reaches_itself
from lodestone.plans.inventory import Inventory
from lodestone.sources.settled import settle

_STATEMENT = (
    "id int, paragraph int, parent int, slot string, slot_number int, position int, depth int, verb string, line int, file string, end_line int, text string, reads array<string>, writes array<string>, "
    "condition string, subjects array<string>, target string, thru string, inline boolean, loop string, count string, test string, targets array<string>, depending_on string, altered array<string>, "
    "program string, variable string, using array<string>, language string, command string, options map<string,string>, tables array<struct<`table`:string,operation:string>>, handlers array<string>, terminal boolean"
)
SCHEMAS = {
    "program": "status string, reason string, source_lines int, tokens int, using array<string>, returning string, procedure_line int",
    "expansion": "member string, kind string, status string, at_file string, at_line int, depth int, division string, replacing array<string>",
    "entry": "level int, name string, line int, file string, section string, fd string, text string",
    "file": "kind string, name string, line int, file string, clauses string, records array<string>",
    "record": "record string, name string, section string, fd string, size int, line int, file string, signature string, level int",
    "field": "record_ord int, name string, qualified_name string, level int, category string, picture string, usage string, size int, offset int, digits int, scale int, signed boolean, occurs int, redefines string, line int, file string, elementary boolean",
    "condition": "record_ord int, field string, field_name string, name string, line int, file string, `values` array<string>",
    "problem": "code string, line int, file string, message string",
    "section": "ord int, name string, line int, file string",
    "paragraph": "ord int, name string, section string, line int, file string, end_line int",
    "statement": _STATEMENT,
    "branch": "statement int, number int, line int, file string, conditions array<string>, other boolean, reads array<string>",
    "phrase": "statement int, number int, phrase string",
    "transfer": "paragraph int, statement int, type string, target string, thru string, line int, file string, loop string, conditional boolean, source string",
    "defined": "name string",
    "function": "name string, line int, file string",
    "pseudocode": "paragraph int, depth int, text string, file string, line int",
    "outline": "id int, parent int, kind string, target string, when array<string>, loop string, thru string, state string, line int, file string",
    "sql_pair": "statement int, `table` string, `column` string, host string, operation string, file string, line int",
    "sql_count": "statement int, `table` string, operation string, `columns` int, hosts int, structure string, file string, line int",
}


def parse(path: str, text: str, copybooks: list[dict]) -> list[tuple[str, dict]]:
    """(fact, row) of one program; a failure is a status, and costs no other program."""
    from lodestone.sources.readers.data_division import DataDivision, Records
    from lodestone.sources.readers.expand import Expander, member_tokens
    from lodestone.sources.readers.lexer import WORD
    from lodestone.sources.readers.procedure import Procedure
    from lodestone.sources.readers.renderings import Outline, Pseudocode, SqlShapes, Tree
    from lodestone.sources.readers.vocabulary import INTRINSICS, REGISTERS

    texts = {c["member"]: c for c in sorted(copybooks or [], key=lambda c: c["path"], reverse=True)}
    made: dict[str, tuple] = {}

    def member(name: str):
        if name in texts and name not in made:
            made[name] = (texts[name]["path"], member_tokens(texts[name]["text"], texts[name]["path"]))
        return made.get(name)

    out: list[tuple[str, dict]] = []
    add = lambda fact, **row: out.append((fact, row))
    try:
        expander = Expander(member)
        tokens = expander(member_tokens(text, path))
        at = {}
        for k in range(len(tokens) - 1):
            if tokens[k + 1].word("DIVISION") and tokens[k].kind == WORD:
                at.setdefault(tokens[k].value, k)
        procedure_at = at.get("PROCEDURE")
        data_end = len(tokens) if procedure_at is None else procedure_at
        data = DataDivision(tokens[at["DATA"] + 2 : data_end] if "DATA" in at else [])
        records = Records(data.entries)
        procedure = Procedure(tokens[procedure_at:]) if procedure_at is not None else None
        meanings: dict[str, tuple[str, list[str]]] = {}
        for item in records.records:
            for f in Records.fields(item):
                for c in f["conditions"]:
                    meanings.setdefault(c["name"], (f["name"] or f["qualified_name"].rpartition(".")[2], c["values"]))
        rendered = []
        if procedure:
            tree, shapes = Tree(procedure), SqlShapes(procedure)
            rendered = [("pseudocode", Pseudocode(tree, meanings).rows), ("outline", Outline(tree).rows), ("sql_pair", shapes.pairs), ("sql_count", shapes.counts)]
    except Exception as e:  # the program's defect, told in its row
        return [("program", {"status": "failed", "reason": f"{type(e).__name__}: {e}"})]
    add("program", status="parsed", source_lines=len(text.splitlines()), tokens=len(tokens), using=procedure.using if procedure else [], returning=procedure.returning if procedure else None, procedure_line=tokens[procedure_at].line if procedure else None)
    for x in expander.log:
        add("expansion", **x)
    names = set(REGISTERS)
    if "ENVIRONMENT" in at:
        names |= {t.value for t in tokens[at["ENVIRONMENT"] : at.get("DATA", data_end)] if t.kind == WORD}
    for e in data.entries:
        names |= {e["name"], *e["clauses"].get("occurs", {}).get("indexed_by", [])} - {None}
        add("entry", **{k: v for k, v in e.items() if k != "clauses"})
    names |= {f["name"] for f in data.files}
    for f in data.files:
        add("file", **f)
    for k, item in enumerate(records.records):
        rows = Records.fields(item)
        signature = "\n".join("|".join(str(f[c]) for c in ("level", "name", "picture", "usage", "occurs", "redefines")) for f in rows)
        add("record", record=str(k), name=item.name, section=item.entry["section"], fd=item.entry["fd"], size=item.size, line=item.entry["line"], file=item.entry["file"], signature=signature, level=item.level)
        for f in rows:
            for c in f.pop("conditions"):
                add("condition", record_ord=k, field=f["qualified_name"], field_name=f["name"] or f["qualified_name"].rpartition(".")[2], **c)
            add("field", record_ord=k, **f)
    for p in records.problems:
        add("problem", **p)
    bad_files = {m["file"] for m in data.misplaced}
    for file in sorted(bad_files):
        own = [m for m in data.misplaced if m["file"] == file]
        add("problem", code="procedure_code_in_data_division", line=own[0]["line"], file=file, message=", ".join(m["name"] for m in own))
    for p in data.problems:
        if p["file"] not in bad_files:
            add("problem", code=p["code"], line=p["line"], file=p["file"], message=p["text"])
    for name in sorted(names):
        add("defined", name=name)
    if procedure:
        for kind in ("sections", "paragraphs", "branches", "phrases"):
            for row in getattr(procedure, kind):
                add({"branches": "branch"}.get(kind, kind[:-1]), **row)
        for s in procedure.statements:
            add("statement", terminal=procedure.terminal(s), **s)
        for row in procedure.transfers():
            add("transfer", **row)
        for p in procedure.problems:
            add("problem", code=p["code"], line=p["line"], file=p["file"], message=p["text"])
        for kind, rows in rendered:
            for row in rows:
                add(kind, **row)
        for k in range(procedure_at + 1, len(tokens) - 1):
            if tokens[k].word("FUNCTION") and tokens[k + 1].kind == WORD and tokens[k + 1].value not in INTRINSICS:
                add("function", name=tokens[k + 1].value, line=tokens[k].line, file=tokens[k].file)
    return out


_FACTS = "program string, path string, fact string, ord int, data string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # one program at a time: an Arrow batch holds many, their facts might not fit
        for program, path, text, copybooks in zip(*(batch.column(c).to_pylist() for c in ("program", "path", "text", "copybooks"))):
            facts = parse(path, text, copybooks)
            columns = zip(*((program, path, fact, k, json.dumps(row)) for k, (fact, row) in enumerate(facts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=["program", "path", "fact", "ord", "data"])


class Programs:
    """Tables of the parsed programs of an inventory, all or those named."""

    def __init__(self, inventory: Inventory, names: list[str] | None = None) -> None:
        self.inventory = inventory
        wanted = inventory.programs.where("scanned").select(F.col("id").alias("program"), "name", "path")
        wanted = wanted.where(F.col("name").isin(names)) if names else wanted
        copies = inventory.references.where("type in ('COPY', 'SQL_INCLUDE') and resolution in ('resolved', 'ambiguous')").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()
        start = wanted.select(F.col("program").alias("src")).distinct().join(copies, "src").select(F.col("src").alias("seed"), F.col("dst").alias("node"))
        needed = edges._pairwise(start, copies)
        members = inventory.copybooks.join(inventory.files.select("path", "text"), "path").select(F.col("id").alias("node"), F.struct("member", "path", "text").alias("copybook"))
        shelf = needed.join(members, "node").groupBy(F.col("seed").alias("program")).agg(F.collect_list("copybook").alias("copybooks"))
        rows = wanted.join(inventory.files.select("path", "text"), "path").join(shelf, "program", "left").select("program", "path", "text", "copybooks")
        self.facts = settle(rows.mapInArrow(_parse, _FACTS), "parsed")

    def table(self, fact: str) -> DataFrame:
        own = self.facts.where(F.col("fact") == fact)
        return own.select(F.col("program").alias("of"), "path", F.col("ord").alias("row"), F.from_json("data", SCHEMAS[fact]).alias("d")).select("of", "path", "row", "d.*")

    @cached_property
    def statements(self) -> DataFrame:
        return settle(self.table("statement"), "statements")

    @cached_property
    def records(self) -> DataFrame:
        """(id, of, record, ...): the same name with the same layout is one record; others are numbered ~2, ~3 in program order."""
        copybooks = self.inventory.copybooks.select(F.col("path").alias("file"), F.col("member").alias("copybook"))
        names = self.inventory.programs.select(F.col("id").alias("of"), F.col("name").alias("program_name")).distinct()
        own = self.table("record").join(copybooks, "file", "left").join(names, "of")
        own = own.withColumn("base", F.concat_ws("/", F.coalesce("copybook", "program_name"), F.coalesce("name", F.lit("FILLER")))).withColumn("mark", F.sha2("signature", 256))
        first = own.groupBy("base", "mark").agg(F.min(F.struct("program_name", "path", "row")).alias("first"))
        variant = first.withColumn("variant", F.row_number().over(Window.partitionBy("base").orderBy("first"))).drop("first")
        shown = F.concat(F.lit("record:"), "base", F.when(F.col("variant") > 1, F.concat(F.lit("~"), "variant")).otherwise(""))
        return settle(own.join(variant, ["base", "mark"]).withColumn("id", shown), "records")

    @cached_property
    def fields(self) -> DataFrame:
        """(id, record, ...) of each record once."""
        ids = self.records.select("of", "path", F.col("record").cast("int").alias("record_ord"), F.col("id").alias("record"), "program_name")
        chosen = ids.groupBy("record").agg(F.min(F.struct("program_name", "path", "record_ord", "of")).alias("c")).select("record", "c.path", "c.record_ord", "c.of")
        return settle(self.table("field").join(chosen, ["of", "path", "record_ord"]).withColumn("id", F.concat(F.lit("field:"), F.regexp_replace("record", "^record:", ""), F.lit(":"), "qualified_name")), "fields")

    @cached_property
    def paragraphs(self) -> DataFrame:
        """(program, ord, name, section, line, file, end_line, terminal)."""
        ends = self.statements.where("parent is null").groupBy("of", F.col("paragraph").alias("ord")).agg(F.bool_or("terminal").alias("terminal"))
        own = self.table("paragraph").drop("path", "row").join(ends, ["of", "ord"], "left")
        return settle(own.withColumn("terminal", F.coalesce("terminal", F.lit(False))).withColumnRenamed("of", "program"), "paragraphs")

    @cached_property
    def resolved_transfers(self) -> DataFrame:
        """Transfers with the ordinals lo and hi of their targets, null where no paragraph or section has the name."""
        p = self.paragraphs
        plain = p.select("program", "name", "ord", F.lit(0).alias("rank"))
        qualified = p.where("section is not null").select("program", F.concat_ws(" OF ", "name", "section").alias("name"), "ord", F.lit(0).alias("rank"))
        places = plain.union(qualified).groupBy("program", "name").agg(F.min("ord").alias("lo"), F.min("ord").alias("hi"), F.lit(0).alias("rank"))
        sections = p.where("section is not null").groupBy("program", F.col("section").alias("name")).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.lit(1).alias("rank"))
        names = places.unionByName(sections).groupBy("program", "name").agg(F.min_by(F.struct("lo", "hi"), "rank").alias("at"))
        moves = self.table("transfer").drop("path").withColumnRenamed("of", "program")
        to = names.select("program", F.col("name").alias("target"), F.col("at").alias("_to"))
        until = names.select("program", F.col("name").alias("thru"), F.col("at").alias("_until"))
        wide = moves.join(to, ["program", "target"], "left").join(until, ["program", "thru"], "left")
        jump = F.col("type").isin("GO TO", "ALTER", "CICS HANDLE")
        hi = F.when(jump, F.col("_to.lo")).when(F.col("thru").isNotNull(), F.col("_until.hi")).otherwise(F.col("_to.hi"))
        both = F.col("_to").isNotNull() & (F.col("thru").isNull() | F.col("_until").isNotNull())
        return settle(wide.withColumns({"lo": F.when(both, F.col("_to.lo")), "hi": F.when(both, hi), "missing": F.when(F.col("_to").isNull(), F.col("target")).when(~both, F.col("thru"))}).drop("_to", "_until"), "resolved_transfers")

    @cached_property
    def flow_edges(self) -> DataFrame:
        """(program, ord, type, lo, hi) of transfers that lead somewhere; jumps keep their type, all that returns is a PERFORM."""
        known = self.resolved_transfers.where("lo is not null")
        returns = ~F.col("type").isin("GO TO", "ALTER", "CICS HANDLE")
        return known.select("program", F.col("paragraph").alias("ord"), F.when(returns, "PERFORM").otherwise(F.col("type")).alias("type"), "lo", "hi")

    @cached_property
    def reachable(self) -> DataFrame:
        return settle(control_flow.reachable(self.paragraphs.select("program", "ord", "terminal"), self.flow_edges), "reachable")

    @cached_property
    def recursive(self) -> DataFrame:
        """(program, ord) of paragraphs that perform themselves, directly or through others."""
        members = control_flow.range_members(self.flow_edges.where("type = 'PERFORM'"))
        return settle(reaches_itself(members.select("program", F.col("ord").alias("src"), F.col("member").alias("dst")), ["program"]).withColumnRenamed("node", "ord"), "recursive")

    @cached_property
    def complexity(self) -> DataFrame:
        """(program, paragraph, complexity) of all paragraphs."""
        whens = self.table("branch").where("not other").groupBy("of", F.col("statement").alias("id")).agg(F.count("*").alias("branches"))
        phrases = self.table("phrase").groupBy("of", F.col("statement").alias("id")).agg(F.count("*").alias("phrases"))
        st = self.statements.join(whens, ["of", "id"], "left").join(phrases, ["of", "id"], "left")
        st = st.select(F.col("of").alias("program"), "paragraph", "verb", F.coalesce("branches", F.lit(0)).alias("branches"), "loop", F.coalesce("phrases", F.lit(0)).alias("phrases"))
        told = control_flow.complexity(st)
        return settle(self.paragraphs.select("program", F.col("ord").alias("paragraph")).join(told, ["program", "paragraph"], "left").withColumn("complexity", F.coalesce("complexity", F.lit(1))), "complexity")

    @cached_property
    def undefined(self) -> DataFrame:
        """Names that statements use and neither data nor procedures define."""
        uses = self.statements.select(F.col("of").alias("program"), "line", F.explode(F.concat("reads", "writes")).alias("name"))
        defined = self.table("defined").select(F.col("of").alias("program"), "name").union(self.paragraphs.select("program", "name")).union(self.table("section").select("of", "name"))
        selects = self.inventory.table("select").select(F.col("owner").alias("program"), F.col("select").alias("name"))
        return checks.undefined_names(uses, defined.union(selects))

    @cached_property
    def sql_problems(self) -> DataFrame:
        """(code, of, file, line) of SQL against its tables: columns that are not there, variables that don't suit, lists of unlike length."""
        from lodestone.operators import layout_checks

        tables = self.inventory.table("table").select("name")
        columns = self.inventory.table("column").select(F.col("table").alias("name"), F.col("name").alias("column"), layout_checks.column_type(F.col("type")).alias("t"))
        exact = tables.select(F.col("name").alias("table"), F.col("name").alias("known"))
        short = tables.select(F.col("name").alias("short"), F.col("name").alias("also"))
        pairs = self.table("sql_pair").withColumn("short", F.substring_index("table", ".", -1)).join(exact, "table", "left").join(short, "short", "left")
        pairs = pairs.withColumn("name", F.coalesce("known", "also")).where("name is not null")
        told = pairs.join(columns, ["name", "column"], "left")
        unknown = told.where("t is null").select(F.lit("unknown_column").alias("code"), "of", "file", "line")
        f = self.table("field").groupBy("of", F.col("name").alias("host")).agg(F.min_by(F.struct("category", "size", "usage", "digits", F.col("scale").alias("field_scale"), "record_ord", "qualified_name"), "row").alias("f"))
        typed = told.where("t is not null").join(f, ["of", "host"]).select("of", "file", "line", "t.type", "t.length", "t.precision", "t.scale", "f.category", "f.size", "f.usage", "f.digits", "f.field_scale")
        unlike = typed.where(layout_checks.incompatibility().isNotNull()).select(F.lit("host_variable_type_mismatch"), "of", "file", "line")
        # one host structure stands for its elementary fields
        counts = self.table("sql_count").join(f.select("of", F.col("host").alias("structure"), "f"), ["of", "structure"], "left")
        below = self.table("field").where("elementary").select("of", F.col("record_ord").alias("r"), F.col("qualified_name").alias("q"))
        groups = counts.where("f.category = 'group'").select("of", "statement", F.col("f.record_ord").alias("r"), F.concat("f.qualified_name", F.lit(".")).alias("prefix"))
        inside = groups.join(below, ["of", "r"]).where(F.col("q").startswith(F.col("prefix"))).groupBy("of", "statement").agg(F.count("*").alias("members"))
        uneven = counts.join(inside, ["of", "statement"], "left").where(F.col("columns") != F.coalesce("members", "hosts")).select(F.lit("sql_column_count_mismatch"), "of", "file", "line")
        return settle(unknown.union(unlike).union(uneven).distinct(), "sql_problems")

    @cached_property
    def issues(self) -> DataFrame:
        """severity, code, subject, path, line and message of what parsing found."""
        info = ("empty_record", "unreachable_statement", "dead_paragraph")
        problems = self.table("problem").select("code", F.col("of").alias("subject"), F.col("file").alias("path"), "line").distinct()
        names = self.paragraphs.select("program", "ord", "name", "file", "line")
        copies = self.table("expansion").where("status in ('recursive', 'too_deep')").select(F.concat(F.lit("copy_"), "status").alias("code"), F.col("of").alias("subject"), F.col("at_file").alias("path"), F.col("at_line").alias("line"))
        moves = self.resolved_transfers
        undefined = moves.where("missing is not null").select(F.lit("undefined_procedure").alias("code"), F.col("program").alias("subject"), F.col("file").alias("path"), "line")
        backwards = moves.where("hi < lo").select(F.lit("perform_thru_backwards"), "program", "file", "line")
        altered = moves.where("type = 'ALTER'").select(F.lit("alter_statement"), "program", "file", "line").distinct()
        dead = self.reachable.where("not reachable").join(names, ["program", "ord"]).select(F.lit("dead_paragraph"), "program", "file", "line")
        loops = self.recursive.join(names, ["program", "ord"]).groupBy("program").agg(F.min(F.struct("ord", "file", "line")).alias("f")).select(F.lit("recursive_perform"), "program", "f.file", "f.line")
        twice = names.withColumn("k", F.row_number().over(Window.partitionBy("program", "name").orderBy("ord"))).where("k > 1").select(F.lit("duplicate_paragraph"), "program", "file", "line")
        top = self.statements.where("parent is null")
        after = top.withColumn("previous", F.max(F.col("terminal").cast("int")).over(Window.partitionBy("of", "paragraph").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)))
        unreachable = after.where("previous = 1").groupBy("of", "paragraph").agg(F.min_by(F.struct("file", "line"), "position").alias("f")).select(F.lit("unreachable_statement"), "of", "f.file", "f.line")
        unknown = self.undefined.select(F.lit("undefined_data_name"), "program", F.lit(None).cast("string"), "first_line")
        functions = self.table("function").select(F.lit("unknown_intrinsic_function"), "of", "file", "line")
        failed = self.table("program").where("status = 'failed'").select(F.lit("parse_failed"), "of", "path", F.lit(1))
        sql = self.sql_problems.select("code", "of", "file", "line")
        out = problems
        for more in (sql, copies, undefined, backwards, altered, dead, loops, twice, unreachable, unknown, functions, failed):
            out = out.union(more)
        severity = F.when(F.col("code") == "parse_failed", "error").when(F.col("code").isin(*info), "info").otherwise("warning")
        return settle(out.select(severity.alias("severity"), "code", "subject", "path", "line", gaps.message(F.col("code"), F.coalesce("subject", "path")).alias("message")), "issues")
