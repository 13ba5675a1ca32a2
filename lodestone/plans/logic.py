"""What programs decide and compute: branches, rules, loops, input and output, data flows.

All of it is joins over the parsed tables. A branch's actions are the statements of its
block, one phrase each; a loop's verdict compares the fields that its condition tests
with what its body writes, to the fix-point of what that performs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import control_flow, layout_checks, lineage, rules
from lodestone.operators.numbering import occurrence_suffix
from lodestone.plans.programs import Programs
from lodestone.sources.readers.vocabulary import RESERVED
from lodestone.sources.settled import settle

#: Actions that an outcome shows.
ACTIONS = 10
# fixed values: verbs on files, accesses by operation and command
FILE_VERBS = "OPEN CLOSE READ WRITE REWRITE DELETE START RETURN RELEASE".split()
SQL_ACCESS = {"SELECT": "read", "INSERT": "write", "UPDATE": "update", "DELETE": "delete"}
CICS_READS = ("READ", "STARTBR", "READNEXT", "READPREV")
CICS_WRITES = ("WRITE", "REWRITE", "DELETE")


def words(text: Column) -> Column:
    """Words of a condition that can be names; words within literals count too."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][A-Z0-9-]*"), F.lit(0))
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(w) for w in sorted(RESERVED)])))


def action(s: DataFrame) -> Column:
    """A statement in a phrase, or null for those that do nothing."""
    verb, loop = F.col("verb"), F.col("loop")
    detail = F.coalesce("condition", "count", F.lit(""))
    looped = F.when(loop != "none", F.concat(F.lit(" ("), F.rtrim(F.concat_ws(" ", loop, detail)), F.lit(")"))).otherwise("")
    tables = F.array_join(F.array_sort(F.array_distinct(F.transform("tables", lambda t: t["table"]))), ",")
    program = F.element_at("options", "PROGRAM")
    return (
        F.when((verb == "PERFORM") & F.col("target").isNotNull(), F.concat(F.lit("perform "), "target", F.coalesce(F.concat(F.lit(" thru "), "thru"), F.lit("")), looped))
        .when(verb == "PERFORM", F.trim(F.concat_ws(" ", F.lit("loop"), "loop", "condition")))
        .when(verb == "IF", F.concat(F.lit("if "), "condition", F.lit(" ...")))
        .when(verb == "EVALUATE", F.concat(F.lit("evaluate "), F.array_join("subjects", " / "), F.lit(" ...")))
        .when(verb == "CALL", F.concat(F.lit("call "), F.coalesce("program", "variable", F.lit(""))))
        .when((verb == "EXEC") & (F.col("language") == "CICS"), F.concat_ws(" ", F.lit("CICS"), "command", program))
        .when((verb == "EXEC") & (F.col("language") == "SQL"), F.rtrim(F.concat_ws(" ", F.lit("SQL"), "command", tables)))
        .when(verb.isin("GOBACK", "STOP RUN", "EXIT PROGRAM"), F.lower(verb))
        .when(verb == "GO TO", F.concat(F.lit("go to "), F.array_join("targets", "/")))
        .when(verb == "CONTINUE", "continue (no action)")
        .when(verb.isin("EXIT", "NEXT SENTENCE"), None)
        .otherwise(F.substring("text", 1, 70))
    )


class Logic:
    def __init__(self, programs: Programs) -> None:
        self.programs, self.inventory = programs, programs.inventory

    @cached_property
    def actions(self) -> DataFrame:
        """(of, parent, slot, slot_number, actions) of every block that a statement holds."""
        told = self.programs.statements.where("parent is not null").withColumn("action", action(self.programs.statements)).where("action is not null")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "action"))), lambda x: x["action"])
        out = told.groupBy("of", "parent", "slot", "slot_number").agg(ordered.alias("all"))
        shown = F.when(F.size("all") >= ACTIONS, F.concat(F.slice("all", 1, ACTIONS), F.array(F.lit("...")))).otherwise(F.col("all"))
        return settle(out.withColumn("actions", shown).drop("all"), "actions")

    @cached_property
    def conditions(self) -> DataFrame:
        """(of, name, field_name): 88-level names of each program, the first of a name."""
        c = self.programs.table("condition").select("of", "name", "field_name", "row")
        return settle(c.groupBy("of", "name").agg(F.min_by("field_name", "row").alias("field_name")), "conditions")

    @cached_property
    def branches(self) -> DataFrame:
        """of, ord, kind, condition, paragraph, file, line, actions, fields, explained; ids by order within the program."""
        st = self.programs.statements.select("of", "id", F.col("paragraph").alias("at"), "verb", "text", "condition", "subjects", F.col("file").alias("s_file"), F.col("line").alias("s_line"))
        none = F.array().cast("array<string>")

        def outcome(slot: str) -> DataFrame:
            return self.actions.where(F.col("slot") == slot).select("of", F.col("parent").alias("id"), F.col("slot_number").alias("number"), F.col("actions").alias(f"{slot}_actions"))

        then, other = outcome("then").drop("number"), outcome("else").drop("number")
        ifs = st.where("verb = 'IF'").join(then, ["of", "id"], "left").join(other, ["of", "id"], "left")
        common = ("of", "id", "at")
        ifs = ifs.select(*common, F.lit(0).alias("number"), F.lit(0).alias("rank"), F.lit("IF").alias("kind"), "condition", F.col("s_file").alias("file"), F.col("s_line").alias("line"), F.concat(F.coalesce("then_actions", none), F.coalesce("else_actions", none)).alias("actions"))
        b = self.programs.table("branch").drop("path", "row").withColumnRenamed("statement", "id").join(st.drop("condition"), ["of", "id"]).join(outcome("branch"), ["of", "id", "number"], "left")
        label = F.when(F.col("other") & (F.size("conditions") == 0), "OTHER").otherwise(F.array_join("conditions", " OR "))
        subject = F.array_join("subjects", " / ")
        when = F.when((F.col("verb") == "SEARCH") | (subject == "TRUE"), label).otherwise(F.concat(subject, F.lit(" = "), label))
        whens = b.select(*common, "number", F.lit(0), F.when(F.col("verb") == "SEARCH", "SEARCH WHEN").otherwise("WHEN"), when, "file", "line", F.coalesce("branch_actions", none))
        ph = self.programs.table("phrase").drop("path", "row").withColumnRenamed("statement", "id").join(st, ["of", "id"]).join(outcome("phrase"), ["of", "id", "number"], "left")
        phrases = ph.select(*common, "number", F.lit(1), F.lit("PHRASE"), F.concat("phrase", F.lit(" ("), F.substring("text", 1, 50), F.lit(")")), "s_file", "s_line", F.coalesce("phrase_actions", none))
        rows = ifs.union(whens).union(phrases).withColumn("ord", F.row_number().over(Window.partitionBy("of").orderBy("id", "rank", "number")))
        told = rows.select("of", "ord", F.explode(words(F.col("condition"))).alias("name")).join(self.conditions, ["of", "name"], "left")
        fields = told.groupBy("of", "ord").agg(
            F.array_sort(F.collect_set(F.coalesce("field_name", "name"))).alias("fields"),
            F.array_sort(F.array_compact(F.collect_set(F.when(F.col("field_name").isNotNull(), F.struct(F.col("name").alias("condition"), F.col("field_name").alias("field")))))).alias("explained"),
        )
        paragraphs = self.programs.paragraphs.select(F.col("program").alias("of"), F.col("ord").alias("at"), F.col("name").alias("paragraph"))
        names = self.inventory.programs.select(F.col("id").alias("of"), F.col("name").alias("program")).distinct()
        empty = F.array().cast("array<struct<condition:string,field:string>>")
        out = rows.join(fields, ["of", "ord"], "left").join(paragraphs, ["of", "at"]).join(names, "of")
        out = out.withColumn("fields", F.coalesce("fields", none)).withColumn("explained", F.coalesce("explained", empty))
        return settle(out.select("of", "program", F.concat_ws("", F.lit("branch:"), "program", F.lit(":B"), "ord").alias("id"), "ord", "kind", "condition", "at", "paragraph", "file", "line", "actions", "fields", "explained"), "branches")

    @cached_property
    def rules(self) -> DataFrame:
        """Rule candidates of branches and calculations: rule_id, of, paragraph, file, line, kind, category, significance, business, signals, condition, reachable."""
        reach = self.programs.reachable.select(F.col("program").alias("of"), F.col("ord").alias("at"), "reachable")
        b = rules.classify(self.branches).select("of", "program", "at", "paragraph", "file", "line", "kind", "category", "significance", "business", "signals", "condition", F.lit(0).alias("rank"), "ord", "actions")
        phrases = self.programs.table("phrase").groupBy("of", F.col("statement").alias("id")).agg(F.count("*").alias("phrases"))
        st = self.programs.statements.join(phrases, ["of", "id"], "left").withColumn("phrases", F.coalesce("phrases", F.lit(0)))
        paragraphs = self.programs.paragraphs.select(F.col("program").alias("of"), F.col("ord").alias("at"), F.col("name").alias("named"))
        names = self.inventory.programs.select(F.col("id").alias("of"), F.col("name").alias("program_name")).distinct()
        c = rules.calculations(st.withColumnRenamed("paragraph", "at")).join(paragraphs, ["of", "at"]).join(names, "of")
        signals = F.array_compact(F.array(F.lit("arithmetic on fields that are no counters"), F.when(F.col("rounded"), "rounded"), F.when(F.col("size_error"), "size error")))
        c = c.select("of", F.col("program_name").alias("program"), "at", F.col("named").alias("paragraph"), "file", "line", F.lit("CALCULATION").alias("kind"), F.lit("calculation").alias("category"), "significance", F.lit(True).alias("business"), signals.alias("signals"), F.col("text").alias("condition"), F.lit(1).alias("rank"), F.col("id").alias("ord"), F.array("text").alias("actions"))
        both = b.union(c).join(reach, ["of", "at"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(True)))
        return settle(occurrence_suffix(both, ["of", "line"], ["rank", "ord"], F.concat_ws(":", F.lit("rule"), "program", "line"), "rule_id").drop("rank", "ord"), "rules")

    @cached_property
    def related(self) -> DataFrame:
        """(of, name, also): a field with its groups and what lies below it, itself included."""
        f = self.programs.table("field").select("of", "record_ord", F.split("qualified_name", "\\.").alias("parts"))
        steps = f.select("of", F.element_at("parts", -1).alias("name"), F.explode("parts").alias("also")).where("name <> 'FILLER' and also <> 'FILLER'")
        return steps.union(steps.select("of", F.col("also").alias("name"), F.col("name").alias("also"))).distinct()

    @cached_property
    def writes(self) -> DataFrame:
        """(of, id, paragraph, name): what each statement changes: the names it writes, the fields behind 88-levels, their groups and subfields."""
        direct = self.programs.statements.select("of", "id", "paragraph", F.explode("writes").alias("name"))
        fields = direct.join(self.conditions, ["of", "name"], "left").select("of", "id", "paragraph", F.explode(F.array_compact(F.array("name", "field_name"))).alias("name"))
        more = fields.join(self.related, ["of", "name"]).select("of", "id", "paragraph", F.col("also").alias("name"))
        return settle(fields.union(more).distinct(), "writes")

    @cached_property
    def loops(self) -> DataFrame:
        """of, id, paragraph, line, type, inline, condition, fields, termination of every loop."""
        st = self.programs.statements.where("verb = 'PERFORM' and loop <> 'none'")
        tested = st.select("of", "id", F.explode(words(F.col("condition"))).alias("name")).join(self.conditions, ["of", "name"], "left")
        tested = tested.select("of", "id", F.explode(F.array_distinct(F.array_compact(F.array("name", "field_name")))).alias("field")).distinct()
        members = control_flow.range_members(self.programs.flow_edges.where("type = 'PERFORM'"))
        own = self.writes.select(F.col("of").alias("program"), F.col("paragraph").alias("ord"), "name").distinct()
        closed = settle(control_flow.writes_closure(members, own), "closed").select(F.col("program").alias("of"), F.col("ord").alias("member"), F.col("name").alias("field"))
        moves = self.programs.resolved_transfers.where("lo is not null and type = 'PERFORM'").select(F.col("program").alias("of"), F.col("statement").alias("at"), F.explode(F.sequence("lo", F.greatest("hi", "lo"))).alias("member"))
        away = moves.join(closed, ["of", "member"]).select("of", "at", "field").distinct()
        # an inline body is the rows after the loop that are deeper than it, up to the next that is not
        flat = self.programs.statements.select("of", F.col("id").alias("below"), F.col("depth").alias("d"), "paragraph")
        inline = st.where("inline").select("of", "id", "depth", "paragraph")
        ends = inline.join(flat, ["of", "paragraph"]).where("below > id and d <= depth").groupBy("of", "id").agg(F.min("below").alias("end"))
        body = inline.join(ends, ["of", "id"], "left").join(flat, ["of", "paragraph"]).where("below > id and (end is null or below < end)").select("of", "id", F.col("below").alias("at"))
        inside = body.join(self.writes.select("of", F.col("id").alias("at"), F.col("name").alias("field")), ["of", "at"]).union(body.join(away, ["of", "at"]).select("of", "at", "id", "field"))
        changed = away.select("of", F.col("at").alias("id"), "field").union(inside.select("of", "id", "field")).distinct()
        updated = tested.join(changed, ["of", "id", "field"], "left_semi").select("of", "id").distinct().withColumn("updated", F.lit(True))
        fields = tested.groupBy("of", "id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
        verdict = F.when(F.col("type").isin("times", "varying"), "counted").when(F.coalesce("condition", F.lit("")) == "", "unknown").when(F.col("updated").isNotNull(), "condition_updated_in_loop").otherwise("potential_infinite")
        out = st.select("of", "id", "paragraph", "file", "line", F.col("loop").alias("type"), "inline", "condition", "target").join(updated, ["of", "id"], "left").join(fields, ["of", "id"], "left")
        return settle(out.withColumn("termination", verdict).drop("updated"), "loops")

    @cached_property
    def io(self) -> DataFrame:
        """(of, family, paragraph, line, what): file, SQL, online and call statements."""
        family = F.when(F.col("verb").isin(FILE_VERBS), "file").when(F.col("verb") == "CALL", "call").when((F.col("verb") == "EXEC") & F.col("language").isin("SQL", "CICS"), F.lower("language"))
        what = F.when(F.col("verb") == "CALL", F.coalesce("program", "variable")).when(F.col("verb") == "EXEC", F.col("command")).otherwise(F.col("verb"))
        return self.programs.statements.select("of", family.alias("family"), "paragraph", "file", "line", what.alias("what"), "text").where("family is not null")

    @cached_property
    def paragraph_flow(self) -> DataFrame:
        """(of, paragraph, reads, writes), sorted."""
        st = self.programs.statements
        return st.groupBy("of", "paragraph").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reads")))).alias("reads"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("writes")))).alias("writes"))

    @cached_property
    def flows(self) -> DataFrame:
        """(program, entity, direction, via, file, line): files through their DDs, tables through SQL, online files."""
        modes = lineage.open_modes(self.programs.statements.where("verb = 'OPEN'").select(F.struct("of", "id").alias("k"), "text"), "k").select(F.col("k.of").alias("program"), F.col("file").alias("select"), "access").where(~F.col("select").isin("WITH", "NO", "REWIND", "LOCK", "REVERSED")).distinct()
        bound = self.inventory.links.select("program", "select", "ddname", "dsn", "job", "step", "path", "line")
        direction = F.coalesce("access", F.lit("unknown"))
        selects = self.inventory.table("select").select(F.col("owner").alias("program"), "select", "ddname", "path", "line")
        data = bound.where("dsn is not null").drop("path", "line").join(modes, ["program", "select"], "left").join(selects.select("program", "select", "path", "line"), ["program", "select"])
        data = data.select("program", F.concat(F.lit("dataset:"), "dsn").alias("entity"), direction.alias("direction"), F.concat_ws(" ", "select", F.lit("/ DD"), "ddname", "job", "step").alias("via"), F.col("path").alias("file"), "line")
        loose = selects.where("ddname is not null").join(bound.select("program", "select"), ["program", "select"], "left_anti").join(modes, ["program", "select"], "left")
        loose = loose.select("program", F.concat(F.lit("file:"), "ddname"), direction, F.concat_ws(" ", "select", F.lit("/ DD"), "ddname"), "path", "line")
        st = self.programs.statements
        sql = st.where("language = 'SQL'").select("of", "id", "file", "line", F.explode("tables").alias("t")).where("t.operation not in ('DECLARE', 'DECLARE_TEMPORARY')")
        access = F.coalesce(*[F.when(F.col("t.operation") == k, v) for k, v in SQL_ACCESS.items()], F.lower("t.operation"))
        sql = sql.select("of", "id", F.concat(F.lit("table:"), "t.table").alias("entity"), access.alias("direction"), "file", "line").groupBy("of", "entity", "direction").agg(F.min_by(F.struct("file", "line"), "id").alias("p"))
        sql = sql.select("of", "entity", "direction", F.lit("EXEC SQL"), "p.file", "p.line")
        name = F.regexp_replace(F.coalesce(F.element_at("options", "FILE"), F.element_at("options", "DATASET"), F.lit("")), "^['\"]|['\"]$", "")
        online = st.where((F.col("language") == "CICS") & F.col("command").isin(*CICS_READS, *CICS_WRITES)).withColumn("name", name).where("name <> ''")
        online = online.select("of", F.concat(F.lit("cics_file:"), "name"), F.when(F.col("command").isin(*CICS_READS), "read").otherwise("write"), F.lit("EXEC CICS"), "file", "line")
        return settle(data.union(loose).union(sql).union(online), "flows")

    @cached_property
    def length_mismatches(self) -> DataFrame:
        """Files whose largest record does not fit the DD's record length."""
        sizes = self.programs.table("record").where("fd is not null and size is not null").groupBy(F.col("of").alias("program"), F.col("fd").alias("select")).agg(F.max("size").alias("size"))
        bound = self.inventory.links.where("lrecl is not null").join(sizes, ["program", "select"]).where("size > 0")
        return settle(bound.where(layout_checks.lrecl_mismatch(F.col("size"), F.col("lrecl"), F.upper(F.coalesce("recfm", F.lit(""))))).select("program", "select", "ddname", "job", "step", "size", "lrecl", "recfm"), "length_mismatches")
