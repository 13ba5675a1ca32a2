"""Paragraph-level control flow: performed ranges, fall-through, reachability, complexity, writes and loops.

Tables: paragraphs (program, ord, terminal); transfers (program, ord, type, lo, hi) with
ordinals of the target range, type PERFORM, or another (GO TO, ALTER, handlers) that jumps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.closure import closure


def range_members(performs: DataFrame) -> DataFrame:
    """(program, ord, member, backwards): each performed paragraph of a range; a backward range is its first one."""
    hi = F.greatest("hi", "lo")
    return performs.select("program", "ord", F.explode(F.sequence("lo", hi)).alias("member"), (F.col("hi") < F.col("lo")).alias("backwards"))


def fall_through(paragraphs: DataFrame) -> DataFrame:
    """(program, ord, next): paragraphs that run on into the one after them."""
    w = Window.partitionBy("program").orderBy("ord")
    return paragraphs.withColumn("next", F.lead("ord").over(w)).where(~F.col("terminal") & F.col("next").isNotNull()).select("program", "ord", "next")


def segments(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with seg_end: where flow that enters a paragraph ends, the first terminal one from there on."""
    w = Window.partitionBy("program").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    return paragraphs.withColumn("seg_end", F.coalesce(F.min(F.when(F.col("terminal"), F.col("ord"))).over(w), F.max("ord").over(w)))


def reachable(paragraphs: DataFrame, transfers: DataFrame) -> DataFrame:
    """(program, ord, reachable), from each program's first paragraph.

    Flow runs from where it enters to the end of the segment; a performed range returns
    at its end. So one closure over paragraphs is enough when a jump leads to all of its
    segment and a perform to its range, and it takes as many rounds as there are nested
    transfers, not as there are paragraphs.
    """
    seg = segments(paragraphs).select("program", F.col("ord").alias("lo"), "seg_end")
    jumps = transfers.where("type <> 'PERFORM'").select("program", "ord", "lo").join(seg, ["program", "lo"])
    jumps = jumps.select("program", F.col("ord").alias("src"), F.explode(F.sequence("lo", F.col("seg_end"))).alias("dst"))
    performs = range_members(transfers.where("type = 'PERFORM'")).select("program", F.col("ord").alias("src"), F.col("member").alias("dst"))
    first = seg.groupBy("program").agg(F.min(F.struct("lo", "seg_end")).alias("f"))
    start = first.select("program", F.explode(F.sequence(F.col("f.lo"), F.col("f.seg_end"))).alias("node"))
    known = paragraphs.select("program", F.col("ord").alias("dst"))
    steps = jumps.union(performs).join(known, ["program", "dst"], "left_semi").select("program", "src", "dst")
    reached = closure(steps, start, ["program"]).select("program", F.col("node").alias("ord"), F.lit(True).alias("_hit"))
    return paragraphs.join(reached, ["program", "ord"], "left").select("program", "ord", F.coalesce("_hit", F.lit(False)).alias("reachable"))


def complexity(statements: DataFrame) -> DataFrame:
    """(program, paragraph, complexity): one, and one for each decision.

    statements: program, paragraph, verb, branches (WHENs other than OTHER), loop, phrases.
    """
    decisions = (
        F.when(F.col("verb") == "IF", 1)
        .when(F.col("verb").isin("EVALUATE", "SEARCH"), F.col("branches"))
        .when((F.col("verb") == "PERFORM") & F.col("loop").isin("until", "varying"), 1)
        .otherwise(0)
    )
    return statements.groupBy("program", "paragraph").agg((F.sum(decisions + F.col("phrases")) + 1).cast("bigint").alias("complexity"))


def metrics(statements: DataFrame) -> DataFrame:
    """(program, statements, max_nesting, verbs): verbs as verb=count, sorted."""
    by_verb = statements.groupBy("program", "verb").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    verbs = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "verb", "n"))), ",")
    return by_verb.groupBy("program").agg(F.sum("n").alias("statements"), F.max("depth").alias("max_nesting"), verbs.alias("verbs"))


def writes_closure(members: DataFrame, writes: DataFrame) -> DataFrame:
    """(program, ord, name): names that a paragraph writes, itself or through what it performs, to the fix-point."""
    steps = members.select("program", F.col("ord").alias("src"), F.col("member").alias("dst"))
    # what a paragraph reaches matters only where something is written
    starts = writes.select("program", "ord").union(steps.select("program", F.col("src").alias("ord"))).distinct()
    reach = closure(steps, starts.select("program", F.col("ord").alias("start"), F.col("ord").alias("node")), ["program"], carried=["start"])
    return reach.join(writes.select("program", F.col("ord").alias("node"), "name").distinct(), ["program", "node"]).select("program", F.col("start").alias("ord"), "name").distinct()


def loop_termination(loops: DataFrame, members: DataFrame, writes: DataFrame) -> DataFrame:
    """(program, ord, termination) of loops (program, ord, field, type, no_condition): counted, unknown, updated or potentially infinite.

    A loop's body is what the paragraph's range performs, to the fix-point.
    """
    closed = writes_closure(members, writes)
    body = members.select("program", "ord", F.col("member").alias("_m")).join(closed.select("program", F.col("ord").alias("_m"), F.col("name").alias("field")), ["program", "_m"])
    updated = body.select("program", "ord", "field").distinct().withColumn("_updated", F.lit(True))
    verdict = (
        F.when(F.col("type").isin("times", "varying"), "counted")
        .when(F.col("no_condition"), "unknown")
        .when(F.col("_updated").isNotNull(), "condition_updated_in_loop")
        .otherwise("potential_infinite")
    )
    return loops.join(updated, ["program", "ord", "field"], "left").select("program", "ord", verdict.alias("termination"))


def synthetic(estate) -> tuple[DataFrame, DataFrame]:
    """Orders as programs and line items as paragraphs: (paragraphs, transfers)."""
    li = estate.items().select("l_orderkey", "pos", "l_partkey", "l_suppkey", "l_returnflag")
    sizes = li.groupBy("l_orderkey").agg(F.max("pos").alias("n"))
    wide = li.join(sizes, "l_orderkey")
    lo, hi = ((F.col(c) % F.col("n") + 1).cast("int") for c in ("l_suppkey", "l_partkey"))
    paragraphs = wide.select(F.col("l_orderkey").alias("program"), F.col("pos").alias("ord"), (F.col("l_returnflag") == "R").alias("terminal"))
    kind = F.when(F.col("l_partkey") % 3 == 0, "GO TO").otherwise("PERFORM")
    transfers = wide.where("l_returnflag <> 'A' or pos = 1").select(F.col("l_orderkey").alias("program"), F.col("pos").alias("ord"), kind.alias("type"), lo.alias("lo"), F.when(kind == "GO TO", lo).otherwise(hi).alias("hi"))
    return paragraphs, transfers


def synthetic_statements(estate) -> DataFrame:
    """Line items as statements of the paragraph of their supplier."""
    verbs = F.array(*map(F.lit, ("IF", "EVALUATE", "PERFORM", "MOVE", "SEARCH", "READ")))
    k = F.col("l_partkey")
    return estate.table("lineitem").select(
        F.col("l_orderkey").alias("program"),
        (F.col("l_suppkey") % 3).alias("paragraph"),
        F.element_at(verbs, (k % 6 + 1).cast("int")).alias("verb"),
        (k % 4).alias("branches"),
        F.element_at(F.array(*map(F.lit, ("until", "times", "varying", "none"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("loop"),
        (k % 2).alias("phrases"),
        F.col("l_linenumber").alias("depth"),
    )
