"""Constraint queries: undefined names, the annotation gate, statistics against rows, dangling references.

Each returns what is wrong; a table that is right gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what annotations may be, and names that the system defines
ANNOTATION_KINDS = ("description", "name", "summary", "narrative", "caption", "note", "verdict")
CONFIDENCES = ("high", "medium", "low")
SYSTEM_NAMES = ("EIB", "DFH", "SQL")


def undefined_names(uses: DataFrame, defined: DataFrame) -> DataFrame:
    """(program, name, uses, first_line) of names that a program uses and nothing defines."""
    own = uses.where(~F.col("name").rlike(f"^({'|'.join(SYSTEM_NAMES)})"))
    return own.join(defined.select("program", "name").distinct(), ["program", "name"], "left_anti").groupBy("program", "name").agg(F.count("*").alias("uses"), F.min("line").alias("first_line"))


def annotation_problems(items: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """(item, problem) for annotations: target, kind, text, confidence and every piece of evidence must hold.

    items: item, target, kind, text, confidence, evidence ARRAY<STRUCT<id, path, line>>;
    ids: id of all that exists; files: path, lines.
    """
    known = ids.select(F.col("id").alias("_id")).distinct()
    plain = items.join(known, F.col("target") == F.col("_id"), "left")
    wrong = F.array_compact(
        F.array(
            F.when(F.col("_id").isNull(), "unknown target"),
            F.when(~F.coalesce(F.col("kind").isin(*ANNOTATION_KINDS), F.lit(False)), "unknown kind"),
            F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text"),
            F.when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "unknown confidence"),
            F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no evidence"),
        )
    )
    own = plain.select("item", F.explode(wrong).alias("problem"))
    cited = items.select("item", F.explode("evidence").alias("e")).select("item", "e.id", "e.path", "e.line")
    by_id = cited.where("id is not null").join(known, F.col("id") == F.col("_id"), "left_anti").select("item", F.lit("unknown evidence id").alias("problem"))
    by_line = cited.where("id is null and path is not null and line is not null").join(files.select(F.col("path").alias("_path"), "lines"), F.col("path") == F.col("_path"), "left")
    by_line = by_line.select("item", F.when(F.col("_path").isNull(), "evidence file does not exist").when(~F.col("line").between(1, F.col("lines")), "evidence line does not exist").alias("problem")).where("problem is not null")
    shapeless = cited.where("id is null and (path is null or line is null)").select("item", F.lit("evidence has neither id nor line").alias("problem"))
    return own.union(by_id).union(by_line).union(shapeless)


def accepted(items: DataFrame, problems: DataFrame, file_col: str = "file") -> DataFrame:
    """Items of files without any problem: one problem rejects a file as a whole."""
    bad = items.join(problems.select("item").distinct(), "item", "left_semi").select(file_col).distinct()
    return items.join(bad, file_col, "left_anti")


def count_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value): the number of rows, and of rows by each value of each column, in one pass."""
    sets = df.select(F.explode(F.array(F.lit("rows"), *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])).alias("metric"))
    return sets.groupBy("metric").agg(F.count("*").alias("value"))


def stat_mismatches(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(metric, stored, fresh) wherever stored statistics are not what the rows give."""
    both = stored.select("metric", F.col("value").alias("stored")).join(fresh.select("metric", F.col("value").alias("fresh")), "metric", "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("fresh")))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, type, side) for each end of an edge that is no node."""
    known = nodes.select("id").distinct()
    return (
        edges.join(known, F.col("from_id") == F.col("id"), "left_anti").select("from_id", "to_id", "type", F.lit("from").alias("side"))
        .union(edges.join(known, F.col("to_id") == F.col("id"), "left_anti").select("from_id", "to_id", "type", F.lit("to").alias("side")))
    )


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose column is no key of parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")
