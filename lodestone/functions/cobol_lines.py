"""Physical lines of COBOL members as Column expressions: numbering, format votes, comments, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.members import LINE_BREAK

#: Lines in which a directive may state the format.
DIRECTIVE_LINES = 200


def explode_lines(members: DataFrame, text_col: str = "text", id_col: str = "path") -> DataFrame:
    """(id_col, line, raw): the lines of each text from 1; a break at the end starts no line."""
    text = F.col(text_col)
    parts = F.split(text, LINE_BREAK, -1)
    parts = F.when((text == "") | text.rlike(f"({LINE_BREAK})\\z"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return members.select(id_col, F.posexplode(parts).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def is_blank_line(raw: Column) -> Column:
    return ~raw.rlike(r"(?U)[^\s\x1c-\x1f]")


def votes(raw: Column) -> Column:
    """'fixed', 'free' or null: what a line says about the reference format of its member.

    Six blanks in front are fixed. So is a blank or numeric sequence area before an indicator;
    a leading asterisk elsewhere, or a word that runs into column 7, is free.
    """
    first = F.length(raw) - F.length(F.ltrim(raw))
    area = F.substring(raw, 1, 6)
    indicator = F.substring(raw, 7, 1).isin(" ", "*", "-", "/", "d", "D") & (F.length(raw) > 6)
    fixed = (first >= 6) | (indicator & (F.trim(area).rlike("^[0-9]+$") | (F.trim(area) == "")))
    runs_on = (F.length(raw) > 6) & ~F.substring(raw, first + 1, F.greatest(7 - first, F.lit(0))).contains(" ")
    free = (F.substring(raw, first + 1, 1) == "*") | runs_on
    return F.when(is_blank_line(raw), None).when(fixed, "fixed").when(free, "free")


def format_votes(lines: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col, fixed_votes, free_votes, format: a directive in the first lines wins, else free needs a clear lead."""
    upper = F.upper("raw")
    directive = F.when((F.col("line") <= DIRECTIVE_LINES) & (upper.contains(">>SOURCE") | upper.contains("SOURCE FORMAT")), F.when(upper.contains("FREE"), "free").when(upper.contains("FIX"), "fixed"))
    told = lines.withColumn("_vote", votes(F.col("raw"))).withColumn("_directive", directive)
    counted = told.groupBy(id_col).agg(
        F.count_if(F.col("_vote") == "fixed").alias("fixed_votes"),
        F.count_if(F.col("_vote") == "free").alias("free_votes"),
        F.min(F.when(F.col("_directive").isNotNull(), F.struct("line", "_directive"))).getField("_directive").alias("_stated"),
    )
    lead = F.greatest(F.lit(2), F.floor(F.col("fixed_votes") / 4))
    return counted.select(id_col, "fixed_votes", "free_votes", F.coalesce("_stated", F.when(F.col("free_votes") > lead, "free").otherwise("fixed")).alias("format"))
