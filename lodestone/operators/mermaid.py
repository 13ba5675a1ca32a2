"""Diagrams as rows (diagram, ord, line): safe ids and labels, flowcharts from nodes and edges, and a structural lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.settled import settle

#: Characters of a label, and of an edge's.
LABEL, EDGE_LABEL = 60, 40
# fixed values: marks around a node's label by shape, first words of diagrams, lines that are neither node nor edge
SHAPES = {"box": ("[", "]"), "round": ("(", ")"), "stadium": ("([", "])"), "db": ("[(", ")]"), "diamond": ("{", "}"), "hex": ("{{", "}}"), "sub": ("[[", "]]"), "para": ("[/", "/]")}
KINDS = ("flowchart", "graph", "sequenceDiagram", "erDiagram", "classDiagram", "stateDiagram")
_OTHER = r"^(subgraph|end|classDef|class |style |linkStyle|direction)"
_EDGE = r"^([A-Za-z][A-Za-z0-9_]*)\s+(?:-->|-\.->|==>|---|-\.-)(?:\|[^|]*\|)?\s+([A-Za-z][A-Za-z0-9_]*)$"
_DECLARED = r"^([A-Za-z][A-Za-z0-9_]*)\s*(?:\[\[|\[\(|\[/|\(\[|\{\{|\[|\(|\{)"


def node_id(*parts: Column) -> Column:
    raw = F.regexp_replace(F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p != "", F.lit(False))), "_"), "[^A-Za-z0-9_]", "_")
    return F.when(raw.rlike("^[A-Za-z]"), raw).otherwise(F.concat(F.lit("n_"), raw))


def label(text: Column, limit: int = LABEL) -> Column:
    plain = F.trim(F.regexp_replace(text.cast("string"), r"\s+", " "))
    cut = F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit - 3), F.lit("..."))).otherwise(plain)
    for mark, entity in (('"', "#quot;"), ("<", "#lt;"), (">", "#gt;")):
        cut = F.replace(cut, F.lit(mark), F.lit(entity))
    return F.concat(F.lit('"'), cut, F.lit('"'))


def _shape(shape: Column, side: int) -> Column:
    return F.coalesce(*[F.when(shape == k, v[side]) for k, v in SHAPES.items()])


def flowchart(nodes: DataFrame, edges: DataFrame, titles: DataFrame, direction: str) -> DataFrame:
    """(diagram, ord, line) from nodes (diagram, id, text, shape, cls), edges (diagram, src, dst, text, style, ord) and titles (diagram, title).

    A node is declared once; lines follow ids, then the edges' order.
    """
    head = titles.select("diagram", F.posexplode(F.array(F.lit("---"), F.concat(F.lit("title: "), "title"), F.lit("---"), F.lit(f"flowchart {direction}"))).alias("k", "line")).select("diagram", F.lit(0).alias("part"), F.lpad("k", 9, "0").alias("key"), "line")
    own = nodes.groupBy("diagram", "id").agg(F.min(F.struct("text", "shape", "cls")).alias("n"))
    declared = own.select("diagram", F.lit(1), F.col("id"), F.concat(F.lit("  "), "id", _shape(F.col("n.shape"), 0), label(F.col("n.text")), _shape(F.col("n.shape"), 1)))
    middle = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("|"), label(F.col("text"), EDGE_LABEL), F.lit("|"))).otherwise("")
    drawn = edges.select("diagram", F.lit(2), F.concat(F.lpad(F.col("ord").cast("string"), 9, "0"), "src", "dst"), F.concat(F.lit("  "), "src", F.lit(" "), "style", middle, F.lit(" "), "dst"))
    marked = own.where("n.cls is not null").select("diagram", F.lit(3), "id", F.concat(F.lit("  class "), "id", F.lit(" "), "n.cls"))
    rows = head.union(declared).union(drawn).union(marked)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("diagram").orderBy("part", "key", "line"))).select("diagram", "ord", "line")


def lint(lines: DataFrame) -> DataFrame:
    """(diagram, problem): diagrams without a kind, with unbalanced quotes or blocks, unknown lines, undeclared ends."""
    text = F.trim("line")
    kept = lines.where((text != "") & ~text.startswith("%%")).withColumn("s", text)
    marks = kept.where("s = '---'").groupBy("diagram").agg(F.sort_array(F.collect_list("ord")).alias("m"))
    first = kept.groupBy("diagram").agg(F.min_by("s", "ord").alias("top"))
    framed = first.join(marks, "diagram", "left").withColumn("front", F.col("top") == "---")
    begin = F.when(F.col("front") & (F.size("m") >= 2), F.element_at("m", 2)).when(~F.col("front"), F.lit(-1))
    unclosed = framed.where("front and size(m) < 2").select("diagram", F.lit("front matter is not closed").alias("problem"))
    body = kept.join(framed.select("diagram", begin.alias("begin")), "diagram").where("ord > begin")
    opening = body.groupBy("diagram").agg(F.min_by("s", "ord").alias("opens"), F.min("ord").alias("at"))
    has_kind = F.col("opens").rlike(f"^({'|'.join(KINDS)})")
    every = framed.where("not front or size(m) >= 2").select("diagram").join(opening, "diagram", "left")
    nameless = every.where(~F.coalesce(has_kind, F.lit(False))).select("diagram", F.lit("the first line declares no diagram type"))
    good = settle(body.join(opening.where(has_kind).withColumn("kind", F.element_at(F.split("opens", r"\s+"), 1)), "diagram"), "lint")
    quotes = good.where(F.length(F.regexp_replace("s", '[^"]', "")) % 2 == 1).select("diagram", F.concat(F.lit("unbalanced quotes: "), F.substring("s", 1, 80)))
    flow = good.where("kind in ('flowchart', 'graph') and ord > at")
    other, is_edge = F.col("s").rlike(_OTHER), F.col("s").rlike(_EDGE)
    declared = flow.where(~is_edge | other).select("diagram", F.when(F.col("s").startswith("subgraph"), F.regexp_extract("s", r"^subgraph\s+([A-Za-z][A-Za-z0-9_]*)", 1)).when(~other, F.regexp_extract("s", _DECLARED, 1)).alias("node")).where("node <> ''").distinct()
    strange = flow.where(~other & ~is_edge & ~F.col("s").rlike(_DECLARED)).select("diagram", F.concat(F.lit("unrecognised line: "), F.substring("s", 1, 80)))
    ends = flow.where(is_edge & ~other).select("diagram", "s", F.explode(F.array(F.regexp_extract("s", _EDGE, 1), F.regexp_extract("s", _EDGE, 2))).alias("node"))
    loose = ends.join(declared, ["diagram", "node"], "left_anti").select("diagram", F.concat(F.lit("edge uses undeclared node "), "node"))
    seq = good.where("kind = 'sequenceDiagram'")
    people = seq.select("diagram", F.regexp_extract("s", r"^(?:participant|actor)\s+([A-Za-z][A-Za-z0-9_]*)", 1).alias("who")).where("who <> ''").distinct()
    message = r"^([A-Za-z][A-Za-z0-9_]*)\s*-[-x>)]+[+-]?\s*([A-Za-z][A-Za-z0-9_]*)\s*:"
    said = seq.where(F.col("s").rlike(message)).select("diagram", F.explode(F.array(F.regexp_extract("s", message, 1), F.regexp_extract("s", message, 2))).alias("who"))
    strangers = said.join(people, ["diagram", "who"], "left_anti").select("diagram", F.concat(F.lit("message uses undeclared participant "), "who"))
    balance = seq.groupBy("diagram").agg(F.count_if(F.col("s").rlike(r"^(alt|opt|loop|par|critical|rect)\b")).alias("opened"), F.count_if(F.col("s") == "end").alias("closed"))
    uneven = balance.where("opened <> closed").select("diagram", F.concat_ws(" ", "opened", F.lit("blocks opened but"), "closed", F.lit("closed")))
    out = unclosed
    for more in (nameless, quotes, strange, loose, strangers, uneven):
        out = out.union(more)
    return out.distinct()
