"""Checks of records against what stores them: record lengths, keys, column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the names of column types, and the bytes that binary and date columns want
_TYPE = r"^(CHARACTER|CHAR|VARCHAR|DECIMAL|DEC|NUMERIC|INTEGER|INT|SMALLINT|BIGINT|DATE|TIMESTAMP|TIME)\b\s*(?:\(\s*([0-9]+)\s*(?:,\s*([0-9]+)\s*)?\))?"
_ALIAS = {"CHARACTER": "CHAR", "DEC": "DECIMAL", "NUMERIC": "DECIMAL", "INT": "INTEGER"}
_BINARY = {"SMALLINT": 2, "INTEGER": 4, "BIGINT": 8}
_DATED = {"DATE": 10, "TIME": 8, "TIMESTAMP": 26}


def column_type(text: Column) -> Column:
    """STRUCT<type, length, precision, scale> of a column type's text; a type of another name keeps its text."""
    upper = F.upper(text)
    name, one, two = (F.regexp_extract(upper, _TYPE, k) for k in (1, 2, 3))
    kind = name
    for alias, full in _ALIAS.items():
        kind = F.when(name == alias, full).otherwise(kind)
    kind = F.when(name == "", upper).otherwise(kind)
    texts, number = kind.isin("CHAR", "VARCHAR"), F.when(one != "", one.cast("int"))
    known = name != ""
    return F.struct(
        kind.alias("type"),
        F.when(known & texts, number).alias("length"),
        F.when(known & ~texts, F.coalesce(number, F.when(kind == "DECIMAL", 5))).alias("precision"),
        F.when(two != "", two.cast("int")).when(kind == "DECIMAL", 0).alias("scale"),
    )


def incompatibility() -> Column:
    """Why a host variable (category, size, usage, digits, field_scale) does not suit a column (type, length, precision, scale), or null."""
    cat, size, usage, kind = (F.col(c) for c in ("category", "size", "usage", "type"))
    length, precision, scale = (F.col(c) for c in ("length", "precision", "scale"))
    binary = F.when(kind == "SMALLINT", _BINARY["SMALLINT"]).when(kind == "INTEGER", _BINARY["INTEGER"]).when(kind == "BIGINT", _BINARY["BIGINT"])
    dated = F.when(kind == "DATE", _DATED["DATE"]).when(kind == "TIME", _DATED["TIME"]).when(kind == "TIMESTAMP", _DATED["TIMESTAMP"])
    decimals = F.coalesce("field_scale", F.lit(0))
    return (
        F.when(size.isNull(), None)
        .when((kind == "CHAR") & ~cat.isin("alphanumeric", "alphabetic", "group", "alphanumeric-edited"), "category")
        .when((kind == "CHAR") & ~size.eqNullSafe(length), "length")
        .when((kind == "VARCHAR") & (cat != "group") & (size > F.coalesce(length, size)), "length")
        .when((kind == "DECIMAL") & (cat != "numeric"), "category")
        .when((kind == "DECIMAL") & (~F.col("digits").eqNullSafe(precision) | ~decimals.eqNullSafe(scale)), "digits")
        .when((kind == "DECIMAL") & (usage != "COMP-3"), "usage")
        .when(binary.isNotNull() & ((cat != "numeric") | ~usage.isin("COMP", "COMP-5") | (size != binary)), "binary")
        .when(dated.isNotNull() & (size < dated), "length")
    )


def lrecl_mismatch(size: Column, lrecl: Column, recfm: Column) -> Column:
    """Variable records leave four bytes of the record length to the descriptor; fixed ones fill it."""
    return F.when(recfm.startswith("V"), size > lrecl - 4).otherwise(size != lrecl)


def cluster_size_mismatch(size: Column, average: Column, most: Column) -> Column:
    return (size > most) | ((average == most) & (size != most))


def key_mismatches(clusters: DataFrame, fields: DataFrame) -> DataFrame:
    """Clusters (name, key_offset, key_length) none of whose record's fields (name, offset, size) is the key."""
    hit = fields.select("name", F.col("offset").alias("key_offset"), F.col("size").alias("key_length")).distinct()
    return clusters.where("key_length is not null").join(hit, ["name", "key_offset", "key_length"], "left_anti").select("name", "key_offset", "key_length")


def synthetic_pairs(estate) -> DataFrame:
    """Parts as pairs of a column and a host variable."""
    k, n = F.col("p_partkey"), F.col("p_size")

    def pick(values: str, by: Column) -> Column:
        v = values.split()
        return F.element_at(F.array(*map(F.lit, v)), (by % len(v) + 1).cast("int"))

    return estate.table("part").select(
        "p_partkey",
        pick("CHAR VARCHAR DECIMAL INTEGER SMALLINT BIGINT DATE TIMESTAMP BLOB", k).alias("type"),
        (k % 9).cast("int").alias("length"), (k % 9).cast("int").alias("precision"), (k % 3).cast("int").alias("scale"),
        pick("numeric alphanumeric group numeric-edited", n).alias("category"),
        F.when(k % 23 != 0, n % 9).cast("int").alias("size"), pick("COMP COMP-3 DISPLAY", n).alias("usage"),
        (n % 9).cast("int").alias("digits"), F.when(n % 2 == 0, n % 3).cast("int").alias("field_scale"),
    )
