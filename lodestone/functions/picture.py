"""PICTURE strings and storage sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand(pic: Column) -> Column:
    """Upper case with every X(n) written out."""
    parts = F.regexp_extract_all(F.upper(pic), F.lit(r".\([0-9]+\)|."), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.length(p) > 1, F.repeat(F.substring(p, 1, 1), F.regexp_extract(p, r"\(([0-9]+)\)", 1).cast("int"))).otherwise(p)), "")


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def body(pic: Column) -> Column:
    """The expanded picture without its sign, CR and DB as two @ each."""
    text = expand(pic)
    unsigned = F.when(text.startswith("S"), F.substring(text, 2, 1 << 20)).otherwise(text)
    return F.replace(F.replace(unsigned, F.lit("CR"), F.lit("@@")), F.lit("DB"), F.lit("@@"))


def analyse(pic: Column) -> Column:
    """STRUCT<category, positions, digits, scale, signed> of a picture."""
    b = body(pic)
    digits = _count(b, "9")
    right = F.regexp_extract(b, "V(.*)$", 1)
    leading, trailing = F.length(b) - F.length(F.ltrim(F.translate(b, "P", " "))), F.length(b) - F.length(F.rtrim(F.translate(b, "P", " ")))
    scale = F.when(b.contains("V"), _count(right, "9P")).when(b.endswith("P"), -trailing).when(b.startswith("P"), digits + leading).otherwise(0)

    def only(chars: str) -> Column:
        return b.rlike(f"^[{chars}]+$")

    category = (
        F.when(b == "", "unknown")
        .when(only("9VP"), "numeric")
        .when(only("A"), "alphabetic")
        .when(only("N"), "national")
        .when(only("GB"), "dbcs")
        .when(only("XA9") & b.contains("X"), "alphanumeric")
        .when(only("A9"), "alphanumeric")
        .when(only("XA9B0/") & b.rlike("[XA]"), "alphanumeric-edited")
        .when(only(r"9VPZ*+\-$,.B0/@E"), "numeric-edited")
        .otherwise("unknown")
    )
    return F.struct(
        category.alias("category"),
        F.length(F.regexp_replace(b, "[VP]", "")).alias("positions"),
        digits.alias("digits"),
        scale.cast("int").alias("scale"),
        F.upper(pic).startswith("S").alias("signed"),
    )


# fixed values: bytes of usages that a picture does not change
FIXED_BYTES = {"COMP-1": 4, "COMP-2": 8, "INDEX": 4, "POINTER": 4, "PROCEDURE-POINTER": 8, "FUNCTION-POINTER": 4}


def storage_bytes(picture: Column, usage: Column, separate_sign: Column) -> Column:
    """Bytes of an elementary item, given analyse(); null where neither picture nor usage tells."""
    fixed = None
    for name, size in FIXED_BYTES.items():
        fixed = F.when(usage == name, size) if fixed is None else fixed.when(usage == name, size)
    digits = picture["digits"]
    return fixed.when(picture.isNull() | (picture["category"] == "unknown"), None).when(usage.isin("COMP", "COMP-5"), F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8)).when(
        usage == "COMP-3", F.floor(digits / 2).cast("int") + 1
    ).otherwise(
        F.when(picture["category"].isin("national", "dbcs") | usage.isin("NATIONAL", "DISPLAY-1"), picture["positions"] * 2).otherwise(picture["positions"] + (separate_sign & picture["signed"]).cast("int"))
    )
