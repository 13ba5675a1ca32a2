"""Source members: scanning a directory, decoding, classification, and the file catalogue.

A member is a row (path STRING, content BINARY). Everything here is Column expressions
but the two legacy code pages, which only members that are not UTF-8 go through.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: folders that no scan enters, kinds by extension, extensions whose content decides
EXCLUDED_DIRS = (".git", ".svn", ".hg", "bin", "obj", "node_modules", ".venv", "venv", "__pycache__", ".idea", ".vscode")
KINDS_BY_EXTENSION = {
    "program": "cbl cob cobol ccp sqb pco",
    "copybook": "cpy copy cbk cpb dclgen dcl",
    "jcl": "jcl job prc proc",
    "csd": "csd",
    "bms": "bms",
    "ddl": "sql ddl db2",
    "idcams": "idcams ams",
    "control": "ctl",
    "listing": "lst",
    "doc": "md pdf doc docx rst",
}
SNIFFED = ("txt", "", "dat", "src", "mbr", "ctl")
#: Characters that decide a kind by content.
SNIFF_CHARS = 20_000

#: What ends a line: everything that is a line boundary in Unicode, a CR LF pair once.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression; as in shell matching on whole paths, * also crosses /."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        k += 1
        end = glob.find("]", k + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[k:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            k = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    """Files of no length, which the reader of whole files leaves out; like its own index, the listing is the driver's."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def scan(spark: SparkSession, root: str, exclude_dirs: Sequence[str] = EXCLUDED_DIRS, exclude_globs: Sequence[str] = ()) -> DataFrame:
    """(path, content) of every file under root, with paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    empty = _empty_files(spark, root)
    if empty:
        raw = raw.union(spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary"))
    # the scheme is written file:/ or file:/// by turns
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    whole = F.regexp_replace("path", "^[a-z]+:/*", "/")
    found = raw.select(F.substring(whole, len(base) + 1, 1 << 20).alias("path"), "content")
    if exclude_dirs:
        found = found.where(~F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*map(F.lit, exclude_dirs))))
    for glob in exclude_globs:
        found = found.where(~F.col("path").rlike(glob_to_regex(glob)))
    return found


def _legacy(content: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in content:
        try:
            rows.append((raw.decode("cp1252"), "cp1252"))
        except UnicodeDecodeError:
            rows.append((raw.decode("latin-1"), "latin-1"))
    return pd.DataFrame(rows, columns=["text", "encoding"])


def decode(members: DataFrame) -> DataFrame:
    """members with text and encoding: UTF-8, else Windows-1252, else Latin-1; a byte order mark goes.

    Rows that are UTF-8 never leave the JVM.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    utf8 = members.where(valid).withColumn("text", F.decode("content", "UTF-8")).withColumn("encoding", F.lit("utf-8"))
    legacy = F.pandas_udf(_legacy, "text string, encoding string")
    rest = members.where(~valid).withColumn("_d", legacy("content"))
    rest = rest.select(*members.columns, F.col("_d.text").alias("text"), F.col("_d.encoding").alias("encoding"))
    return utf8.unionByName(rest).withColumn("text", F.regexp_replace("text", "^﻿", ""))


def line_count(text: Column) -> Column:
    breaks = F.regexp_count(text, F.lit(LINE_BREAK))
    return (breaks + F.when((text == "") | text.rlike(f"({LINE_BREAK})\\z"), 0).otherwise(1)).cast("int")


def line_ending(text: Column) -> Column:
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf, cr = F.regexp_count(text, F.lit("\n")) - crlf, F.regexp_count(text, F.lit("\r")) - crlf
    some = [(crlf > 0).cast("int"), (lf > 0).cast("int"), (cr > 0).cast("int")]
    total = some[0] + some[1] + some[2]
    return F.when(total == 0, "none").when(total > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").otherwise("cr")


def extension(path: Column) -> Column:
    """What follows the last dot of the last part of a path, in lower case; none where the dot leads or ends the name."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def sniff(text: Column) -> Column:
    """The kind that the first characters of a text show, or null."""
    head = F.upper(F.substring(text, 1, SNIFF_CHARS))
    return (
        F.when(head.rlike(r"(?m)^//\S*\s+(JOB|EXEC|PROC)\b"), "jcl")
        .when(head.rlike(r"\b(IDENTIFICATION|ID)\s+DIVISION\b") | head.contains("PROGRAM-ID"), "program")
        .when(head.contains("DFHMSD") | head.contains("DFHMDI"), "bms")
        .when(head.rlike(r"\bDEFINE\s+(TRANSACTION|PROGRAM|MAPSET|FILE)\s*\("), "csd")
        .when(head.rlike(r"\bCREATE\s+(TABLE|VIEW|INDEX|UNIQUE\s+INDEX)\b"), "ddl")
        .when(looks_like_idcams(head), "idcams")
        .when(head.rlike(r"(?m)^\s{0,12}0?1\s+[A-Z0-9-]+\s*\.?\s*$") & head.contains(" PIC"), "copybook")
    )


def looks_like_idcams(upper: Column) -> Column:
    return upper.contains("DEFINE") & (upper.contains("CLUSTER") | upper.contains("ALTERNATEINDEX") | upper.contains(" GDG"))


def kind_by_extension(ext: Column) -> Column:
    out = None
    for kind, extensions in KINDS_BY_EXTENSION.items():
        test = ext.isin(extensions.split())
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def classify(path: Column, text: Column) -> Column:
    """The kind of a member by its extension, or by content where the extension says nothing."""
    ext = extension(path)
    return F.coalesce(F.when(ext.isin(*SNIFFED), F.coalesce(sniff(text), F.when(ext == "ctl", "control"))).otherwise(kind_by_extension(ext)), F.lit("other"))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def catalogue(members: DataFrame) -> DataFrame:
    """path, kind, size_bytes, lines, sha256, encoding, line_ending, final_newline, blank, text."""
    text = F.col("text")
    return decode(members).select(
        "path",
        classify(F.col("path"), text).alias("kind"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        line_count(text).alias("lines"),
        F.sha2("content", 256).alias("sha256"),
        "encoding",
        line_ending(text).alias("line_ending"),
        text.rlike("[\n\r]\\z").alias("final_newline"),
        is_blank(text).alias("blank"),
        "text",
    )


def empty_file_issues(files: DataFrame) -> DataFrame:
    """An empty_file issue for each blank member that is neither documentation nor of unknown kind."""
    return files.where(F.col("blank") & ~F.col("kind").isin("doc", "other")).select(
        F.lit("warning").alias("severity"), F.lit("empty_file").alias("code"), F.concat(F.col("kind"), F.lit(" file is empty or blank")).alias("message"), "path"
    )
