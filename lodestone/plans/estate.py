"""An estate made of the star-schema tables: programs, copybooks, jobs and references in the shapes that readers emit.

It exercises the operators at any size: suppliers are programs, parts are copybooks, orders
are jobs, customers are transactions, nations are tables, and line items are references.
SQL holds the same definitions as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Estate:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def items(self) -> DataFrame:
        """Line items with pos: 1, 2, ... within their order, as line numbers repeat."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        return self.table("lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))

    def programs(self) -> DataFrame:
        s = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        name = F.concat(F.lit("PGM"), F.col("s_suppkey"))
        base = s.select(
            F.concat(F.lit("program:"), name).alias("id"),
            name.alias("name"),
            F.when(F.col("s_suppkey") % 10 != 3, name).alias("program_id"),
            name.alias("member"),
            F.concat(F.lit("cbl/"), "n_name", F.lit("/"), name, F.lit(".cbl")).alias("path"),
            F.col("n_name").alias("area"),
            (F.col("s_suppkey") % 4 == 0).alias("has_cics"),
            (F.col("s_suppkey") % 3 == 0).alias("has_sql"),
            (F.col("s_suppkey") % 5 == 0).alias("has_using"),
            (F.col("s_suppkey") % 11 != 0).alias("scanned"),
            "s_suppkey",
        )
        twice = base.where(F.col("s_suppkey") % 25 == 0).withColumn("path", F.concat(F.lit("dup/"), "path"))
        return base.unionByName(twice).drop("s_suppkey")

    def copybooks(self) -> DataFrame:
        member = F.concat(F.lit("CPY"), F.col("p_partkey"))
        base = self.table("part").where("p_size > 5").select(
            F.concat(F.lit("copybook:"), member).alias("id"),
            member.alias("member"),
            F.concat(F.lit("cpy/"), member, F.lit(".cpy")).alias("path"),
            F.element_at(F.array(*map(F.lit, ("data", "procedure", "mixed", "other"))), (F.col("p_size") % 4 + 1).cast("int")).alias("content_kind"),
            "p_size",
        )
        return base.unionByName(base.where("p_size > 45").withColumn("path", F.concat(F.lit("old/"), "path"))).drop("p_size")

    def csd(self) -> DataFrame:
        """(type, name, path, line) of the online definitions."""
        def some(df: DataFrame, kind: str, key: str, prefix: str) -> DataFrame:
            return df.select(F.lit(kind).alias("type"), F.concat(F.lit(prefix), key).alias("name"), F.lit("csd/all.csd").alias("path"), F.col(key).cast("int").alias("line"))

        return (
            some(self.table("customer"), "TRANSACTION", "c_custkey", "T")
            .union(some(self.table("supplier").where("s_suppkey % 8 = 0"), "PROGRAM", "s_suppkey", "PGM"))
            .union(some(self.table("nation").where("n_nationkey < 20"), "FILE", "n_nationkey", "F"))
        )

    def tables(self) -> DataFrame:
        """(id, name, path) of database tables; regions have one table in each of two schemas."""
        nation = self.table("nation").select(F.concat(F.lit("S"), "n_regionkey", F.lit("."), "n_name").alias("name"))
        region = self.table("region").select(F.explode(F.array(F.concat(F.lit("A."), "r_name"), F.concat(F.lit("B."), "r_name"))).alias("name"))
        return nation.union(region).select(F.concat(F.lit("table:"), "name").alias("id"), "name", F.lit("ddl/all.sql").alias("path"))

    def references(self) -> DataFrame:
        """ord, type, from_id, target, path, line, as readers emit them."""
        names = self.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("short")).union(
            self.table("region").select((F.col("r_regionkey") + 25).alias("k"), F.col("r_name").alias("short"))
        )
        li = self.items().select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "pos")
        li = li.join(F.broadcast(names), F.col("l_partkey") % 33 == F.col("k"), "left")
        part, supp, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        program = F.concat(F.lit("program:PGM"), supp)
        rows = li.select(
            (F.col("l_orderkey") * 100 + F.col("pos")).alias("ord"),
            F.when(ln == 1, "COPY").when((ln == 2) | ((ln == 3) & (part % 20 != 1)), "STATIC_CALL").when(ln == 3, "DYNAMIC_CALL").when(ln == 4, "SQL_TABLE").when(ln == 5, "JCL_EXEC").when(ln == 6, "CICS_FILE").otherwise("CICS_RETURN_TRANSID").alias("type"),
            F.when(ln == 2, F.concat(F.lit("copybook:CPY"), part)).when(ln == 5, F.concat(F.lit("job:JOB"), "l_orderkey")).otherwise(program).alias("from_id"),
            F.when(ln == 1, F.concat(F.lit("CPY"), part))
            .when(ln == 2, F.concat(F.lit("PGM"), supp))
            .when(ln == 3, F.when(part % 20 == 0, F.concat(F.lit("DFHX"), part)).when(part % 20 != 1, F.concat(F.lit("PGM"), part)))
            .when(ln == 4, F.when(part % 7 == 0, F.concat(F.lit("SESSION.T"), part)).when(part % 7 == 1, F.concat(F.lit("SYSIBM.T"), part)).otherwise(F.concat(F.lit("X."), F.coalesce("short", F.lit("NOSUCH")))))
            .when(ln == 5, F.when(part % 9 == 0, "IDCAMS").otherwise(F.concat(F.lit("PGM"), supp)))
            .when(ln == 6, F.concat(F.lit("F"), part % 40))
            .otherwise(F.concat(F.lit("T"), part))
            .alias("target"),
            F.concat(F.lit("src/"), "l_orderkey").alias("path"),
            ln.alias("line"),
        )
        starts = self.table("orders").select(
            (F.col("o_orderkey") * 100).alias("ord"),
            F.lit("CSD_TRANSACTION").alias("type"),
            F.concat(F.lit("transaction:T"), "o_custkey").alias("from_id"),
            F.concat(F.lit("PGM"), F.col("o_orderkey") % 100 + 1).alias("target"),
            F.concat(F.lit("csd/"), "o_orderkey").alias("path"),
            F.lit(1).alias("line"),
        )
        return rows.union(starts)


#: The same definitions for the oracle.
ITEMS = "items AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS pos FROM lineitem)"
SQL = ITEMS + """
, programs0 AS (
  SELECT 'program:PGM' || s_suppkey AS id, 'PGM' || s_suppkey AS name, CASE WHEN s_suppkey % 10 <> 3 THEN 'PGM' || s_suppkey END AS program_id, 'PGM' || s_suppkey AS member,
    'cbl/' || n_name || '/PGM' || s_suppkey || '.cbl' AS path, n_name AS area, s_suppkey % 4 = 0 AS has_cics, s_suppkey % 3 = 0 AS has_sql, s_suppkey % 5 = 0 AS has_using, s_suppkey % 11 <> 0 AS scanned, s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), programs AS (
  SELECT * FROM programs0 UNION ALL SELECT id, name, program_id, member, 'dup/' || path, area, has_cics, has_sql, has_using, scanned, s_suppkey FROM programs0 WHERE s_suppkey % 25 = 0
), copybooks0 AS (
  SELECT 'copybook:CPY' || p_partkey AS id, 'CPY' || p_partkey AS member, 'cpy/CPY' || p_partkey || '.cpy' AS path, (['data', 'procedure', 'mixed', 'other'])[p_size % 4 + 1] AS content_kind, p_size FROM part WHERE p_size > 5
), copybooks AS (
  SELECT * FROM copybooks0 UNION ALL SELECT id, member, 'old/' || path, content_kind, p_size FROM copybooks0 WHERE p_size > 45
), csd AS (
  SELECT 'TRANSACTION' AS type, 'T' || c_custkey AS name, 'csd/all.csd' AS path, c_custkey AS line FROM customer
  UNION ALL SELECT 'PROGRAM', 'PGM' || s_suppkey, 'csd/all.csd', s_suppkey FROM supplier WHERE s_suppkey % 8 = 0
  UNION ALL SELECT 'FILE', 'F' || n_nationkey, 'csd/all.csd', n_nationkey FROM nation WHERE n_nationkey < 20
), tables AS (
  SELECT 'table:' || name AS id, name FROM (SELECT 'S' || n_regionkey || '.' || n_name AS name FROM nation UNION ALL SELECT 'A.' || r_name FROM region UNION ALL SELECT 'B.' || r_name FROM region)
), shorts AS (
  SELECT n_nationkey AS k, n_name AS short FROM nation UNION ALL SELECT r_regionkey + 25, r_name FROM region
), refs AS (
  SELECT l_orderkey * 100 + pos AS ord,
    CASE WHEN l_linenumber = 1 THEN 'COPY' WHEN l_linenumber = 2 OR (l_linenumber = 3 AND l_partkey % 20 <> 1) THEN 'STATIC_CALL' WHEN l_linenumber = 3 THEN 'DYNAMIC_CALL' WHEN l_linenumber = 4 THEN 'SQL_TABLE'
      WHEN l_linenumber = 5 THEN 'JCL_EXEC' WHEN l_linenumber = 6 THEN 'CICS_FILE' ELSE 'CICS_RETURN_TRANSID' END AS type,
    CASE WHEN l_linenumber = 2 THEN 'copybook:CPY' || l_partkey WHEN l_linenumber = 5 THEN 'job:JOB' || l_orderkey ELSE 'program:PGM' || l_suppkey END AS from_id,
    CASE WHEN l_linenumber = 1 THEN 'CPY' || l_partkey WHEN l_linenumber = 2 THEN 'PGM' || l_suppkey
      WHEN l_linenumber = 3 THEN CASE WHEN l_partkey % 20 = 0 THEN 'DFHX' || l_partkey WHEN l_partkey % 20 <> 1 THEN 'PGM' || l_partkey END
      WHEN l_linenumber = 4 THEN CASE WHEN l_partkey % 7 = 0 THEN 'SESSION.T' || l_partkey WHEN l_partkey % 7 = 1 THEN 'SYSIBM.T' || l_partkey ELSE 'X.' || coalesce(short, 'NOSUCH') END
      WHEN l_linenumber = 5 THEN CASE WHEN l_partkey % 9 = 0 THEN 'IDCAMS' ELSE 'PGM' || l_suppkey END
      WHEN l_linenumber = 6 THEN 'F' || (l_partkey % 40) ELSE 'T' || l_partkey END AS target,
    'src/' || l_orderkey AS path, l_linenumber AS line
  FROM items LEFT JOIN shorts ON l_partkey % 33 = k
  UNION ALL
  SELECT o_orderkey * 100, 'CSD_TRANSACTION', 'transaction:T' || o_custkey, 'PGM' || (o_orderkey % 100 + 1), 'csd/' || o_orderkey, 1 FROM orders
), program_names AS (
  SELECT name, min_by(id, path) AS id, count(*) AS n FROM (
    SELECT program_id AS name, id, path FROM programs WHERE program_id IS NOT NULL
    UNION ALL SELECT member, id, path FROM programs WHERE member NOT IN (SELECT program_id FROM programs WHERE program_id IS NOT NULL)) GROUP BY name
), copy_names AS (SELECT member AS name, count(*) AS n FROM copybooks GROUP BY member
), table_shorts AS (SELECT list_last(string_split(name, '.')) AS short, min(id) AS id, count(*) AS n FROM tables GROUP BY 1
), resolved AS (
  SELECT r.*,
    CASE WHEN r.type = 'DYNAMIC_CALL' THEN NULL
      WHEN r.target = 'IDCAMS' THEN 'utility:IDCAMS'
      WHEN r.type IN ('STATIC_CALL', 'JCL_EXEC', 'CSD_TRANSACTION') THEN coalesce(p.id, 'program:' || r.target)
      WHEN r.type = 'COPY' THEN 'copybook:' || r.target
      WHEN r.type = 'SQL_TABLE' THEN CASE WHEN r.target LIKE 'SESSION.%' OR r.target LIKE 'SYSIBM.%' THEN 'table:' || r.target WHEN t.id IS NOT NULL THEN t.id WHEN s.n = 1 THEN s.id ELSE 'table:' || r.target END
      WHEN r.type = 'CICS_FILE' THEN 'cics_file:' || r.target ELSE 'transaction:' || r.target END AS to_id,
    CASE WHEN r.type = 'DYNAMIC_CALL' THEN 'dynamic'
      WHEN r.target = 'IDCAMS' THEN 'system'
      WHEN r.type IN ('STATIC_CALL', 'JCL_EXEC', 'CSD_TRANSACTION') THEN CASE WHEN p.id IS NOT NULL THEN 'resolved' WHEN r.target LIKE 'DFH%' THEN 'system' ELSE 'unresolved' END
      WHEN r.type = 'COPY' THEN CASE WHEN c.n IS NULL THEN 'unresolved' WHEN c.n > 1 THEN 'ambiguous' ELSE 'resolved' END
      WHEN r.type = 'SQL_TABLE' THEN CASE WHEN r.target LIKE 'SESSION.%' THEN 'temporary' WHEN r.target LIKE 'SYSIBM.%' THEN 'system' WHEN t.id IS NOT NULL OR s.n = 1 THEN 'resolved' ELSE 'undefined' END
      ELSE CASE WHEN x.name IS NOT NULL THEN 'resolved' ELSE 'unresolved' END END AS resolution
  FROM refs r
  LEFT JOIN program_names p ON r.type IN ('STATIC_CALL', 'JCL_EXEC', 'CSD_TRANSACTION') AND p.name = r.target
  LEFT JOIN copy_names c ON r.type = 'COPY' AND c.name = r.target
  LEFT JOIN tables t ON r.type = 'SQL_TABLE' AND t.name = r.target
  LEFT JOIN table_shorts s ON r.type = 'SQL_TABLE' AND s.short = list_last(string_split(r.target, '.'))
  LEFT JOIN (SELECT DISTINCT type, name FROM csd) x ON (x.type = 'FILE' AND r.type = 'CICS_FILE' OR x.type = 'TRANSACTION' AND r.type = 'CICS_RETURN_TRANSID') AND x.name = r.target
), edges AS (
  SELECT from_id, to_id, type, count(*) AS count, min_by(resolution, (path, line, type, coalesce(target, ''), ord)) AS resolution FROM resolved WHERE to_id IS NOT NULL GROUP BY from_id, to_id, type
)
"""


def with_estate(query: str, recursive: bool = False) -> str:
    """The estate's common table expressions in front of a query, or of more expressions after a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{query}"
