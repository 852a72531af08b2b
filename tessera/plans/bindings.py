"""The engine's inputs as views of the driver's tables. Each text is SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MATERIALS = """
SELECT CAST(p_partkey AS BIGINT) AS ord,
  'MAT-' || lpad(CAST(p_partkey AS STRING), 7, '0') AS material_id,
  CASE WHEN p_partkey % 29 = 0 THEN '' ELSE
    CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'ÓLEO' WHEN 'bolt' THEN 'PARAF.' WHEN 'gear' THEN 'MOTOR'
         WHEN 'gizmo' THEN 'MANÔMETRO' WHEN 'plate' THEN 'TUBO AC' WHEN 'ring' THEN 'ROLAM' WHEN 'rod' THEN 'CABO' ELSE 'FILTRO' END
    || ' ' || CASE split_part(p_name, ' ', 1) WHEN 'new' THEN 'INDUSTRIAL' WHEN 'old' THEN 'SEXT' ELSE upper(split_part(p_name, ' ', 1)) END
    || ' ' || CAST(p_size AS STRING) || 'MM ' || substr(p_brand, 7) || ' POL' END AS description_short,
  CASE p_type WHEN 'LARGE' THEN 'TENSÃO ' || CAST(100 + 7 * p_size AS STRING) || ' V 60 HZ'
       WHEN 'MEDIUM' THEN 'CONEXÃO COM ROSCA, 220V' WHEN 'PROMO' THEN 'ELEMENTO 10 MICRA' WHEN 'STANDARD' THEN 'ISO VG 68' ELSE '' END AS long_description,
  CASE p_partkey % 13 WHEN 0 THEN 'CX' WHEN 1 THEN '' WHEN 2 THEN 'm' WHEN 3 THEN 'KG' WHEN 4 THEN 'L' WHEN 5 THEN 'UN' ELSE 'PC' END AS unit,
  p_brand AS manufacturer,
  CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 2)) || '-' || CAST(p_size AS STRING) ELSE '' END AS manufacturer_part_number,
  p_type AS material_group,
  CASE p_partkey % 17 WHEN 0 THEN 'ATIVO' WHEN 1 THEN '' WHEN 2 THEN 'under_review' WHEN 3 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {part}
"""

#: A deterministic stand-in for expected labels: these rows have no ground truth.
LABELS = """
SELECT CAST(p_partkey AS BIGINT) AS ord,
  CASE WHEN p_partkey % 29 = 0 THEN 'MISSING_CRITICAL_FIELD' WHEN p_partkey % 13 = 0 THEN 'INVALID_UNIT' WHEN p_partkey % 17 = 0 THEN 'INVALID_STATUS'
       WHEN p_partkey % 7 = 0 THEN 'POSSIBLE_DUPLICATE' WHEN p_partkey % 5 = 0 THEN 'MISSING_TECHNICAL_ATTRIBUTE' ELSE 'VALID' END AS expected_issue
FROM {part}
"""

#: Events with an order of their own: 1000 places for each order, so that no sort of all events is needed.
LIFECYCLE = """
WITH o AS (
  SELECT 'EO-' || CAST(o_orderkey AS STRING) AS event_id, 'WF-' || CAST(o_orderkey AS STRING) AS workflow_id,
         'OPENED' AS kind, 'MAT-' || CAST(o_custkey AS STRING) AS material_id,
         CASE o_orderstatus WHEN 'O' THEN 'REVIEW' WHEN 'F' THEN 'REJECT' ELSE 'APPROVE' END AS decision,
         CAST(NULL AS STRING) AS human_decision, o_orderdate AS event_at, o_orderkey AS k1, 0 AS k2, 0 AS k3, 0 AS k4, CAST(0 AS DOUBLE) AS k5
  FROM {orders} WHERE o_orderkey % 10 <> 9),
c AS (
  SELECT 'EC-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS event_id, 'WF-' || CAST(l_orderkey AS STRING) AS workflow_id,
         'CONCLUDED' AS kind,
         'MAT-' || CAST(CASE WHEN l_partkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS material_id,
         CASE WHEN l_suppkey % 5 = 0 THEN 'APPROVE' ELSE CASE o_orderstatus WHEN 'O' THEN 'REVIEW' WHEN 'F' THEN 'REJECT' ELSE 'APPROVE' END END AS decision,
         CASE l_returnflag WHEN 'A' THEN 'APPROVE' WHEN 'R' THEN 'REJECT' ELSE 'REQUEST_CORRECTION' END AS human_decision,
         l_shipdate AS event_at, l_orderkey AS k1, 1 AS k2, l_linenumber AS k3, l_partkey * 100000 + l_suppkey AS k4, l_extendedprice AS k5
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)
SELECT CAST(k1 * 1000 + row_number() OVER (PARTITION BY k1 ORDER BY k2, k3, k4, k5) AS BIGINT) AS seq, event_id, workflow_id, kind, material_id, decision, human_decision, event_at
FROM (SELECT * FROM o UNION ALL SELECT * FROM c) u
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MATERIALS, part=_table(spark, sf_dir, "part"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LABELS, part=_table(spark, sf_dir, "part"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of LIFECYCLE in one shuffle: orders and line items are dealt by the order's key as the numbers that they are,
    where they meet and get their places, and are spelt out after that."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    a = orders.select(F.col("o_orderkey").cast("long").alias("k1"), F.lit(0).alias("k2"), F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")).alias("o"), F.col("o_orderdate").alias("event_at"))
    b = lines.select(
        F.col("l_orderkey").cast("long").alias("k1"), F.lit(1).alias("k2"), F.col("l_linenumber").alias("k3"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").alias("event_at"), F.col("l_extendedprice").alias("k5"),
    )
    of = Window.partitionBy("k1")
    rows = a.unionByName(b, allowMissingColumns=True).where("k1 is not null")
    # A line item meets each order of its key, an order itself.
    met = F.when(F.col("k2") == 0, F.array("o")).otherwise(F.collect_list("o").over(of))
    rows = rows.withColumn("met", met).select("k1", "k2", "k3", "part", "supp", "flag", "event_at", "k5", F.explode("met").alias("o"))
    rows = rows.where("k2 = 1 or k1 % 10 <> 9")
    place = F.row_number().over(of.orderBy("k2", "k3", F.expr("part * 100000 + supp"), "k5"))
    opens, key, cust = F.col("k2") == 0, F.col("k1").cast("string"), F.col("o.cust")
    own = F.when(F.col("o.status") == "O", "REVIEW").when(F.col("o.status") == "F", "REJECT").otherwise("APPROVE")
    return rows.select(
        (F.col("k1") * 1000 + place).cast("long").alias("seq"),
        F.when(opens, F.concat(F.lit("EO-"), key)).otherwise(F.concat(F.lit("EC-"), key, F.lit("-"), F.col("k3").cast("string"))).alias("event_id"),
        F.concat(F.lit("WF-"), key).alias("workflow_id"),
        F.when(opens, "OPENED").otherwise("CONCLUDED").alias("kind"),
        F.concat(F.lit("MAT-"), F.when(F.col("part") % 7 == 0, cust + 1).otherwise(cust).cast("string")).alias("material_id"),
        F.when(F.col("supp") % 5 == 0, "APPROVE").otherwise(own).alias("decision"),
        F.when(~opens, F.when(F.col("flag") == "A", "APPROVE").when(F.col("flag") == "R", "REJECT").otherwise("REQUEST_CORRECTION")).alias("human_decision"),
        "event_at",
    )
