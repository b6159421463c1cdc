"""Ledgers built from the given tables, each with the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerrecon.config import KeyDef, ReconConfig
from ledgerrecon.labels import CANCELED_FLAG, REVERSAL_FLAG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- RECON: line items against orders ---------------------------------------

BY_ORDER = KeyDef("pedido", ("l_orderkey",), ("o_orderkey",))
BY_YEAR = KeyDef("ano", ("ship_year",), ("order_year",))
BY_PARTY = KeyDef("parte", ("l_partkey",), ("o_custkey",))
THRESHOLD = 50000.0


def recon_config(*keys: KeyDef, **changes) -> ReconConfig:
    base = dict(value_column_a="l_extendedprice", value_column_b="amount", threshold=THRESHOLD,
                id=1, name="itens x pedidos", base_a_id=10, base_b_id=20)
    return ReconConfig(keys=keys or (BY_ORDER,), **{**base, **changes})


def recon_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate"))


def recon_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns({
        "amount": F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(F.col("o_totalprice")),
        "order_year": F.year("o_orderdate"),
        CANCELED_FLAG: F.col("o_orderstatus") == "F",
        REVERSAL_FLAG: F.lit(False),
    })


RECON_SQL = """
ledger_a AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, year(l_shipdate) AS ship_year,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS v
  FROM lineitem),
ledger_b AS (
  SELECT o_orderkey, o_custkey, year(o_orderdate) AS order_year, o_orderstatus = 'F' AS is_canceled,
         CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS amount,
         CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS DECIMAL(18,2)) AS v
  FROM orders)"""


# --- JOURNAL: orders, their reversals and re-reversals ----------------------

def journal(spark: SparkSession, sf_dir: str, drift: float = 0.0) -> DataFrame:
    """Account pairs with values; ``drift`` shifts reversals by up to twice as much."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    final = F.col("o_orderstatus") == "F"
    off = F.lit(drift) * (k % 3) if drift else F.lit(0.0)

    def entry(n: int, a, b, v, when):
        return F.struct((k * 4 + n).alias("row_index"), a.alias("a"), b.alias("b"), v.alias("v"), when.alias("keep"))

    back = F.round(off - price, 2) if drift else -price
    rows = F.array(
        entry(0, F.col("o_custkey"), k % 97, price, F.lit(True)),
        entry(1, k % 97, F.col("o_custkey"), back, final),
        entry(2, k % 97, F.col("o_custkey"), back, final & (F.col("o_orderpriority") == "1-URGENT")),
    )
    return table(spark, sf_dir, "orders").select(F.inline(rows)).where("keep").drop("keep")


def journal_sql(back: str = "-o_totalprice") -> str:
    return f"""
journal AS (
  SELECT o_orderkey * 4 AS row_index, o_custkey AS a, o_orderkey % 97 AS b, o_totalprice AS v FROM orders
  UNION ALL
  SELECT o_orderkey * 4 + 1, o_orderkey % 97, o_custkey, {back} FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT o_orderkey * 4 + 2, o_orderkey % 97, o_custkey, {back} FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"""


def text_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOURNAL with text accounts, account 0 missing, and an indicator."""
    account = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    return journal(spark, sf_dir).select(
        "row_index", account("a").alias("acct_a"), account("b").alias("acct_b"), "v",
        F.when(F.col("row_index") % 5 == 0, " s ").when(F.col("row_index") % 7 == 0, "").otherwise("N").alias("ind"),
    )


TEXT_JOURNAL_SQL = journal_sql() + """,
text_journal AS (
  SELECT row_index, CASE WHEN a <> 0 THEN CAST(a AS VARCHAR) END AS acct_a,
         CASE WHEN b <> 0 THEN CAST(b AS VARCHAR) END AS acct_b, v,
         CASE WHEN row_index % 5 = 0 THEN ' s ' WHEN row_index % 7 = 0 THEN '' ELSE 'N' END AS ind
  FROM journal)"""


# --- MESSY: blanks, spellings of numbers, indicators ------------------------

def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    base = table(spark, sf_dir, "orders").select(k.alias("k"), cents.alias("cents"))
    cents = F.col("cents")
    u = (cents - cents % 100) / 100
    units = u.cast("bigint").cast("string")
    c = F.lpad((cents % 100).cast("string"), 2, "0")
    thousand = F.lpad((u.cast("bigint") % 1000).cast("string"), 3, "0")
    kind = F.col("k") % 8

    def pick(*values):
        out = F.lit(None).cast("string")
        for i, value in enumerate(values):
            if value is not None:
                out = F.when(kind == i, value).otherwise(out)
        return out

    return base.select(
        "k", "cents",
        pick("S", " s ", "N", "true", "1", None, "", "no").alias("ind"),
        pick(F.concat_ws(".", units, c), F.concat_ws(",", units, c), F.concat(F.lit("("), units, F.lit(","), c, F.lit(")")),
             F.concat(F.lit("R$ "), units, F.lit(","), c), F.concat(F.lit("1."), thousand, F.lit(","), c),
             "abc", "", None).alias("num_text"),
        F.when(kind != 7, cents / 100.0).alias("num"),
        pick("x", "", "  ", None, "\t", "NULL", "y", " z ").alias("txt"),
    )


MESSY_SQL = """
messy_base AS (
  SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
messy_parts AS (
  SELECT k, cents, cents // 100 AS u, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS c FROM messy_base),
messy AS (
  SELECT k, cents,
    CASE k % 8 WHEN 0 THEN 'S' WHEN 1 THEN ' s ' WHEN 2 THEN 'N' WHEN 3 THEN 'true' WHEN 4 THEN '1'
               WHEN 6 THEN '' WHEN 7 THEN 'no' END AS ind,
    CASE k % 8 WHEN 0 THEN u || '.' || c WHEN 1 THEN u || ',' || c WHEN 2 THEN '(' || u || ',' || c || ')'
               WHEN 3 THEN 'R$ ' || u || ',' || c
               WHEN 4 THEN '1.' || lpad(CAST(u % 1000 AS VARCHAR), 3, '0') || ',' || c
               WHEN 5 THEN 'abc' WHEN 6 THEN '' END AS num_text,
    CASE WHEN k % 8 <> 7 THEN cents / 100.0 END AS num,
    CASE k % 8 WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 4 THEN chr(9) WHEN 5 THEN 'NULL'
               WHEN 6 THEN 'y' WHEN 7 THEN ' z ' END AS txt,
    CASE WHEN k % 8 IN (0, 1, 3) THEN cents WHEN k % 8 = 2 THEN -cents
         WHEN k % 8 = 4 THEN (1000 + u % 1000) * 100 + cents % 100 ELSE 0 END AS clean_cents
  FROM messy_parts)"""

MESSY_TYPES = {"ind": "string", "num_text": "string", "num": "number", "txt": "string"}
