"""Graph views over the star-schema tables, as DataFrames and as the same common table expressions in SQL.

Suppliers and parts stand for works, line items for citation assertions (a supplier cites the parts it delivered), orders
for documents. The domain tables (graph_work, work_identifier, ...) are read as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

LIVE = ["asserted", "accepted"]


def works(spark: SparkSession, d: str) -> DataFrame:
    """(id, title, year, kind, tag, mark) of the cited works."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        F.concat(F.lit("P"), k.cast("string")).alias("id"), F.col("p_name").alias("title"), F.when(k % 17 != 0, (1900 + k % 120).cast("int")).alias("year"), F.col("p_type").alias("kind"), F.col("p_brand").alias("tag"),
        F.when(s <= 5, "pinned").when(s.between(41, 45), "downplayed").when(s >= 46, "hidden").alias("mark"), k.alias("num"),
    )


WORKS = """works as (select 'P' || p_partkey as id, p_name as title, case when p_partkey % 17 <> 0 then cast(1900 + p_partkey % 120 as int) end as year, p_type as kind, p_brand as tag,
  case when p_size <= 5 then 'pinned' when p_size between 41 and 45 then 'downplayed' when p_size >= 46 then 'hidden' end as mark, p_partkey as num from part)"""


def assertions(spark: SparkSession, d: str) -> DataFrame:
    """(citing, cited, source, place, label, status): one row per assertion, live or not."""
    r = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("citing"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("cited"), F.col("l_orderkey").alias("source"), F.col("l_linenumber").cast("bigint").alias("place"),
        F.when(r == "A", "uses_method").when(r == "R", "background").otherwise("other").alias("label"),
        F.when((r == "R") & (F.col("l_linestatus") == "O"), "rejected").when(r == "R", "withdrawn").when(r == "A", "accepted").otherwise("asserted").alias("status"), F.col("l_shipdate").alias("observed_at"),
    )


ASSERTIONS = """assertions as (select 'S' || l_suppkey as citing, 'P' || l_partkey as cited, l_orderkey as source, cast(l_linenumber as bigint) as place,
  case l_returnflag when 'A' then 'uses_method' when 'R' then 'background' else 'other' end as label,
  case when l_returnflag = 'R' and l_linestatus = 'O' then 'rejected' when l_returnflag = 'R' then 'withdrawn' when l_returnflag = 'A' then 'accepted' else 'asserted' end as status,
  l_shipdate as observed_at from lineitem), live as (select * from assertions where status in ('asserted', 'accepted'))"""


def live(spark: SparkSession, d: str) -> DataFrame:
    return assertions(spark, d).where(F.col("status").isin(*LIVE))


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """(work, state): whether a work's document is present, tombstoned or missing."""
    return table(spark, d, "orders").select(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("work"), F.when(F.col("o_orderstatus") == "F", "present").when(F.col("o_orderstatus") == "P", "tombstoned").otherwise("missing").alias("state"))


DOCUMENTS_OF = """documents_of as (select 'P' || o_orderkey as work, case o_orderstatus when 'F' then 'present' when 'P' then 'tombstoned' else 'missing' end as state from orders)"""
