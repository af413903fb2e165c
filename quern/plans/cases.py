"""The wide table of decided cases that the analytics run on, built from the order tables.

Nations stand for courts, priorities for case types, statuses for outcomes, the
suppliers of an order for its judges (that of line 1 writes), part brands for
acts cited, and suppliers by return flag for the sides' counsel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table

#: What an order's status stands for.
OUTCOMES = {"F": "allowed", "O": "dismissed", "P": "partly allowed"}
#: Lines of orders in a task, or so: what their arrays and the pairs made of these take of its memory is about 150 MB.
TASK_LINES = 1 << 19


def base_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, court, year, decision_date, case_type, disposal, value."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    outcome = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("case_id"), F.col("n_name").alias("court"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("decision_date"),
        F.col("o_orderpriority").alias("case_type"), outcome[F.col("o_orderstatus")].alias("disposal"), F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("party"),
    )


def by_case(lines: DataFrame, total: int) -> DataFrame:
    """``total`` lines, those of a case in one of as many tasks as they need, so that a task holds no more of a larger table."""
    return lines.repartition(max(lines.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_LINES)), "l_orderkey")


def lines_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return by_case(lines, lines.count())


def case_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, judge array, author, acts array, counsel array of (side, name), from the lines of each order."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    side = F.when(F.col("l_returnflag") == "R", "respondent").otherwise("petitioner")
    joined = lines.join(part, lines.l_partkey == part.p_partkey, "left")
    return by_case(joined, lines.count()).groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.sort_array(F.collect_set("l_suppkey")).alias("judge"),
        F.min(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("author"),
        F.sort_array(F.collect_set("p_brand")).alias("acts"),
        F.sort_array(F.collect_set(F.struct(side.alias("side"), F.col("l_suppkey").alias("name")))).alias("counsel"),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, year, disposal alone, for what needs no court or party: straight from the orders."""
    outcome = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.year("o_orderdate").alias("year"), outcome[F.col("o_orderstatus")].alias("disposal"))


def benches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, judge array, author; nothing but the lines is read, and the array is of one case's few lines."""
    first = F.min(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("author")
    return lines_by_case(spark, sf_dir).groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("judge"), first)


def counsel_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, year, disposal, counsel array, from lines and orders alone."""
    side = F.when(F.col("l_returnflag") == "R", "respondent").otherwise("petitioner")
    counsel = lines_by_case(spark, sf_dir).groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sort_array(F.collect_set(F.struct(side.alias("side"), F.col("l_suppkey").alias("name")))).alias("counsel"))
    return order_facts(spark, sf_dir).join(counsel, "case_id")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_cases(spark, sf_dir).join(case_arrays(spark, sf_dir), "case_id", "left")


#: The same tables for DuckDB, as common table expressions.
BASE_SQL = """base AS (
  SELECT o_orderkey AS case_id, n_name AS court, year(o_orderdate)::INT AS year, o_orderdate::DATE AS decision_date, o_orderpriority AS case_type,
         CASE o_orderstatus WHEN 'F' THEN 'allowed' WHEN 'O' THEN 'dismissed' WHEN 'P' THEN 'partly allowed' END AS disposal,
         o_totalprice AS value, o_custkey AS party
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
JUDGES_SQL = "judges AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS judge FROM lineitem)"
AUTHORS_SQL = "authors AS (SELECT l_orderkey AS case_id, min(l_suppkey) AS author FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"
ACTS_SQL = "acts AS (SELECT DISTINCT l_orderkey AS case_id, p_brand AS act FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL)"
COUNSEL_SQL = "counsel AS (SELECT DISTINCT l_orderkey AS case_id, CASE WHEN l_returnflag = 'R' THEN 'respondent' ELSE 'petitioner' END AS side, l_suppkey AS name FROM lineitem)"
