"""Set operations, orders and joins on the business tables: the relational shapes behind the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir) -> DataFrame:
    """Filtered hash aggregate; the filter and six columns reach the scan."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("""
WITH r AS (SELECT c_nationkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n_name, o_orderkey, o_totalprice, rank FROM r JOIN nation ON n_nationkey = c_nationkey WHERE rank <= 3""")
def top_orders(spark, sf_dir) -> DataFrame:
    """A top three for each nation; the rank limit is pushed below the shuffle."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = o.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return r.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "o_orderkey", "o_totalprice", "rank")


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT p_partkey FROM part INTERSECT SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'parts_only', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'lines_only', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)""")
def key_set_equality(spark, sf_dir) -> DataFrame:
    """Intersection and both differences of two key sets."""
    p, li = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    count = lambda name, df: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count("both", p.intersect(li)).unionByName(count("parts_only", p.subtract(li))).unionByName(count("lines_only", li.subtract(p)))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1""")
def first_occurrence(spark, sf_dir) -> DataFrame:
    """The first row of each key, by a minimum that is combined before the shuffle."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "value")).alias("f"))
    return e.select("user_id", "event_type", "f.event_id", "f.value")


@query("""
WITH t AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 43200 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM t)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir) -> DataFrame:
    """Gaps and islands in time, as for list detection in text."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = table(spark, sf_dir, "events").withColumn("session", F.sum(F.when(gap <= 43200 * 1_000_000, 0).otherwise(1)).over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value > 0 GROUP BY event_type""")
def event_profile(spark, sf_dir) -> DataFrame:
    """Counts and sums by category."""
    e = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("value") > 0))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


@query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id""")
def conversation_shape(spark, sf_dir) -> DataFrame:
    """Ordered collection of a document's parts."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("o"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return c.select("conv_id", F.array_join(F.transform("o", lambda x: x["role"]), ">").alias("roles"), "turns", "chars")
