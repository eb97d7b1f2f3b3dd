"""Relational work around the fingerprints, over the driver's star schema, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, similarity
from ..storage import materialise
from . import catalogue as prints_of
from .registry import ORACLE_SQL, query, table


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def filter_project_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_group(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders UNION ALL (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_operations(spark, sf_dir):
    """Customers without orders, and those with orders and a debt."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customers.select("c_custkey").subtract(orders).unionAll(orders.intersect(customers.where("c_acctbal < 0").select("c_custkey")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 100")
def skip_and_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(100).limit(25)


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS loud, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def row_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("loud"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT year(ts) AS y, month(ts) AS m, day(ts) AS d, strftime(min(ts), '%Y-%m-%d') AS day, count(*) AS n, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span FROM events GROUP BY year(ts), month(ts), day(ts)")
def date_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.year("ts").alias("y"), F.month("ts").alias("m"), F.day("ts").alias("d"))
    return rows.agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("day"), F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("span"))


@query("SELECT user_id, max(CASE WHEN event_type = t THEN n END) AS top, count(*) AS kinds, sum(n)::BIGINT AS total FROM (SELECT user_id, event_type, count(*) AS n, first_value(event_type) OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS t FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def map_counts(spark, sf_dir):
    """Counts by kind as a map, and what the map tells."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.array_max(F.map_values("m")).alias("top"), F.size("m").cast("long").alias("kinds"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_import(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_RESULTS = ORACLE_SQL["all_pairs_results"].replace(" SELECT a, b, round(cp, 9) AS cp, round(fm, 9) AS fm FROM scored", ", res AS (SELECT a, b, cp FROM scored") + ")"


def _results(spark, sf_dir):
    return similarity.all_pairs_results(prints_of.prints(spark, sf_dir)).select(F.col("a").alias("oid1"), F.col("b").alias("oid2"), "cp")


@query(_RESULTS + " SELECT x.doc_id AS oid1, y.doc_id AS oid2, x.lang = y.lang AND x.source = y.source AS alike FROM res JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b")
def metadata_lookup(spark, sf_dir):
    """What the metadata say of both ends of each result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "source").alias("m"))
    both = _results(spark, sf_dir).join(docs.toDF("oid1", "m1"), "oid1").join(docs.toDF("oid2", "m2"), "oid2")
    return both.select("oid1", "oid2", (F.col("m1") == F.col("m2")).alias("alike"))


@query(_RESULTS + " SELECT CASE WHEN a % 2 = 0 THEN a ELSE b END AS oid1, CASE WHEN a % 2 = 0 THEN b ELSE a END AS oid2, round(cp, 9) AS cp FROM res")
def symmetric_lookup(spark, sf_dir):
    """Results asked from either end: each pair is looked up turned round where its smaller id is odd."""
    found = materialise(_results(spark, sf_dir), "results")  # read three times
    even = F.col("oid1") % 2 == 0
    asked = found.select(F.when(even, F.col("oid1")).otherwise(F.col("oid2")).alias("oid1"), F.when(even, F.col("oid2")).otherwise(F.col("oid1")).alias("oid2"))
    return asked.join(dedupe.both_ways(found, "cp"), ["oid1", "oid2"]).select("oid1", "oid2", F.round("cp", 9).alias("cp"))


@query("SELECT u.user_id, u.event_id FROM events u WHERE u.event_type NOT IN ('view') AND NOT list_has_any(string_split(u.event_type, '_'), ['click', 'scroll'])")
def disjoint_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'")
    return rows.where(~F.arrays_overlap(F.split("event_type", "_"), F.array(F.lit("click"), F.lit("scroll")))).select("user_id", "event_id")
