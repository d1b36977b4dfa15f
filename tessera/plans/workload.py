"""Analytical questions over the registered tables as SQL that Spark and DuckDB both run.

{name} stands for a table, [[a|b]] for the days from date a to date b.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    # filters, projections, joins, sets
    "join_semi": "SELECT o_orderkey, o_custkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.08)",
    "join_anti": "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "join_full": "SELECT n.n_name AS n_name, CAST(count(s.s_suppkey) AS BIGINT) AS suppliers FROM {nation} n FULL OUTER JOIN {supplier} s ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name",
    "join_left": "SELECT c.c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n, CAST(count(o.o_orderkey) AS BIGINT) AS orders FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "join_inner_agg": "SELECT r.r_name AS region, round(sum(o.o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "join_right": "SELECT n.n_name AS n_name, c.c_custkey AS c_custkey FROM {customer} c RIGHT JOIN {nation} n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000",
    "join_cross": "SELECT r.r_name AS region, s.status AS status FROM {region} r CROSS JOIN (SELECT DISTINCT o_orderstatus AS status FROM {orders}) s",
    "join_lateral": "SELECT n.n_name AS n_name, t.s_name AS s_name FROM {nation} n, LATERAL (SELECT max(s.s_name) AS s_name FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey) t",
    "recursive_steps": "WITH RECURSIVE steps(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM steps WHERE n < 12) SELECT n, CAST(count(o.o_orderkey) AS BIGINT) AS orders FROM steps LEFT JOIN {orders} o ON month(o.o_orderdate) = n GROUP BY n",
    "approximate_distinct": "SELECT o_orderstatus AS status, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.2 * count(DISTINCT o_custkey) AS close FROM {orders} GROUP BY o_orderstatus",
    "join_range": "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey AND b.n_nationkey <= a.n_nationkey + 10",
    "rollup": "SELECT c_mktsegment AS segment, c_nationkey AS nation, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "cube": "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 15",
    "distinct_rows": "SELECT DISTINCT p_brand, p_size FROM {part}",
    "union_distinct": "SELECT c_nationkey AS nation FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "union_rows": "SELECT 'customer' AS kind, c_acctbal AS balance FROM {customer} UNION ALL SELECT 'supplier', s_acctbal FROM {supplier}",
    "intersect": "SELECT c_nationkey AS nation FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "except_all": "SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey FROM {customer}",
    "cte_subquery": "WITH per AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM {orders} GROUP BY o_custkey) SELECT o_custkey, round(spent, 2) AS spent FROM per WHERE spent > (SELECT avg(spent) * 2 FROM per)",
    "window_rank": "SELECT s_suppkey, s_nationkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS BIGINT) AS rnk, round(s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey), 2) AS step FROM {supplier}",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "pivot_status": "SELECT o_orderpriority AS priority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM {orders} GROUP BY o_orderpriority",
    # questions about stored entities
    "last_n_versions": "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS n FROM {events}) t WHERE n <= 3",
    "dangling_refs": "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    "volume_growth": "SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS total FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)) t",
    "selectivity": "SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0E0 / (SELECT count(*) FROM {orders}), 8) AS share FROM {orders} GROUP BY o_orderstatus",
    "cardinality_null_share": "SELECT 'o_custkey' AS col, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS kinds, round(avg(CASE WHEN o_custkey IS NULL THEN 1.0E0 ELSE 0.0E0 END), 8) AS null_share FROM {orders} UNION ALL SELECT 'o_orderpriority', CAST(count(*) AS BIGINT), CAST(count(DISTINCT o_orderpriority) AS BIGINT), round(avg(CASE WHEN o_orderpriority IS NULL THEN 1.0E0 ELSE 0.0E0 END), 8) FROM {orders} UNION ALL SELECT 'event_value', CAST(count(*) AS BIGINT), CAST(count(DISTINCT value) AS BIGINT), round(avg(CASE WHEN value IS NULL THEN 1.0E0 ELSE 0.0E0 END), 8) FROM {events}",
    "period_deltas": "SELECT day, n, CAST(n - lag(n) OVER (ORDER BY day) AS BIGINT) AS delta FROM (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY CAST(ts AS DATE)) t",
    "foreign_keys": "SELECT 'orders.o_custkey' AS fk, CAST(count(*) AS BIGINT) AS n, CAST(count(c.c_custkey) AS BIGINT) AS found FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey UNION ALL SELECT 'lineitem.l_partkey', CAST(count(*) AS BIGINT), CAST(count(p.p_partkey) AS BIGINT) FROM {lineitem} l LEFT JOIN {part} p ON l.l_partkey = p.p_partkey UNION ALL SELECT 'labels.doc_id', CAST(count(*) AS BIGINT), CAST(count(d.doc_id) AS BIGINT) FROM {labels} b LEFT JOIN {documents} d ON b.doc_id = d.doc_id",
    "header_vs_detail": "SELECT o.o_orderkey AS o_orderkey, round(o.o_totalprice, 2) AS header, round(d.detail, 2) AS detail FROM {orders} o JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS detail FROM {lineitem} GROUP BY l_orderkey) d ON o.o_orderkey = d.l_orderkey WHERE abs(o.o_totalprice - d.detail) > 1.0",
    "duplicates": "SELECT md5(text) AS digest, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id) AS BIGINT) AS first_id FROM {documents} GROUP BY md5(text) HAVING count(*) > 1",
    "load_lag": "SELECT event_type, CAST(max(ts) AS DATE) AS last_day, CAST([[CAST(max(ts) AS DATE)|DATE '2030-01-01']] AS BIGINT) AS days FROM {events} GROUP BY event_type",
    "user_last_events": "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {events}) t WHERE n = 1",
    "funnel": "SELECT CAST(count(v) AS BIGINT) AS viewed, CAST(sum(CASE WHEN c > v THEN 1 ELSE 0 END) AS BIGINT) AS clicked, CAST(sum(CASE WHEN c > v AND p > c THEN 1 ELSE 0 END) AS BIGINT) AS bought FROM (SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS v, min(CASE WHEN event_type = 'click' THEN ts END) AS c, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p FROM {events} GROUP BY user_id) t",
    "failures_by_type": "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS failures, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM {events} WHERE event_type = 'error' GROUP BY CAST(ts AS DATE)",
    "dau": "SELECT CAST(ts AS DATE) AS day, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM {events} GROUP BY CAST(ts AS DATE)",
    "wau": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM {events} GROUP BY CAST(date_trunc('week', ts) AS DATE)",
    "mau_segments": "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM {events} GROUP BY CAST(date_trunc('month', ts) AS DATE), event_type",
    "ts_gaps": "SELECT day, prior, CAST([[prior|day]] AS BIGINT) AS days FROM (SELECT day, lag(day) OVER (ORDER BY day) AS prior FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {orders}) d) t WHERE [[prior|day]] > 1",
    "ts_spikes": "SELECT day, n FROM (SELECT day, n, avg(n) OVER () AS m, stddev_pop(n) OVER () AS s FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY CAST(ts AS DATE)) d) t WHERE abs(n - m) > 1.5 * s",
    "biggest_sources": "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY source",
    # predicates of the sample applications
    "name_eq": "SELECT c_custkey, c_name FROM {customer} WHERE c_name = 'Customer#000000042'",
    "name_ieq": "SELECT c_custkey, c_name FROM {customer} WHERE lower(c_name) = lower('CUSTOMER#000000042')",
    "name_icontains": "SELECT p_partkey, p_name FROM {part} WHERE lower(p_name) LIKE '%a%'",
    "recent_rows": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00'",
    "projection_fullname": "SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment) AS full_name FROM {customer}",
    "first_match": "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 1",
    "unique_before_insert": "SELECT c.c_custkey AS c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey = c.c_custkey)",
    # values in semi-structured columns
    "top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
}


_DAYS = r"\[\[(.*?)\|(.*?)\]\]"


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(_DAYS, r"datediff(\2, \1)", SQL[name])
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def duckdb_sql(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", re.sub(_DAYS, r"date_diff('day', \1, \2)", SQL[name]))
