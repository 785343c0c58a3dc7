"""Registered queries of guarded SQL: users' SQL runs over the tables as views."""

from __future__ import annotations

from ..registry import query
from ..sources.tables import register_views
from .guarded_sql import RELATIONSHIPS, lint

_USER_SQL = {
    "user_sql_window": "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2",
    "user_sql_having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5",
    "user_sql_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09)",
    "user_sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    "user_sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "user_sql_union": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "user_sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "user_sql_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
}


def _user(sql: str):
    def run(spark, sf_dir):
        register_views(spark, sf_dir)
        return spark.sql(lint(spark, sql))

    return run


for _name, _sql in _USER_SQL.items():
    query(_name, _sql)(_user(_sql))


@query("table_columns", "SELECT table_name, count(*) AS n_columns FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'orders', 'lineitem', 'events') GROUP BY 1")
def table_columns(spark, sf_dir):
    register_views(spark, sf_dir)
    found = [(t, len(spark.catalog.listColumns(t))) for t in ("region", "nation", "orders", "lineitem", "events")]
    return spark.createDataFrame(found, "table_name string, n_columns long")


@query("relationships", "SELECT * FROM (VALUES " + ", ".join(map(str, RELATIONSHIPS)) + ") t(child, child_column, parent, parent_column)")
def relationships(spark, sf_dir):
    return spark.createDataFrame(list(RELATIONSHIPS), "child string, child_column string, parent string, parent_column string")
