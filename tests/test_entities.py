"""Entities and joins read all rows of their tables."""

import pyarrow.parquet as pq

from tideway import catalog
from tideway.sources.tables import Net


def test_segments_hold_all_line_items_between_two_nations(spark, sf_dir):
    column = lambda t, *names: zip(*(pq.read_table(f"{sf_dir}/{t}.parquet", columns=list(names))[n].to_pylist() for n in names), strict=True)
    supplier, customer = dict(column("supplier", "s_suppkey", "s_nationkey")), dict(column("customer", "c_custkey", "c_nationkey"))
    order = {o: customer[c] for o, c in column("orders", "o_orderkey", "o_custkey")}
    ends = [(supplier[s], order[o]) for o, s in column("lineitem", "l_orderkey", "l_suppkey")]
    ends = [(a, b) for a, b in ends if a != b]
    found = Net(spark, sf_dir).segments.groupBy("from_id", "to_id").sum("n").collect()
    assert {(r.from_id, r.to_id) for r in found} == set(ends) and sum(r["sum(n)"] for r in found) == len(ends)


def test_route_risk_news_takes_all_articles(spark):
    big = "/root/testdata/sf0.01"  # more than 200 articles
    found = catalog.queries()["route_risk_news"](spark, big).collect()
    ids = pq.read_table(f"{big}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    assert max(r.newest for r in found) > max(ids) - 7 and max(r.articles for r in found) > 0.9 * len(ids)


def test_no_view_of_the_session_is_replaced(spark, sf_dir):
    spark.range(3).createOrReplaceTempView("orders")
    assert Net(spark, sf_dir).segments.count() > 3 and spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")
