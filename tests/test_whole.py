"""Queries that take every row of their tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_constraints_of_every_part(spark):
    keys = {f"p{r.p_partkey}" for r in spark.read.parquet(f"{DIR}/part.parquet").collect()}
    found = entry.queries()["j4_generate_constraints_all"](spark, DIR).collect()
    assert {r.path for r in found} == keys


def test_checks_of_every_customer(spark):
    q = entry.queries()
    orders = spark.read.parquet(f"{DIR}/orders.parquet").collect()
    segment = {r.c_custkey: r.c_mktsegment for r in spark.read.parquet(f"{DIR}/customer.parquet").collect()}
    focus = lambda name: sorted(r.focus_node for r in q[name](spark, DIR).collect())
    wrong = lambda good: sorted(f"orders/{o.o_orderkey}" for o in orders if o.o_custkey in segment and segment[o.o_custkey] not in good)
    assert focus("l4_sequence_path_all") == wrong(("BUILDING", "MACHINERY"))
    assert focus("l4_node_all") == wrong(("BUILDING",))
    assert focus("l4_class_all") == sorted(f"orders/{o.o_orderkey}" for o in orders if not o.o_orderkey % 10 or o.o_custkey not in segment)
    assert focus("l4_inverse_path_all") == sorted(f"customer/{c}" for c in set(segment) - {o.o_custkey for o in orders})
    long = [o.o_custkey for o in orders if len(f"orders/{o.o_orderkey}") > 9]
    some = [f"customer/{c}" for c in segment if not 1 <= long.count(c) <= 12]
    assert focus("l4_hasvalue_qualified_all") == sorted([f"orders/{o.o_orderkey}" for o in orders if o.o_orderstatus != "F"] + some)


def test_tenth_customer_without_orders(spark, tmp_path):
    spark.read.parquet(f"{DIR}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{DIR}/orders.parquet").where("o_custkey <> 10").write.parquet(f"{tmp_path}/orders.parquet")
    assert "customer/10" in {r.focus_node for r in entry.queries()["l4_inverse_path_all"](spark, str(tmp_path)).collect()}
    assert "customer/10" in {r.focus_node for r in entry.queries()["l4_hasvalue_qualified_all"](spark, str(tmp_path)).collect()}


def test_all_switches_without_phase(spark):
    t = {(r.s, r.p, r.o) for r in spark.read.parquet(f"{DIR}/triples.parquet").collect() if r.o is not None}
    phased = {s for s, p, _ in t if p == "cim:SvSwitch.phase"}
    want = sorted((s, o) for s, p, o in t if p == "cim:SvSwitch.open" and s is not None and s not in phased)
    assert [tuple(r) for r in entry.queries()["s6_exists_order_all"](spark, DIR).collect()] == want and len(want) > 50
