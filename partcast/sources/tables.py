"""Logical input tables (job / sales / purchase orders, product master, events)
expressed as projections over the driver's parquet tables.

Each logical table is a lazy projection, so Catalyst prunes the parquet columns
and pushes date / flag predicates into the scan.  On a real deployment the same
names would map to the ERP tables (JDBC with ``partitionColumn`` bounds, or a
parquet export); only this module changes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _flag(cond) -> F.Column:
    return F.when(cond, F.lit("1")).otherwise(F.lit("0"))


class Tables:
    """Entry point for every source table of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- job orders (consumption) -------------------------------------------------
    @cached_property
    def jo_txn(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            o.o_orderkey.alias("txn_id"),
            o.o_orderdate.alias("txn_date"),
            o.o_orderpriority.alias("doc_ref"),
            _flag(o.o_orderstatus == "P").alias("void"),
        )

    @cached_property
    def jo_item(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            li.l_orderkey.alias("txn_id"),
            li.l_partkey.alias("item_id"),
            li.l_suppkey.alias("stk_id"),
            li.l_quantity.alias("qty"),
            F.when(li.l_linestatus == "O", F.lit("I")).otherwise(F.lit("O")).alias("in_out"),
            _flag(li.l_returnflag == "R").alias("void"),
        )

    @cached_property
    def jo_item_dirty(self) -> DataFrame:
        """jo_item with negative and zero quantities injected (data-quality keys)."""
        li = self.raw("lineitem")
        return li.select(
            li.l_orderkey.alias("txn_id"),
            li.l_partkey.alias("item_id"),
            li.l_suppkey.alias("stk_id"),
            F.when(li.l_linenumber == 7, -li.l_quantity)
            .when(li.l_linenumber == 6, F.lit(0.0))
            .otherwise(li.l_quantity).alias("qty"),
            F.when(li.l_linestatus == "O", F.lit("I")).otherwise(F.lit("O")).alias("in_out"),
            _flag(li.l_returnflag == "R").alias("void"),
        )

    # -- sales orders -------------------------------------------------------------
    @cached_property
    def sorder_txn(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            o.o_orderkey.alias("txn_id"),
            o.o_orderdate.alias("txn_date"),
            o.o_custkey.alias("cust_id"),
            _flag(o.o_orderstatus == "P").alias("void"),
        )

    @cached_property
    def sorder_item(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            li.l_orderkey.alias("txn_id"),
            li.l_partkey.alias("item_id"),
            li.l_quantity.alias("qty"),
            _flag(li.l_returnflag == "R").alias("void"),
        )

    # -- purchase orders ----------------------------------------------------------
    @cached_property
    def porder_txn(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            o.o_orderkey.alias("txn_id"),
            o.o_orderdate.alias("txn_date"),
            F.lit("0").alias("void"),
        )

    @cached_property
    def porder_item(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            li.l_orderkey.alias("txn_id"),
            li.l_partkey.alias("item_id"),
            li.l_suppkey.alias("supp_id"),
            li.l_quantity.alias("qty"),
            F.to_date(li.l_shipdate).alias("eta_date"),
            li.l_linenumber.alias("line_no"),
            F.lit("0").alias("void"),
        )

    @cached_property
    def purchases(self) -> DataFrame:
        """Lead-time input: one row per purchase line with order / eta / receive dates."""
        t = self.porder_txn
        i = self.porder_item
        return i.join(t, "txn_id").select(
            i.item_id,
            F.to_date(t.txn_date).alias("order_date"),
            i.eta_date,
            F.date_add(i.eta_date, i.line_no - 4).alias("actual_receive_date"),
            i.supp_id.alias("supplier_id"),
            i.qty.alias("quantity"),
        )

    # -- product master -------------------------------------------------------------
    @cached_property
    def product_code(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            p.p_partkey.alias("item_id"),
            p.p_partkey.alias("stk_id"),
            p.p_brand.alias("stk_code"),
            p.p_name.alias("prod_name"),
            F.when(p.p_partkey % 17 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("deleted"),
        )

    @cached_property
    def product_code_with_gaps(self) -> DataFrame:
        """product_code with every tenth item missing (fixture of the orphan check)."""
        return self.product_code.where(F.col("item_id") % 10 != 3)

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")
