"""Registered queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from partcast.operators import extract as X
from partcast.operators import reshape as R
from partcast.plans import cat_reshape  # noqa: F401  (top_fixed CTE)
from partcast.plans.registry import P, register
from partcast.plans.sqlkit import sql
from partcast.sources import files as IO
from partcast.sources.bounded import BoundedTables

# The logical tables and their columns (n number, d day, t text).
LOGICAL = {
    "jo_txn": "txn_id:n txn_date:d doc_ref:t void:t", "jo_item": "txn_id:n item_id:n stk_id:n qty:n in_out:t void:t",
    "sorder_txn": "txn_id:n txn_date:d cust_id:n void:t", "sorder_item": "txn_id:n item_id:n qty:n void:t",
    "porder_txn": "txn_id:n txn_date:d void:t", "porder_item": "txn_id:n item_id:n supp_id:n qty:n eta_date:d line_no:n void:t",
    "product_code": "item_id:n stk_id:n stk_code:t prod_name:t deleted:t",
}
_AS_NUMBER = {"n": "{0}", "d": "date_diff('day', DATE '1970-01-01', CAST({0} AS DATE))", "t": "length({0})"}


@register("scan_tables", sql("\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, CAST(sum({_AS_NUMBER[k].format(c)}) AS DOUBLE) AS total FROM {n}"
    for n, columns in LOGICAL.items() for c, k in (x.split(":") for x in columns.split())), *LOGICAL))
def _scan_tables(t):
    """What the seven tables hold, read by schema and key bounds."""
    bounded = BoundedTables(t.spark, t.sf_dir)
    return IO.contents({n: getattr(bounded, n) for n in LOGICAL}).withColumnRenamed("sheet", "table_name")


@register("scan_coerce", sql("""
SELECT i.txn_id, i.item_id, COALESCE(TRY_CAST(CAST(i.qty AS VARCHAR) AS DOUBLE), 0.0) AS qty,
       COALESCE(TRY_CAST(t.doc_ref AS DOUBLE), 0.0) AS doc_ref, CAST(CAST(t.txn_date AS VARCHAR) AS DATE) AS txn_date
FROM jo_item i JOIN jo_txn t ON i.txn_id = t.txn_id""", "jo_item", "jo_txn"))
def _scan_coerce(t):
    # Cursor-style text rows: quantities and document refs arrive as text.
    rows = (t.jo_item.select("txn_id", "item_id", F.col("qty").cast("string").alias("qty"))
            .join(t.jo_txn.select("txn_id", "doc_ref", F.col("txn_date").cast("string").alias("txn_date")), "txn_id"))
    return IO.parse_dates(IO.coerce_numeric(rows, ["qty", "doc_ref"]), ["txn_date"])


@register("csv_roundtrip", sql("SELECT item_id, ds, qty FROM parts_dense", "parts_dense"))
def _csv_roundtrip(t):
    return IO.csv_roundtrip(X.jo_series(t, P), "jo_series")


@register("wide_import", sql("SELECT item_id, ds, qty FROM top_fixed", "top_fixed"))
def _wide_import(t):
    wide = R.pivot_items(t, P)
    path = IO.write_csv(wide, IO.io_path(t.spark, "pivot_top"))
    return IO.wide_import(t.spark, path)


@register("sample_export", sql("""
SELECT item_id, ds, txn_id AS job_id, COALESCE(sum(qty), 0.0) AS consumption
FROM win_lines GROUP BY item_id, ds, txn_id ORDER BY ds, item_id, job_id LIMIT 100""", "win_lines"))
def _sample_export(t):
    return IO.sample_export(X.jo_consumption(t, P), ["ds", "item_id", "job_id"], 100, "jo_consumption")
