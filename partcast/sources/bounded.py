"""A Python data source that reads a Parquet table between key bounds (SURVEY 2.1: loading by
schema and bounds).

``spark.read.format("bounded").schema(...)`` reads exactly the columns of the given schema
(nothing is inferred), in ``partitions`` ranges of ``key`` between ``lower`` and ``upper``: the
first range also takes smaller and null keys, the last one larger keys, so every row is read
once whatever the bounds.  Comparisons of a column with a constant are pushed into the scan
and meet the statistics of row groups there; Spark applies all others itself.  That needs a
session that allows it (``spark.sql.python.filterPushdown.enabled``): Spark refuses a reader
that takes filters in any other, so the option ``pushdown`` ``false`` gives one that takes
none, and Spark applies every filter itself.  ``BoundedTables`` goes by the session's setting.

Files are opened by the executors through Arrow (local paths, and the stores that it knows
by their scheme); where only Spark's own readers reach a store, use ``spark.read.parquet``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)

from partcast.sources.tables import Tables

#: Rows that the scan decodes at a time.
BATCH = 16_384

_COMPARE = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class KeyRange(InputPartition):
    """Keys from ``low`` on and below ``high``; None is open (and has the null keys below)."""
    low: int | None
    high: int | None


def ranges(lower: int, upper: int, partitions: int) -> list[KeyRange]:
    """As many ranges of equal width, but no more than there are keys."""
    n = max(1, min(partitions, upper - lower + 1))
    cuts = [lower + (upper - lower + 1) * k // n for k in range(1, n)]
    return [KeyRange(lo, hi) for lo, hi in zip([None, *cuts], [*cuts, None])]


class BoundedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded"

    def schema(self):
        raise ValueError("a bounded table is read with a given schema")

    def reader(self, schema) -> "BoundedReader":
        o = self.options
        reader = BoundedReader if o.get("pushdown", "true").lower() == "true" else RangeReader
        return reader(o["path"], schema, o["key"], int(o["lower"]), int(o["upper"]), int(o.get("partitions", 1)))


class RangeReader(DataSourceReader):
    """Reads the ranges of the key; takes no filters."""

    def __init__(self, path: str, schema, key: str, lower: int, upper: int, partitions: int):
        self.path, self.schema, self.key = path, schema, key
        self.lower, self.upper, self.parts = lower, upper, partitions
        self.pushed: list[tuple[str, str, object]] = []

    def partitions(self):
        return ranges(self.lower, self.upper, self.parts)

    def condition(self, part: KeyRange):
        """The range and the pushed filters as one expression of Arrow's scan."""
        import operator

        import pyarrow.compute as pc

        does = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
        key, terms = pc.field(self.key), []
        if part.low is not None:
            terms.append(key >= part.low)
        if part.high is not None:
            terms.append((key < part.high) | key.is_null() if part.low is None else key < part.high)
        for column, op, value in self.pushed:
            c = pc.field(column)
            terms.append(c.isin(value) if op == "in" else c.is_null() if op == "null" else c.is_valid() if op == "filled" else does[op](c, value))
        out = None
        for t in terms:
            out = t if out is None else out & t
        return out

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        # one batch at a time, out of pages read as they are needed: with Arrow's defaults a task
        # decodes row groups ahead on all cores, faster than Spark takes them
        form = ds.ParquetFileFormat(default_fragment_scan_options=ds.ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False))
        scan = ds.dataset(self.path, format=form).scanner(columns=self.schema.names, filter=self.condition(partition), batch_size=BATCH,
                                                          batch_readahead=0, fragment_readahead=1, use_threads=False)
        for batch in scan.to_batches():
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in target], schema=target)


class BoundedReader(RangeReader):
    """Reads the ranges of the key, and of them what meets the pushed filters."""

    def pushFilters(self, filters):
        """Keeps the comparisons that Arrow's scan can do and hands back the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column is None or column not in self.schema.names:
                yield f
            elif type(f) in _COMPARE:
                self.pushed.append((column, _COMPARE[type(f)], f.value))
            elif isinstance(f, In):
                self.pushed.append((column, "in", list(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.pushed.append((column, "null" if isinstance(f, IsNull) else "filled", None))
            else:
                yield f


# The columns that the logical tables read, and the key that bounds each.
_LOADS = {
    "orders": ("o_orderkey", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate {ts}, o_orderpriority string"),
    "lineitem": ("l_orderkey", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber {int}, l_quantity double, l_returnflag string, "
                               "l_linestatus string, l_shipdate {ts}"),
    "part": ("p_partkey", "p_partkey bigint, p_name string, p_brand string"),
}


class BoundedTables(Tables):
    """The logical tables over bounded reads: columns by a given schema, ``parts`` ranges of the
    key between its bounds."""

    def __init__(self, spark: SparkSession, sf_dir: str, parts: int = 8):
        super().__init__(spark, sf_dir)
        self.parts = parts
        spark.dataSource.register(BoundedTable)

    def raw(self, name: str) -> DataFrame:
        if name not in _LOADS:
            return super().raw(name)
        key, columns = _LOADS[name]
        whole = super().raw(name)
        types = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
        given = [c.split() for c in columns.split(", ")]
        schema = ", ".join(f"{c} {types[c] if t.startswith('{') else t}" for c, t in given)
        lower, upper = whole.agg(F.min(key), F.max(key)).first()      # one row, the bounds
        return (self.spark.read.format("bounded").schema(schema).option("key", key).option("lower", lower or 0).option("upper", upper or 0)
                .option("partitions", self.parts).option("pushdown", self.spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).option("path", f"{self.sf_dir}/{name}.parquet").load())
