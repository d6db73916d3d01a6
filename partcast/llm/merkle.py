"""Merkle manifest of a document table, with a proof of every row.

A row's leaf is a sha256 over its columns; three consecutive nodes of a source become one,
level by level, down to the source's subroot, and subroots in the same way become the root.
The built levels are stored as parent-linked rows: a stored row holds the siblings on the
way from its node to the next stored ancestor (``LEVELS`` levels of the tree, at most), and
that ancestor's key.  A recursive query starts at every leaf, ascends from stored row to
stored row, appends the siblings and folds the (perhaps tampered) hash up to the root.

Places of rows in their source come from range partitions, runs of 3**LEVELS nodes are
hashed together, so no task sees a whole source; a stored row that many leaves pass is
repeated once per ``SPREAD`` of them, so no join key is hot.  Everything between the steps
is written to the shared folder; a lost executor costs its tasks only.

Defined results: a null column counts as ``-`` and a null doc_id comes first and is never
tampered; empty and very long texts are hashed whole; rows equal in (source, doc_id) are
ordered by their leaf, and equal rows are interchangeable, each with a place of its own;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partcast.llm.base import materialise

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels between stored rows; leaves that pass one copy of a stored row.
FAN, LEVELS, SPREAD = 3, 6, 65_536
#: The tree over the subroots; the trees of sources are numbered from 0.
TOP = -1

_LINK = ("tree long, level int, idx long, hash binary, weight long, steps array<struct<before:binary,after:binary>>, "
         "up_tree long, up_level int, up_idx long, up_weight long")


def _leaf(columns: dict[str, Column]) -> Column:
    parts = []
    for c in COLUMNS:
        value = columns[c].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf of each row, and its leaf after tampering where that differs."""
    own = {c: F.col(c) for c in COLUMNS}
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0) & F.col("text").contains("\n")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _leaf(own).alias("leaf"),
                       F.when(hit, _leaf(own | {"text": F.replace("text", F.lit("\n"), F.lit(""))})).alias("changed"))


def _placed(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``idx``, their place in their group, and a table of the groups' sizes:
    rows are range-partitioned, numbered within a partition, and shifted by the counts of
    the partitions before."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    parted = materialise(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parted.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_shift"))
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"_g_{g}")), group, F.col("_part") == F.col("_p"))
    within = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = (parted.withColumn("_at", F.row_number().over(within) - 1).join(shifts, same)
           .withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_shift", *[f"_g_{g}" for g in group]))
    return out, counts.groupBy(*group).agg(F.sum("_n").alias("size"))


def _height(size: int, most: int) -> int:
    """Levels from ``size`` nodes to a single one, but ``most`` at most."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // FAN), levels + 1
    return levels


def _ascend(hashes: list[bytes], levels: int) -> tuple[bytes, list[list[dict]]]:
    """The ancestor ``levels`` above a run of nodes, and every node's siblings on the way."""
    at, nodes, steps = list(range(len(hashes))), hashes, [[] for _ in hashes]
    for _ in range(levels):
        for own, i in zip(steps, at):
            first = i - i % FAN
            own.append({"before": b"".join(nodes[first:i]), "after": b"".join(nodes[i + 1:first + FAN])})
        nodes = [hashlib.sha256(b"".join(nodes[k:k + FAN]).hex().encode()).digest() for k in range(0, len(nodes), FAN)]
        at = [i // FAN for i in at]
    return nodes[0], steps


def _stored(rows: DataFrame, level: int, extra: list[str], span: int) -> DataFrame:
    """The stored rows of one level (``extra`` columns carried) and, without siblings, their
    ancestors (marked ``is_up``).  rows: tree, idx, size (nodes of the tree at this level),
    source_no (the tree's place among the sources), weight (leaves below), hash."""
    run = FAN ** span
    types = dict(rows.dtypes)
    schema = ", ".join([_LINK, "is_up boolean, size long", *(f"{c} {types[c]}" for c in extra)])

    def emit(chunk: list[dict]) -> list[dict]:
        tree, size = chunk[0]["tree"], chunk[0]["size"]
        levels, weight = _height(size, span), sum(r["weight"] for r in chunk)
        top, steps = _ascend([r["hash"] for r in chunk], levels)
        left = -(-size // FAN ** levels)
        if left > 1:
            up = (tree, level + 1, chunk[0]["idx"] // run)
        else:
            up = (TOP, 0, tree) if tree != TOP else (None, None, None)
        common = dict(zip(("up_tree", "up_level", "up_idx"), up)) | {"up_weight": weight}
        out = [r | common | {"level": level, "steps": s, "is_up": False} for r, s in zip(chunk, steps)]
        return out + [{"tree": up[0], "level": up[1], "idx": up[2], "hash": top, "weight": weight, "is_up": True, "size": left}]

    def walk(batches):
        import pyarrow as pa
        shape = pa.schema(fields)
        chunk, out = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if chunk and (r["tree"] != chunk[0]["tree"] or r["idx"] // run != chunk[0]["idx"] // run):
                    out += emit(chunk)
                    chunk = []
                chunk.append(r)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, shape)
                out = []
        if chunk:
            out += emit(chunk)
        if out:
            yield pa.RecordBatch.from_pylist(out, shape)

    import pyarrow as pa

    arrow = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    step = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
    fields = [("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.binary()), ("weight", pa.int64()), ("steps", step),
              ("up_tree", pa.int64()), ("up_level", pa.int32()), ("up_idx", pa.int64()), ("up_weight", pa.int64()), ("is_up", pa.bool_()), ("size", pa.int64()),
              *((c, arrow[types[c]]) for c in extra)]
    spread = rows.repartition("tree", (F.col("idx") / run).cast("long")).sortWithinPartitions("tree", "idx")
    return materialise(spread.mapInArrow(walk, schema), f"level-{level}")


def _tree(rows: DataFrame, largest: int, extra: list[str], span: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored rows of all levels, and the tops (one row a tree) of the trees in ``rows``."""
    levels, tops, level = [], [], 0
    while True:
        built = _stored(rows, level, extra if level == 0 else [], span)
        levels.append(built.where("NOT is_up"))
        tops.append(built.where("is_up AND size = 1").select("idx", "hash", "weight"))
        if largest <= FAN ** span:
            return levels, reduce(DataFrame.unionByName, tops)
        rows = built.where("is_up AND size > 1").select("tree", "idx", "size", "weight", "hash")
        largest, level = -(-largest // FAN ** span), level + 1


def _climb(start: DataFrame, nodes: DataFrame, spread: int) -> DataFrame:
    """Every leaf's way to the root, by a recursive query over the stored rows."""
    spark = start.sparkSession
    a, b = (f"{name}_{uuid.uuid4().hex}" for name in ("leaves", "nodes"))
    fold = "aggregate({0}, {1}, (h, s) -> unhex(sha2(concat(lower(hex(s.before)), lower(hex(h)), lower(hex(s.after))), 256)))"
    append = "aggregate({0}, {1}, (p, s) -> concat(p, s.before, s.after))"
    slots = f"CAST(ceil(up_weight / {spread}) AS BIGINT)"
    sql = f"""
        WITH RECURSIVE climb AS (
            SELECT doc_id, idx AS place, hash AS leaf, CAST(NULL AS BINARY) AS subroot,
                   {fold.format("steps", "coalesce(changed, hash)")} AS folded, {append.format("steps", "CAST('' AS BINARY)")} AS proof,
                   up_tree, up_level, up_idx, {slots} AS slots
            FROM {a}
            UNION ALL
            SELECT c.doc_id, c.place, c.leaf, coalesce(c.subroot, IF(n.tree = {TOP}, n.hash, NULL)),
                   {fold.format("n.steps", "c.folded")}, {append.format("n.steps", "c.proof")},
                   n.up_tree, n.up_level, n.up_idx, n.slots
            FROM climb c JOIN {b} n
              ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx AND pmod(c.place, c.slots) = n.slot
        )
        SELECT doc_id, leaf, subroot, proof, folded FROM climb WHERE up_tree IS NULL"""
    # the steps of a climb are few (the log of the rows), its rows as many as the leaves
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    start.createOrReplaceTempView(a)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("weight") / spread).cast("long") - 1))
    nodes.select("tree", "level", "idx", "hash", "steps", "up_tree", "up_level", "up_idx", F.expr(slots).alias("slots"), copies.alias("slot")).createOrReplaceTempView(b)
    try:
        spark.conf.set(limit, "-1")
        return materialise(spark.sql(sql), "climb")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)
        spark.catalog.dropTempView(a)
        spark.catalog.dropTempView(b)


def manifest(docs: DataFrame, span: int = LEVELS) -> tuple[DataFrame, DataFrame, bytes | None]:
    """The stored rows of the leaves and of the levels above them, and the root (null for an
    empty table)."""
    rows, sizes = _placed(materialise(leaves(docs), "leaves"), ["source"], ["doc_id", "leaf"])
    sizes = materialise(sizes, "sources")
    sources, _ = _placed(sizes, [], ["source"])
    sources = materialise(sources.select(F.col("source").alias("_source"), F.col("idx").alias("tree"), "size"), "trees")
    shape = sources.agg(F.count(F.lit(1)), F.max("size")).first()       # one row
    rows = (rows.join(sources, F.col("source").eqNullSafe(F.col("_source")))
            .select("tree", "idx", "size", F.lit(1).cast("long").alias("weight"), F.col("leaf").alias("hash"), "doc_id", "changed"))
    levels, subroots = _tree(rows, shape[1] or 1, ["doc_id", "changed"], span)
    above, tops = _tree(subroots.select(F.lit(TOP).cast("long").alias("tree"), "idx", F.lit(shape[0]).cast("long").alias("size"), "weight", "hash"), shape[0] or 1, [], span)
    root = tops.first()                                                 # one row
    return levels[0], reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [*levels[1:], *above]), root["hash"] if root else None


def prove(docs: DataFrame, span: int = LEVELS, spread: int = SPREAD) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    start, nodes, root = manifest(docs, span)
    text = lambda c: F.lower(F.hex(c))
    top = F.lit(root.hex() if root else None).cast("string")
    return _climb(start, nodes, spread).select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), top.alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == top).alias("verified"))


def _oracle() -> str:
    """The manifest node by node: trees level by level, then a climb from every leaf."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("id", "source", "lang", "size", text)) + ")"
    # the last bit of crc32, bit by bit: a byte is added, then shifted out eight times
    crc = ("list_reduce([4294967295] || flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(substr(id, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])), "
           "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)")
    siblings = """coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h, 1) OVER w, '') AS before, coalesce(lead(h, 1) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS after"""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS id, source, lang, CAST(n_chars AS VARCHAR) AS size, text,
                            replace(text, chr(10), '') AS cut FROM documents),
l AS (SELECT rid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf("text")} AS leaf,
             CASE WHEN id IS NOT NULL AND ({crc}) & 1 = 1 THEN {leaf("cut")} ELSE {leaf("text")} END AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
lv AS (SELECT tree, 0 AS lvl, idx, leaf AS h, n FROM p
       UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY tree, lvl, idx // 3, n),
sr AS (SELECT tree, h FROM lv WHERE n = 1),
tv AS (SELECT 0 AS lvl, tree AS idx, h, (SELECT count(*) FROM sr) AS n FROM sr
       UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM tv WHERE n > 1 GROUP BY lvl, idx // 3, n),
ls AS (SELECT tree, lvl, idx, {siblings} FROM lv WHERE n > 1 WINDOW w AS (PARTITION BY tree, lvl, idx // 3 ORDER BY idx)),
ts AS (SELECT lvl, idx, {siblings} FROM tv WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // 3 ORDER BY idx)),
up AS (SELECT rid, tree, 0 AS lvl, idx, changed AS folded, '' AS proof FROM p
       UNION ALL SELECT u.rid, u.tree, u.lvl + 1, u.idx // 3, sha256(s.before || u.folded || s.after), u.proof || s.before || s.after
       FROM up u JOIN ls s ON u.tree = s.tree AND u.lvl = s.lvl AND u.idx = s.idx),
high AS (SELECT rid, tree, max(lvl) AS lvl FROM up GROUP BY rid, tree),
tup AS (SELECT u.rid, 0 AS lvl, u.tree AS idx, u.folded, u.proof FROM up u JOIN high m ON u.rid = m.rid AND u.lvl = m.lvl
        UNION ALL SELECT u.rid, u.lvl + 1, u.idx // 3, sha256(s.before || u.folded || s.after), u.proof || s.before || s.after
        FROM tup u JOIN ts s ON u.lvl = s.lvl AND u.idx = s.idx),
top AS (SELECT rid, max(lvl) AS lvl FROM tup GROUP BY rid),
root AS (SELECT h FROM tv WHERE n = 1)
SELECT p.doc_id, p.leaf, sr.h AS subroot, (SELECT h FROM root) AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root,
       u.folded = (SELECT h FROM root) AS verified
FROM p JOIN sr ON p.tree = sr.tree JOIN top ON p.rid = top.rid JOIN tup u ON u.rid = top.rid AND u.lvl = top.lvl
"""


ORACLE = _oracle()
