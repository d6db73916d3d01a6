"""Near-duplicate documents: universal hash minima, banding, verification, components.

1. Each document's set of word shingles gives 128 minima of universal hashes (multiply and
   add, modulo 2^64); 4 minima are a band, 32 bands a document.  Documents with one set
   (by a digest of all its shingles) are one class from here on, its least doc_id standing
   for it, so copies, however many, are one row.
2. Classes that share a band meet in its group.  Every member is compared with the group's
   least by signature; those that agree enough are tied, and the components of these ties are
   clusters.  The full sets of a cluster come together (in blocks of bounded size), where an
   inverted list of their shingles gives every pair's exact similarity; what leaves the task
   is each class's least linked class, not its pairs.
3. Pairs of different clusters that share a band group are compared by signature, again in
   blocks; the few that agree are confirmed on full sets.

At a similarity of 0.75 a pair misses all bands with a chance of 5e-6, and the signature
bound (0.58) with one of 3e-6.

Defined results: null or empty texts, and those without a word, have an empty set, link with
nothing and are kept; very long texts are shingled whole; of equally similar documents none
comes first, links are kept and the least doc_id stays; fewer words than a shingle are one shingle; rows with one doc_id are
one document, linked by any of their texts; rows with a null doc_id take no part (component
null, kept); an empty table gives no rows; extra columns are not read by ``judge`` and kept
by ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partcast.llm.base import materialise, unwrapped, whole_rows
from partcast.llm.blocks import sides, split_groups
from partcast.llm.components import components

SHINGLE = 5
SIMILARITY = 75           # percent
BANDS, ROWS = 32, 4
SIGNATURE_BOUND = 0.58
CHUNK = 4096
#: Shingles that count as much as a class in a block's size.
WEIGHT = 1000

_rng = np.random.RandomState(20240501)
_A = (_rng.randint(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.randint(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64)
_WORD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    k = min(size, n)
    out = np.full(n - k + 1, n if n < size else 0, dtype=np.uint64)
    for i in range(k):
        out = (out ^ _mix(h[i:n - k + 1 + i])) * _WORD[i % len(_WORD)]
        out ^= out >> np.uint64(32)
    return np.unique(_mix(out))


def minima(sets: np.ndarray) -> np.ndarray:
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sets), CHUNK):
        np.minimum(best, (sets[at:at + CHUNK, None] * _A + _B).min(axis=0), out=best)
    return best


def signature(sets: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys (signed 64-bit), and one byte of each minimum."""
    low = minima(sets)
    mixed = _mix(low)
    rows = mixed.reshape(BANDS, ROWS)
    key = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(ROWS):
        key = _mix(key ^ rows[:, i])
    return key.view(np.int64), (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def signed(docs: DataFrame) -> DataFrame:
    """One row per document: size and digest of its set, band keys, signature."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = shingles(text.as_py())
                if len(s):
                    bands, sig = signature(s)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands, sig))
                else:
                    rows.append((0, None, None, None))
            n, digest, bands, sig = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from byte signatures (rows), less chance agreement."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree enough."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                agree = estimate(_matrix(batch.column(2)), _matrix(batch.column(3))) >= SIGNATURE_BOUND
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(agree))

    x, y = (reps.select(F.col("rep").alias(k), F.col("signature").alias(f"s{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, shingles (sorted 64-bit hashes as binary) of the classes in ``ids`` (rep)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                                              pa.array(sets, pa.binary())], names=["doc", "digest", "shingles"])

    named = reps.join(ids, "rep", "left_semi").select("rep", "doc", "digest")
    found = (docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
             .join(named, "doc", "left_semi").mapInArrow(run, "doc long, digest binary, shingles binary"))
    # a doc_id may have rows with other texts
    return found.join(named, ["doc", "digest"]).select("rep", "shingles").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, label: str) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by their full sets."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs.select("a", "b"), f"{label}-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = materialise(_sets(docs, ids, reps), f"{label}-sets")
    x, y = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"s{k}")) for k in ("a", "b"))
    return materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), f"{label}-links")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, a later one of ``right``) that are similar enough, by an
    inverted list of the shingles that two sets or more have."""
    size = np.array([len(s) for s in sets])
    shingle, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[where] > 1
    where, owner = where[shared], owner[shared]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    lists = owner[np.argsort(where, kind="stable")]
    count = np.bincount(where, minlength=len(shingle))
    begin = np.cumsum(count) - count
    later, x, y = np.zeros(len(sets), dtype=bool), [], []
    later[right] = True
    both_sides = np.isin(left, right).any()
    for k in left:
        mine = where[first[k]:first[k + 1]]
        n = count[mine]
        at = np.repeat(begin[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        common = np.bincount(lists[at], minlength=len(sets))
        near = (100 * common >= SIMILARITY * (size[k] + size - common)) & later
        near[:k + 1] &= not both_sides
        near[k] = False
        near = np.flatnonzero(near)
        x.append(np.full(len(near), k))
        y.append(near)
    return np.concatenate(x), np.concatenate(y)


def _ties(clusters: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: per class of a cluster and task, the least class of its component there."""
    def run(key, group):
        import pyarrow as pa

        rep, block = group.column("rep").to_numpy(), group.column("block").to_numpy()
        least = rep.copy()
        left, right = sides(block, key[1].as_py(), key[2].as_py())
        if len(left) and len(right):
            x, y = linked([np.frombuffer(v.as_py(), dtype=np.uint64) for v in group.column("shingles")], left, right)
            while True:
                before = least.copy()
                np.minimum.at(least, x, least[y])
                np.minimum.at(least, y, least[x])
                if np.array_equal(before, least):
                    break
        some = np.flatnonzero(least != rep)
        return pa.table({"a": pa.array(least[some], pa.int64()), "b": pa.array(rep[some], pa.int64())})

    named = clusters.join(reps.select("rep", "n_shingles"), "rep")
    sizes = named.groupBy("cluster").agg(F.greatest(F.count("*"), F.sum("n_shingles") / WEIGHT).alias("n"))
    tasks = split_groups(named.select("rep", "cluster"), "cluster", "rep", sizes).join(sets, "rep")
    flat = tasks.select(F.col("task.key").alias("cluster"), F.col("task.i").alias("i"), F.col("task.j").alias("j"), "rep", "block", "shingles")
    return flat.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _cross_pairs(members: DataFrame, reps: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs (a, b) of different clusters that share a group and whose signatures agree."""
    def run(key, group):
        import pyarrow as pa

        i, j = key[1].as_py(), key[2].as_py()
        rep, cluster, block = (group.column(c).to_numpy() for c in ("rep", "cluster", "block"))
        sig = _matrix(group.column("signature"))
        left, right = sides(block, i, j)
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for k in left:
            other = right[cluster[right] != cluster[k]]
            if i == j:
                other = other[rep[other] > rep[k]]
            near = other[estimate(sig[other], sig[k]) >= SIGNATURE_BOUND]
            a.append(np.full(len(near), rep[k]))
            b.append(rep[near])
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    named = members.join(clusters, "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    open_keys = (named.groupBy("key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count("*").alias("n"))
                 .where("lo <> hi").select("key", "n"))
    tasks = split_groups(named, "key", "rep", open_keys).join(reps.select("rep", "signature"), "rep")
    flat = tasks.select(F.col("task.key").alias("key"), F.col("task.i").alias("i"), F.col("task.j").alias("j"), "rep", "cluster", "block", "signature")
    return flat.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    rows = materialise(signed(docs), "signed")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class has a number of its own, as one doc_id may have several
    reps = materialise(some.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n_shingles"),
                                                  F.min_by("bands", "doc_id").alias("bands"),
                                                  F.min_by("signature", "doc_id").alias("signature"))
                       .withColumn("rep", F.monotonically_increasing_id()), "classes")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last")
    members = materialise(keyed.join(shared, "key").select("key", "rep", "pivot"), "band-groups")

    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    clusters = components(_agreeing(stars, reps), "clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clusters = materialise(clusters, "clusters")
    sets = materialise(_sets(docs, clusters.select("rep"), reps), "sets")
    links = _ties(clusters, reps, sets)
    links = links.unionByName(_confirmed(_cross_pairs(members.select("key", "rep"), reps, clusters), docs, reps, "cross"))
    x, y = (reps.select(F.col("rep").alias(k), F.col("doc").alias(f"doc_{k}")) for k in ("a", "b"))
    links = links.join(x, "a").join(y, "b").where("doc_a <> doc_b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    # documents with several texts
    several = (some.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
               .join(some, "doc_id").join(reps.select("digest", "doc"), "digest").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")))
    labels = components(links.unionByName(several), "components").withColumnRenamed("node", "doc")

    classes = reps.select("digest", "doc").join(labels, "doc", "left").select("digest", F.coalesce("component", "doc").alias("component"))
    return (rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one with the least doc_id, and of
    rows with one doc_id that whose text is first.  All columns as they are."""
    judged = judge(docs)
    repeated = (judged.where("doc_id IS NOT NULL AND kept").groupBy("doc_id").agg(F.count("*").alias("n"))
                .where("n > 1").select(F.col("doc_id").alias("id")))
    repeated = materialise(repeated, "repeated-ids")
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("id")).distinct().unionByName(repeated)
    rows, here = whole_rows(docs), F.col("doc.doc_id") == F.col("id")
    first = W.partitionBy("doc.doc_id").orderBy("doc.text", F.xxhash64("doc"))
    one = rows.join(repeated, here, "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return unwrapped(rows.join(gone, here, "left_anti").unionByName(one), docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT l.v, r.least FROM r JOIN l ON l.u = r.node),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON d.doc_id = c.node LEFT JOIN n ON d.doc_id = n.doc_id
"""
