"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are structured random product codes: the space, after a random rotation,
falls into parts, each with a small code of random unit vectors, and every choice of one
code word a part is a direction.  A vector is list-decoded to all directions on which its
projection exceeds the cap, by sorting its projections in each part and dropping what can
no longer reach it.  Vectors are joined on (label, direction), and pairs within a filter are
verified by cosine in double precision.  The cap follows the number of vectors, by the exact
tail of a projection on the unit sphere of their dimensions, so that a filter holds a few hundred
unrelated ones at any size; filters that hold many are compared in blocks of bounded size.  A vector beyond
all caps of a code goes to the nearest direction's filter, so each has a filter in every code.

Codes are independent, so a pair shares no filter in any of k codes with the chance that it
shares none in one, to the power k.  That chance is measured on random pairs at the cosine
itself, for the cap at hand, and as many codes are taken as bring the power below MISSED.

Equal vectors of a label are one class.  A pair of classes is counted in the first filter
that both pass, so links need no list of pairs: a class comes to a filter with its vector and
its filters before that one, in one shuffle (only filters that hold many are looked up
first).  Within a filter, components are formed at once and only their links to the least
class leave it.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component,
and those with a null label, link with nothing; vectors of other lengths are compared among
their own; rows with one vec_id are vectors each, components go by the id; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partcast.llm.base import materialise
from partcast.llm.blocks import LIMIT, sides, split_groups
from partcast.llm.components import components

COSINE = 0.98
#: Caps that a vector lies in on average, in each of at least so many independent codes.
PASSED, CODES = 0.5, 4
#: The chance at most that a pair at the least cosine shares no filter.
MISSED = 1e-6
#: Random pairs, in each of so many codes, that the chance is measured on.
PAIRS, TRIED = 100, 8
#: Unrelated vectors in a filter, about.
HELD = 200
#: Code words of a part at most; more directions take more parts.
WORDS = 1024
SEED = 97
#: A cap's height at most; in few dimensions a higher one would hold nothing.
REACH = 0.8


def tail(height: float, dims: int) -> float:
    """The chance that a random unit vector's projection on a direction exceeds ``height``."""
    if dims == 1:
        return 0.5
    angles = np.linspace(0.0, math.acos(height), 4001)
    whole = math.exp(math.lgamma((dims - 1) / 2) - math.lgamma(dims / 2)) * math.sqrt(math.pi)
    return float(np.trapezoid(np.sin(angles) ** (dims - 2), angles)) / whole


def cap(vectors: int, dims: int) -> tuple[float, int, int]:
    """Height of the cap, words of a part's code, and parts.  Few parts of many words spread
    the directions best."""
    share = min(0.05, HELD / max(vectors, 1))
    lo, hi = 0.0, REACH
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid, dims) > share else (lo, mid)
    directions = PASSED / tail(lo, dims)
    parts = max(1, min(max(2, math.ceil(math.log(directions) / math.log(WORDS))), dims // 4))
    return lo, max(2, math.ceil(directions ** (1 / parts))), parts


def missed(height: float, words: int, parts: int, dims: int, cosine: float) -> float:
    """The chance (two standard errors above its measure) that a pair at ``cosine`` shares no
    filter of one code."""
    if dims == 1:
        return 0.0
    rng, none = np.random.RandomState(SEED), 0
    for which in range(TRIED):
        for _ in range(PAIRS):
            x, y = rng.normal(size=(2, dims))
            x /= np.linalg.norm(x)
            y -= (x @ y) * x
            y *= math.sqrt(max(0.0, 1 - cosine * cosine)) / np.linalg.norm(y)
            both = [decode(v, height, words, parts, which) for v in (x, cosine * x + y)]
            none += not len(np.intersect1d(*both))
    n = TRIED * PAIRS
    share = (none + 1) / (n + 2)
    return share + 2 * math.sqrt(share * (1 - share) / n)


@lru_cache(maxsize=64)
def plan(vectors: int, dims: int, cosine: float = COSINE) -> tuple[float, int, int, int]:
    """Height, words, parts, and the codes that leave a pair without a filter with a chance
    below MISSED."""
    height, words, parts = cap(vectors, dims)
    one = missed(height, words, parts, dims, cosine)
    return height, words, parts, max(CODES, math.ceil(math.log(MISSED) / math.log(one))) if one else CODES


@lru_cache(maxsize=256)
def _code(dims: int, words: int, parts: int, which: int) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.RandomState(SEED + 1000 * which + dims)
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    codes = []
    for part in np.array_split(np.arange(dims), min(parts, dims)):
        c = rng.normal(size=(words, len(part)))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(len(part) / dims))
    return rotation, codes


def decode(vector: np.ndarray, height: float, words: int, parts: int, which: int) -> np.ndarray:
    """All directions of a code on which the unit vector's projection exceeds the cap; the
    nearest direction, if it exceeds the cap on none."""
    dims = len(vector)
    rotation, codes = _code(dims, words, parts, which)
    x = rotation @ vector
    at, scores = 0, []
    for c in codes:
        scores.append(c @ x[at:at + c.shape[1]])
        at += c.shape[1]
    rest = np.cumsum([0.0] + [s.max() for s in scores[:0:-1]])[::-1]
    ids, sums = np.zeros(1, dtype=np.int64), np.zeros(1)
    for s, more in zip(scores, rest):
        total = sums[:, None] + s[None, :]
        i, j = np.nonzero(total >= height - more)
        ids, sums = ids[i] * words + j, total[i, j]
    if not len(ids):
        ids = np.array([sum(int(s.argmax()) * words ** k for k, s in enumerate(scores[::-1]))], dtype=np.int64)
    return ids


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (null if the vector takes no part)."""
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    fine = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))


def _filters(classes: DataFrame, plans: dict[int, tuple[float, int, int, int]]) -> DataFrame:
    """The classes with their filters, in ascending order; ``plans`` by the dimensions."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = []
            for v in batch.column("v"):
                x = np.array(v.as_py())
                x = x / np.abs(x).max()
                x /= np.linalg.norm(x)
                *code, codes = plans[len(x)]
                lists.append(np.sort(np.concatenate([decode(x, *code, c) * codes + c for c in range(codes)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"])

    v = classes.schema["v"].dataType.simpleString()
    return classes.mapInArrow(run, f"class long, label string, v {v}, size long, filters array<long>")


def _meet_before(earlier: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows a and b, whether each pair (a, b) shares an earlier filter."""
    row = np.repeat(np.arange(len(earlier)), [len(f) for f in earlier])
    flat = np.concatenate([*earlier, np.empty(0, dtype=np.int64)])
    found, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(a), len(b)), dtype=bool)
    shared = np.flatnonzero(times > 1)
    for at in range(0, len(shared), 2000):
        part = np.full(len(found), -1)
        part[shared[at:at + 2000]] = np.arange(len(shared[at:at + 2000]))
        mine = part[column] >= 0
        holds = np.zeros((len(earlier), len(shared[at:at + 2000])), dtype=np.float32)
        holds[row[mine], part[column[mine]]] = 1
        out |= holds[a] @ holds[b].T > 0
    return out


def compare(task, group, cosine: float):
    """Links of one task: per class the vectors that it links to here, and the least class
    of its component here.  Pairs that meet in an earlier filter are left to that."""
    import pyarrow as pa

    i, j = (x.as_py() for x in task[-2:])
    ids, size, block = (group.column(c).to_numpy() for c in ("class", "size", "block"))
    raw = [np.array(x) for x in group.column("v").to_pylist()]
    earlier = [np.array(x, dtype=np.int64) for x in group.column("earlier").to_pylist()]
    lens = np.array([len(x) for x in raw])
    counts, least = np.zeros(len(ids), dtype=np.int64), ids.copy()
    pairs = []
    for dims in np.unique(lens):
        left, right = (side[lens[side] == dims] for side in sides(block, i, j))
        units = []
        for side in (left, right):
            v = np.array([raw[k] for k in side]).reshape(len(side), dims)
            v = v / np.abs(v).max(axis=1, keepdims=True) if len(side) else v
            units.append(v / np.sqrt((v * v).sum(axis=1, keepdims=True)))
        for at in range(0, len(left), 256):
            near = units[0][at:at + 256] @ units[1].T >= cosine
            if i == j:
                near &= ids[left[at:at + 256], None] < ids[right][None, :]
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            x, y = left[at:at + 256][rows], right[columns]
            some, where = np.unique(np.concatenate([x, y]), return_inverse=True)
            met = _meet_before([earlier[k] for k in some], where[:len(x)], where[len(x):])
            p, q = np.nonzero(near[np.ix_(rows, columns)] & ~met)
            pairs.append((x[p], y[q]))
    if pairs:
        x, y = (np.concatenate(c) for c in zip(*pairs))
        np.add.at(counts, x, size[y])
        np.add.at(counts, y, size[x])
        while True:
            before = least.copy()
            np.minimum.at(least, x, least[y])
            np.minimum.at(least, y, least[x])
            if np.array_equal(before, least):
                break
    some = np.flatnonzero(counts)
    return pa.table({"class": pa.array(ids[some], pa.int64()), "n": pa.array(counts[some], pa.int64()), "least": pa.array(least[some], pa.int64())})


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """class, n (vectors of other classes linked to it), least (a class it is tied to); a row
    per class and filter in which it has links."""
    largest = classes.groupBy("label", F.size("v").alias("dims")).count().groupBy("dims").agg(F.max("count").alias("n")).collect()
    found = materialise(_filters(classes, {r["dims"]: plan(r["n"], r["dims"], cosine) for r in largest}), "filters")
    key = F.struct("label", "filter").alias("bucket")
    held = found.select("label", F.explode("filters").alias("filter")).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LIMIT)
    held = materialise(held, "filters-held")          # its size is known, so the vectors are shuffled once
    members = (found.select("class", "label", F.posexplode("filters").alias("place", "filter"), "filters", "size", "v")
               .select(key, "class", "size", "v", F.expr("slice(filters, 1, place)").alias("earlier")))
    tasks = split_groups(members, "bucket", "class", held, LIMIT, "left")
    flat = tasks.select(F.col("task.key.label").alias("label"), F.col("task.key.filter").alias("filter"), F.col("task.i").alias("i"),
                        F.col("task.j").alias("j"), "class", "size", "block", "v", "earlier")
    return flat.groupBy("label", "filter", "i", "j").applyInArrow(lambda task, group: compare(task, group, cosine),
                                                                  "class long, n long, least long")


def judge(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    rows = materialise(_usable(vectors), "vectors")
    # rows of one id and vector are copies as well; the class is named by its least id
    classes = (rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("class"), F.count("*").alias("size"))
               .select("class", "label", "v", "size"))
    classes = materialise(classes, "vector-classes")
    found = materialise(links(classes, cosine), "vector-links")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    named = (rows.join(classes.select("class", F.col("label").alias("_l"), F.col("v").alias("_v"), "size"),
                       (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left").select("vec_id", "class", "size"))
    # an id may have rows in several classes
    ids = named.where("class IS NOT NULL").select(F.col("vec_id").alias("u"), F.col("class").alias("v")).where("u <> v").distinct()
    several = ids.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("u").join(ids, "u")
    ties = found.select(F.col("class").alias("u"), F.col("least").alias("v")).unionByName(several)
    labels = components(ties, "vector-components")
    return (named.join(counts, "class", "left").join(labels, F.col("class") == F.col("node"), "left")
            .withColumn("component_id", F.coalesce("component", "class", "vec_id"))
            .select("vec_id", F.coalesce(F.col("n") + F.col("size") - 1, F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
                    "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
           label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.fine AND b.fine
      AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS least FROM v UNION SELECT l.v, r.least FROM r JOIN l ON l.u = r.node),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.node LEFT JOIN n ON v.vec_id = n.u
"""
