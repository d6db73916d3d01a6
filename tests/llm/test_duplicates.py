import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from partcast.llm import embeddings, near_duplicates, suffix_dedup
from partcast.llm.components import components

from .util import EDGE, cells, documents, empty, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def edited(text, share, seed):
    words, rng = text.split(), random.Random(seed)
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def near_rows():
    rows = [(k, prose(k, 150)) for k in range(100, 130)]
    for base, share in ((100, 0.0), (101, 0.01), (102, 0.02), (103, 0.03), (104, 0.05)):
        rows += [(1000 + 50 * base + k, edited(prose(base, 150), share, k)) for k in range(25)]
    return rows + [(9000 + k, "Short Text here") for k in range(3)] + [(9010, "short text HERE")]


def test_near_duplicates_against_all_pairs(spark):
    rows = [r for r in EDGE if r[0] is not None] + near_rows()
    got = {}
    for r in near_duplicates.judge(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    least = least_reachable(sets, links)
    assert got == {i: {(len(s), least[i], least[i] == i)} for i, s in sets.items()}


def test_keep_leaves_one_of_each_group(spark):
    rows = EDGE + near_rows()
    docs = documents(spark, rows)
    out = near_duplicates.keep(docs)
    assert out.columns == docs.columns
    judged = near_duplicates.judge(docs)
    want = {r["doc_id"] for r in judged.collect() if r["kept"]}
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want and None in want
    assert near_duplicates.keep(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == {n: c for n, c in least_reachable({n for e in edges for n in e}, edges).items() if n in nodes}


def cut_brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for p in range(len(t) - 49):
            if i is not None:
                first[t[p:p + 50]] = min(i, first.get(t[p:p + 50], i))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if i is not None and first[t[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1, 4000])
def test_passages_go_as_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "RANGE_KEYS", 2_000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    common, passage = "a very common line that every second document carries\n", prose(77, 60)
    rows = list(EDGE)
    for k in range(100, 150):
        text = prose(k, 120)
        rows.append((k, text[:200] + (common if k % 2 else "") + text[200:400] + (passage if k % 5 == 0 else "") + text[400:]))
    rows += [(200 + k, prose(100, 120)) for k in range(5)] + [(210, passage[:49]), (211, passage[:50]), (212, passage[3:60]), (213, "é" * 60), (214, "é" * 40 + "x")]
    got = suffix_dedup.judge(documents(spark, rows))
    assert cells(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_brute(rows)
    assert suffix_dedup.judge(empty(spark)).count() == 0


def test_longest_previous_factors_by_brute_force():
    rng = np.random.RandomState(3)
    for letters, n, docs in ((2, 400, 5), (2, 400, 40), (3, 300, 1), (1, 120, 7), (26, 200, 3)):
        data = rng.randint(97, 97 + letters, n).astype(np.uint8)
        of = np.sort(rng.randint(0, docs, n))
        match = 12
        places = np.array([p for p in range(n - match + 1) if of[p] == of[p + match - 1]], dtype=np.int64)
        rng.shuffle(places)
        names = rng.permutation(docs)[of]                  # documents in no order
        words = {p: data[p:p + match].tobytes() for p in places.tolist()}

        def shared(a, b):
            return next((k for k in range(match) if a[k] != b[k]), match)

        want = [max([shared(words[p], words[q]) for q in places.tolist() if names[q] < names[p]], default=0) for p in places.tolist()]
        got = suffix_dedup.longest_previous_factors(data, places, names[places], match, 1)
        assert got.tolist() == want
        cut = suffix_dedup.longest_previous_factors(data, places, names[places], match, match)
        assert (cut >= match).tolist() == [w >= match for w in want]


def test_rows_of_a_bucket_in_any_order():
    """Steps of a bucket agree on its pieces though a shuffle's rows come in any order."""
    import pyarrow as pa

    rows = [(7, "b" * 60), (7, "a" * 60), (None, "c"), (2, None), (1, prose(3, 40))]
    def bucket(order):
        b = suffix_dedup.Bucket(pa.table({"doc_id": pa.array([rows[i][0] for i in order], pa.int64()), "text": pa.array([rows[i][1] for i in order], pa.string())}), 50)
        plan = suffix_dedup.make_plan(1000)
        p, several, many = suffix_dedup._pieces(b, np.full(len(b.keys), suffix_dedup.SEVERAL, dtype=np.uint8), plan)
        return p.text, p.least.tolist(), p.task.tolist(), [x.tolist() for x in several + many]
    assert bucket([0, 1, 2, 3, 4]) == bucket([4, 3, 2, 1, 0]) == bucket([2, 0, 4, 1, 3])


def test_kept_text(spark):
    text = prose(5, 100)
    got = {r["doc_id"]: bytes(r["kept_text"]).decode() for r in suffix_dedup.dedup(documents(spark, [(1, text), (2, "head " + text + " tail")])).collect()}
    assert got == {1: text, 2: "head  tail"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, size string, class string")


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for k in range(6):
            base = rng.normal(size=24)
            for j in range(8):
                v = base + rng.normal(size=24) * (0.0 if j < 2 else 0.1 if j < 6 else 0.17)
                rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan")] + [1.0] * 23, 0), (n + 4, [None] + [1.0] * 23, 0),
             (n + 5, [float("inf")] + [1.0] * 23, 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [1e-30, 2e-30], 0), (0, rows[0][1], 0)]
    got = cells(embeddings.judge(vectors(spark, [(*r, "own", "own") for r in rows])), "vec_id", "n_links", "component_id", "kept")
    usable = [(i, np.array(v, dtype=float), c) for i, v, c in rows
              if c is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    unit = [(i, v / np.abs(v).max(), c) for i, v, c in usable]
    unit = [(i, v / np.linalg.norm(v), c) for i, v, c in unit]
    links, count = [], [0] * len(unit)
    for a, b in itertools.combinations(range(len(unit)), 2):
        if unit[a][2] == unit[b][2] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98:
            links.append((unit[a][0], unit[b][0]))
            count[a] += 1
            count[b] += 1
    least = least_reachable({r[0] for r in rows}, links)
    counts = [(u[0], c) for u, c in zip(unit, count)]
    counts += [(r[0], 0) for r in rows[:-1] if r[0] not in {u[0] for u in unit}]
    assert got == sorted(((i, c, least[i], least[i] == i) for i, c in counts), key=repr)
    assert embeddings.judge(vectors(spark, [])).count() == 0


def test_blocks_of_a_large_filter_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIMIT", 7)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(k, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.02], 1, "", "") for k in range(60)]
    got = embeddings.judge(vectors(spark, rows)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(59, 0)}


def test_pairs_share_a_filter_at_any_number_of_vectors():
    rng = np.random.default_rng(5)
    for vectors in (5_000, 12_000_000):
        for _ in range(150):
            x, y = rng.normal(size=(2, 64))
            x /= np.linalg.norm(x)
            y -= (x @ y) * x
            y = 0.98 * x + y * math.sqrt(1 - 0.98**2) / np.linalg.norm(y)
            height, words, parts, codes = embeddings.plan(vectors, 64)
            assert any(np.intersect1d(*(embeddings.decode(v, height, words, parts, c) for v in (x, y))).size for c in range(codes))
    assert abs(embeddings.tail(0.5, 3) - 0.25) < 1e-6


def test_texts_of_one_doc_id_are_linked_each(spark):
    other, text = prose(100, 150), prose(101, 150)
    rows = [(5, text), (5, other), (7, edited(other, 0.01, 1)), (8, edited(text, 0.01, 2)), (9, prose(102, 150))]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates.judge(documents(spark, rows)).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 9)}


def test_tables_of_null_ids_only(spark):
    rows = [(None, prose(1, 60)), (None, prose(1, 60)), (None, None)]
    got = suffix_dedup.judge(documents(spark, rows))
    assert cells(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_brute(rows)
    assert near_duplicates.keep(documents(spark, rows)).count() == 3
