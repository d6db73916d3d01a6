import hashlib
import zlib

from partcast.llm import merkle

from .util import EDGE, cells, documents, empty, prose

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        first = i // 3 * 3
        yield level[first:i], level[i + 1:first + 3]
        i //= 3


def plain(rows):
    """The whole manifest, node by node."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([k[2] for k, _ in sorted(by_source[s], key=lambda x: x[0])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for i, (k, r) in enumerate(sorted(by_source[s], key=lambda x: x[0])):
            steps = [*way(trees[s], i), *way(top, place)]
            folded = k[2]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"]:
                folded = leaf(r, r["text"].replace("\n", ""))
            for before, after in steps:
                folded = H(*before, folded, *after)
            root = top[-1][0]
            proof = H(*(x for before, after in steps for x in (*before, *after)))
            out.append((r["doc_id"], k[2], trees[s][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_equal_to_the_tree_node_by_node(spark):
    rows = EDGE + [(k, prose(k, 5 + k % 40), f"s{k % 7 if k % 3 else 0}") for k in range(100, 320)] + [(900 + k, "é\nß", None) for k in range(4)]
    rows += [(7, "same", "copies")] * 30
    docs = documents(spark, rows)
    expected = plain(docs.collect())
    # stored rows of two levels and copies of them for four leaves each; and as in production
    assert cells(merkle.prove(docs, span=2, spread=4), *COLUMNS) == expected
    assert cells(merkle.prove(docs), *COLUMNS) == expected
    assert {r[-1] for r in expected} == {True, False}


def test_small_trees(spark):
    """Trees of few nodes side by side, a single row, many sources, no row at all."""
    sizes = documents(spark, [(100 * n + k, f"text\n{k}", f"s{n}") for n in (1, 2, 3, 4, 9, 10) for k in range(n)])
    assert cells(merkle.prove(sizes, span=1, spread=2), *COLUMNS) == plain(sizes.collect())
    one = documents(spark, [(1, "alone", None)])
    assert cells(merkle.prove(one), *COLUMNS) == plain(one.collect())
    assert merkle.prove(empty(spark)).collect() == []


def test_a_row_that_was_changed_is_found(spark):
    """Only rows that lose a line end fail, and every one of them does."""
    docs = documents(spark, [(k, "one\ntwo" if k % 2 else "one two", "a") for k in range(60)])
    for r in merkle.prove(docs).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1 or r["doc_id"] % 2 == 0)
