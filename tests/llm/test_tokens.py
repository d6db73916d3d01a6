import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from partcast.llm import packing, token_counts, token_files
from partcast.llm.tokens import Encoder, tokenizer_path

from .util import EDGE, cells, documents, empty, prose

ENC = Encoder()


def library(text):
    from tokenizers import Tokenizer

    if not hasattr(library, "t"):
        library.t = Tokenizer.from_file(tokenizer_path())
    return library.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\rabEé1½2._!'s—‘\u00a0\x1c中|<", max_size=40), max_size=6))
def test_encoder_is_the_library(texts):
    assert [x.tolist() for x in ENC.encode(texts)] == [library(t) for t in texts]


def test_encoder_contractions_special_strings_and_long_words():
    texts = ["it's we'll don't 's", "<|endoftext|> in text", "x" * 20_000, None, "", "a  b   c \n\n d", prose(3, 400)]
    assert [x.tolist() for x in ENC.encode(texts)] == [library(t) for t in texts]


def test_planes_round_trip():
    ids = np.array([0, 1, 50256, 2**32 - 1, 77] * 123, dtype="<u4")
    for bits in (1, 8):
        assert (token_files.from_planes(token_files.to_planes(ids, bits), len(ids), bits) == ids).all()


def test_files_round_trip(spark):
    docs = documents(spark, EDGE + [(k, prose(k, 300)) for k in range(10, 40)] + [(41, prose(1, 40_000))])
    path_rows = cells(token_files.round_trip(docs), "doc_id", "start", "n_tokens", "ids_crc32")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for doc_id, text in rows:
        ids = library(text) + [0]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert path_rows == sorted(want, key=repr)
    assert token_files.round_trip(empty(spark)).count() == 0


def test_chunk_index(spark, tmp_path):
    docs = documents(spark, [(k, prose(k, 500)) for k in range(30)])
    token_files.write_ids(docs, f"file://{tmp_path}/ids", block=1000, bits=1)
    index = token_files.chunk_index(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    total = sum(len(library(prose(k, 500))) + 1 for k in range(30))
    assert sum(r["n_ids"] for r in index) == total
    assert [r["start"] for r in index] == list(np.cumsum([0] + [r["n_ids"] for r in index[:-1]]))
    got = cells(token_files.read_documents(spark, f"file://{tmp_path}/ids"), "doc_id", "ids_crc32")
    assert got == sorted(((k, crc(library(prose(k, 500)) + [0])) for k in range(30)), key=repr)


def test_counts(spark):
    docs = documents(spark, EDGE + [(k, prose(k, 10 * k)) for k in range(10, 40)])
    sums = token_counts.with_sums(token_counts.histogram(docs, end_tokens=1))
    lens = [len(library(r["text"])) + 1 for r in docs.collect()]
    n = len(lens)
    want = [(x, c, x * c, sum(y >= x for y in lens), sum(y for y in lens if y >= x), sum(min(x, y) for y in lens), sum(y <= x for y in lens) / n)
            for x, c in Counter(lens).items()]
    assert cells(sums) == sorted(want, key=repr)
    for limit in (0, 17, 333, 10**6):
        r = token_counts.truncated_total(sums, limit).first()
        assert (r["docs_over"], r["truncated_total"]) == (sum(y > limit for y in lens), sum(min(limit, y) for y in lens))
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(lens)[-(-n // 2) - 1]
    assert token_counts.with_sums(token_counts.histogram(empty(spark))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 200), st.dictionaries(st.integers(1, 200), st.integers(1, 300), max_size=40))
def test_plan_packs_all_and_no_more_than_fits(capacity, counts):
    counts = {min(k, capacity): v for k, v in counts.items()}
    out = packing.plan(counts, capacity)
    back = Counter()
    for n, lengths in out:
        assert n > 0 and 0 < sum(lengths) <= capacity
        for x in lengths:
            back[x] += n
    assert back == Counter(counts)
    used, total = sum(n for n, _ in out), sum(k * v for k, v in counts.items())
    assert used <= 2 * (total // capacity) + 2       # any fit stays below twice the bound


def exact(lengths, capacity):
    """Least number of sequences, by search."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[k]:
                i = rooms.index(r)
                go(k + 1, rooms[:i] + [r - lengths[k]] + rooms[i + 1:])
        go(k + 1, rooms + [capacity - lengths[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(120):
        capacity = rng.choice([10, 20, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_by_dominance(dict(Counter(lengths)), capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + exact(left, capacity) == exact(lengths, capacity), (lengths, capacity)


def test_pack_documents(spark):
    docs = documents(spark, EDGE + [(k, prose(k, 37 * (k % 60))) for k in range(10, 300)])
    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for d in docs.collect():
        ids = library(d["text"]) + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want[d["doc_id"]] += [(k, i, j - i, crc(ids[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 1024) * 1.05 + 1
    assert packing.pack_documents(empty(spark)).count() == 0
