"""Removal of repeated passages: longest previous factors across documents.

A byte goes if a string of ``match`` (50) bytes that covers it also starts in a document
with a smaller doc_id, that is, if the longest previous factor, over smaller documents, of
some suffix up to 49 bytes before it is at least 50.

Suffixes cannot all be sorted in one place, so they are first brought near each other.
Every 50-byte window is keyed by the least hash among its 16-byte strings; equal windows
have equal keys.  A run of neighbouring windows with one key is a segment.  Documents fall
into buckets of bounded size, a task each, and what leaves a bucket is combined there:

1. Shortened keys of every bucket meet by key range; a bucket learns by a bit for each key
   whether another bucket has it as well.
2. The shared keys meet again in full, with a 128-bit BLAKE2 digest of their segments and the
   least and greatest document.  Where all segments of a key are one string, the longest
   previous factors are those of that string's first document, which settles it.
3. Of the other keys the segments themselves meet.  There their suffixes are put in order, with
   the common bytes of neighbours; the previous and next smaller positions (nearest suffixes of
   smaller documents before and after) give the longest previous factor of each, and the
   bucket gets a bit that says whether it reaches 50.  A key with very many segments is split
   by the hashes of its windows.
4. Each bucket marks its matches and cuts its documents.

All of it is one plan: the documents are shuffled once, into as many partitions as there are
buckets, and Spark uses that shuffle again in every step.  A lost executor's part is
recomputed from the input.

Defined results: null texts are empty; documents under 50 bytes stay whole; very long texts are
searched whole, segment by segment; rows with a null
doc_id are neither searched nor sources; rows with one doc_id don't count as earlier than each
other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = 50
GRAM = 16                       # bytes of a hashed string; a power of two
BUCKET_BYTES = 8_000_000       # text of a bucket
RANGE_KEYS = 1_000_000          # keys of a key range, from all buckets
HOT = 4000                      # segments of a key beyond which it is split by windows
CHUNK = 250_000                 # bytes hashed at a time

_rng = np.random.RandomState(5417)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.randint(0, 2**63, 4, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


# --- arrays as compressed byte planes -------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    import zstandard

    wide = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.T).tobytes())


def unpack(raw: bytes, n: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, 8 * n)), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values as their steps."""
    return pack(np.diff(values.astype(np.int64), prepend=np.int64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(raw, n))


# --- segments -------------------------------------------------------------------------

@dataclass
class Segments:
    """Segments of a bucket: document (row), first byte there, windows and key."""
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray


def _segments_of(data: np.ndarray, ends: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: first byte, windows and key of each segment."""
    n = len(data)
    h, width, levels = _BYTE[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _STEP[levels] + h[width:]
        width, levels = 2 * width, levels + 1
    low, span, grams = _mix(h) >> np.uint64(1), 1, match - GRAM + 1
    while 2 * span <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < grams:
        low = np.minimum(low[:len(low) - (grams - span)], low[grams - span:])
    begins = np.concatenate([[0], ends[:-1]])
    valid = np.ones(n - match + 1, dtype=bool)
    for e in ends[:-1]:
        valid[max(0, e - match + 1):e] = False
    first = np.empty(len(valid), dtype=bool)
    first[0] = True
    np.not_equal(low[1:], low[:-1], out=first[1:])
    first[begins[begins < len(valid)]] = True
    first[1:] |= ~valid[:-1]
    at = np.flatnonzero(first | ~valid)
    windows = np.diff(np.append(at, len(valid)))
    own = valid[at]
    at, windows = at[own], windows[own]
    return at, windows, (_mix(low[at]) >> np.uint64(1)).astype(np.int64)      # least hashes are small; mixed, they fill all ranges


def segments(texts: list[bytes], rows: np.ndarray, match: int = MATCH) -> Segments:
    """Segments of the texts with these row numbers."""
    out = []
    long = [i for i in rows.tolist() if len(texts[i]) >= match]
    at = 0
    while at < len(long):
        part, size = [], 0
        while at < len(long) and (not part or size + len(texts[long[at]]) <= CHUNK):
            part.append(long[at])
            size += len(texts[long[at]])
            at += 1
        ends = np.cumsum([len(texts[i]) for i in part])
        place, windows, key = _segments_of(np.frombuffer(b"".join(texts[i] for i in part), dtype=np.uint8), ends, match)
        k = np.searchsorted(ends, place, side="right")
        out.append((np.array(part)[k], place - np.concatenate([[0], ends[:-1]])[k], windows, key))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, dtype=np.int64)] * 4
    return Segments(*columns)


# --- a bucket's own view --------------------------------------------------------------

class Bucket:
    """The documents of a bucket and what its segments say of each key."""

    def __init__(self, table, match: int):
        ids = table.column("doc_id")
        self.match = match
        texts = [x.as_py().encode() if x.is_valid else b"" for x in table.column("text")]
        # a shuffle's rows come in any order; each step has to see the same
        rows = sorted(zip(ids.is_null().to_pylist(), ids.fill_null(0).to_pylist(), texts))
        self.null = np.array([r[0] for r in rows], dtype=bool)
        self.ids = np.array([r[1] for r in rows], dtype=np.int64)
        self.texts = [r[2] for r in rows]
        s = self.segments = segments(self.texts, np.flatnonzero(~self.null), match)
        self.keys, self.of = np.unique(s.key, return_inverse=True)
        n = len(self.keys)
        order = np.argsort(self.of, kind="stable")
        doc = self.ids[s.doc[order]]
        starts = np.flatnonzero(np.diff(self.of[order], prepend=-1))
        self.least = np.minimum.reduceat(doc, starts) if n else doc
        self.greatest = np.maximum.reduceat(doc, starts) if n else doc

    def text(self, i: int) -> bytes:
        """The bytes of segment ``i``."""
        begin = self.segments.start[i]
        return self.texts[self.segments.doc[i]][begin:begin + self.segments.windows[i] + self.match - 1]

    def digests(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chosen key: the least digest (two numbers) and the number of different ones."""
        own = np.flatnonzero(chosen[self.of])
        raw = b"".join([hashlib.blake2b(self.text(i), digest_size=16).digest() for i in own.tolist()])
        digest = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
        order = np.lexsort((digest[:, 1], digest[:, 0], self.of[own]))
        key, digest = self.of[own][order], digest[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        new = np.ones(len(key), dtype=np.int64)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
        return digest[starts], np.add.reduceat(new, starts)

    def ranges(self, step: int) -> list[tuple[int, int, int]]:
        """The key ranges that the bucket has keys in, and where they begin and end in ``keys``."""
        of = self.keys // step
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        return list(zip(of[starts].tolist(), starts.tolist(), np.append(starts[1:], len(of)).tolist()))


def _rows(kinds, columns):
    import pyarrow as pa

    return pa.table([pa.array(c, k) for c, k in zip(columns, [t for _, t in kinds])], names=[n for n, _ in kinds])


def _answers(table) -> dict:
    return {r["range"]: r for r in table.to_pylist()}


@dataclass(frozen=True)
class Plan:
    """Numbers fixed for a run: buckets, key ranges and their width, and bits dropped from
    keys in the first step."""
    buckets: int
    ranges: int
    step: int
    drop: int
    pieces: int
    match: int


def make_plan(total_bytes: int, match: int = MATCH) -> Plan:
    keys = max(1, total_bytes // 15)
    ranges = max(1, -(-keys // RANGE_KEYS))
    step = -(-(2**63 - 1) // ranges)
    kept = min(62, keys.bit_length() + 8)          # one key in 200 or so seems shared by chance
    return Plan(max(1, -(-total_bytes // BUCKET_BYTES)), ranges, step, 63 - kept, max(16, 16 * ranges), match)


def short_keys(plan: Plan):
    """Step 1 in a bucket: its distinct shortened keys by range."""
    def run(table):
        import pyarrow as pa

        b = Bucket(table, plan.match)
        out = []
        for r, i, j in b.ranges(plan.step):
            k = np.unique(b.keys[i:j] >> plan.drop)
            out.append((r, table.column("bucket")[0].as_py(), len(k), pack_sorted(k)))
        return _rows([("range", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())], zip(*out) if out else [[]] * 4)
    return run, "range long, bucket long, n long, keys binary"


def shared_bits(table):
    """Step 1 in a key range: for every bucket's keys, a bit that says another has it."""
    import pyarrow as pa

    rows = table.to_pylist()
    keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), dtype=bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    ends = np.cumsum([r["n"] for r in rows])
    bits = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])]
    return _rows([("range", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())], [[r["range"] for r in rows], [r["bucket"] for r in rows], bits])


_FULL = [("range", "long"), ("bucket", "long"), ("all", "long"), ("n", "long"), ("chosen", "binary"), ("keys", "binary"), ("digests", "binary"),
         ("least", "binary"), ("greatest", "binary"), ("strings", "binary")]


def shared_keys(plan: Plan):
    """Step 2 in a bucket: full rows of the keys that another bucket, or another document
    here, seems to have."""
    def run(key, table, flags):
        import pyarrow as pa

        if not table.num_rows:
            return _rows([(n, pa.int64() if t == "long" else pa.binary()) for n, t in _FULL], [[]] * len(_FULL))
        b = Bucket(table, plan.match)
        parts, answers, out = b.ranges(plan.step), _answers(flags), []
        chosen = b.least != b.greatest
        for r, i, j in parts:
            short, back = np.unique(b.keys[i:j] >> plan.drop, return_inverse=True)
            chosen[i:j] |= np.unpackbits(np.frombuffer(answers[r]["bits"], dtype=np.uint8), count=len(short)).astype(bool)[back]
        if chosen.any():
            digest, strings = b.digests(chosen)
            before = np.concatenate([[0], np.cumsum(chosen)])
            for r, i, j in parts:
                own, of = chosen[i:j], slice(before[i], before[j])
                if own.any():
                    out.append((r, key[0].as_py(), j - i, before[j] - before[i], np.packbits(own).tobytes(), pack_sorted(b.keys[i:j][own]), digest[of].tobytes(),
                                pack(b.least[i:j][own]), pack(b.greatest[i:j][own]), pack(strings[of])))
        return _rows([(n, pa.int64() if t == "long" else pa.binary()) for n, t in _FULL], zip(*out) if out else [[]] * len(_FULL))
    return run, ", ".join(f"{n} {t}" for n, t in _FULL)


ONE_DOCUMENT, ONE_STRING, SEVERAL, MANY = range(4)
_ANSWER = "kind int, bucket long, range long, all long, n long, chosen binary, state binary, least binary"


def _answer_rows(columns):
    import pyarrow as pa

    return _rows([("kind", pa.int32()), ("bucket", pa.int64()), ("range", pa.int64()), ("all", pa.int64()), ("n", pa.int64()),
                  ("chosen", pa.binary()), ("state", pa.binary()), ("least", pa.binary())], columns)


def settle(table):
    """Step 2 in a key range: state and least document of every key."""
    rows = table.to_pylist()
    keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
    digests = np.concatenate([np.frombuffer(r["digests"], dtype="<i8").reshape(-1, 2) for r in rows])
    least, greatest, strings = (np.concatenate([unpack(r[c], r["n"]) for r in rows]) for c in ("least", "greatest", "strings"))
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=np.int64(-1)))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    lo, hi = np.minimum.reduceat(least[order], starts), np.maximum.reduceat(greatest[order], starts)
    one = ((np.minimum.reduceat(digests[order], starts) == np.maximum.reduceat(digests[order], starts)).all(axis=1)
           & (np.maximum.reduceat(strings[order], starts) == 1))
    total = np.add.reduceat(strings[order], starts)
    state = np.where(lo == hi, ONE_DOCUMENT, np.where(one, ONE_STRING, np.where(total <= HOT, SEVERAL, MANY))).astype(np.uint8)
    state_of, least_of = np.empty(len(keys), dtype=np.uint8), np.empty(len(keys), dtype=np.int64)
    state_of[order], least_of[order] = state[group], lo[group]
    ends = np.cumsum([r["n"] for r in rows])[:-1]
    return _answer_rows([[0] * len(rows), [r["bucket"] for r in rows], [r["range"] for r in rows], [r["all"] for r in rows], [r["n"] for r in rows],
                         [r["chosen"] for r in rows], [pack(x) for x in np.split(state_of, ends)], [pack(x) for x in np.split(least_of, ends)]])


def _states(b: Bucket, plan: Plan, answers) -> tuple[np.ndarray, np.ndarray]:
    """State and least document of each of the bucket's keys."""
    state, least = np.zeros(len(b.keys), dtype=np.uint8), np.zeros(len(b.keys), dtype=np.int64)
    begin = {r: i for r, i, _ in b.ranges(plan.step)}
    for a in answers:
        if a["kind"] == 0:
            at = begin[a["range"]] + np.flatnonzero(np.unpackbits(np.frombuffer(a["chosen"], dtype=np.uint8), count=a["all"]))
            state[at], least[at] = unpack(a["state"], a["n"]), unpack(a["least"], a["n"])
    return state, least


@dataclass
class Pieces:
    """Distinct strings of a bucket for step 3, by task: text, least document, task."""
    text: list[bytes]
    least: np.ndarray
    task: np.ndarray


def _pieces(b: Bucket, state: np.ndarray, plan: Plan):
    """Pieces, and per open segment (its number, piece of its first window, one piece a
    window or not)."""
    s = b.segments
    state_of = state[b.of] if len(b.keys) else np.empty(0, dtype=np.uint8)
    several, many = np.flatnonzero(state_of == SEVERAL), np.flatnonzero(state_of == MANY)
    docs = b.ids[s.doc]

    found: dict[tuple[int, bytes], int] = {}
    least, of = [], []
    for i in several.tolist():                           # segments by their bytes
        k = found.setdefault((s.key[i], b.text(i)), len(found))
        if k == len(least):
            least.append(docs[i])
        elif docs[i] < least[k]:
            least[k] = docs[i]
        of.append(k)
    task = (_mix(np.array([k for k, _ in found], dtype=np.int64).astype(np.uint64)) % np.uint64(plan.pieces)).astype(np.int64)
    texts = [w for _, w in found]

    single: dict[bytes, int] = {}
    single_least, single_of = [], []
    for i in many.tolist():                              # windows by their bytes
        whole = b.text(i)
        for skip in range(int(s.windows[i])):
            w = whole[skip:skip + plan.match]
            k = single.setdefault(w, len(single))
            if k == len(single_least):
                single_least.append(docs[i])
            elif docs[i] < single_least[k]:
                single_least[k] = docs[i]
            single_of.append(k)
    extra = list(single)
    extra_task = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") % plan.pieces for w in extra], dtype=np.int64)
    all_task = np.concatenate([task, extra_task])
    by_task = np.argsort(all_task, kind="stable")
    place = np.empty(len(by_task), dtype=np.int64)
    place[by_task] = np.arange(len(by_task))
    every = texts + extra
    pieces = Pieces([every[k] for k in by_task], np.array(least + single_least, dtype=np.int64)[by_task], all_task[by_task])
    return pieces, (several, place[np.array(of, dtype=np.int64)]), (many, place[len(texts):][np.array(single_of, dtype=np.int64)])


def open_pieces(plan: Plan):
    """Step 3 in a bucket: the distinct strings of the keys that are not settled."""
    def run(key, table, answers):
        import pyarrow as pa
        import zstandard

        kinds = [("task", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("text", pa.binary()), ("lengths", pa.binary()), ("least", pa.binary())]
        out = []
        if table.num_rows and answers.num_rows:
            b = Bucket(table, plan.match)
            p, _, _ = _pieces(b, _states(b, plan, answers.to_pylist())[0], plan)
            starts = np.flatnonzero(np.diff(p.task, prepend=-1))
            for t, i, j in zip(p.task[starts], starts, np.append(starts[1:], len(p.task))):
                out.append((t, key[0].as_py(), j - i, zstandard.ZstdCompressor(level=3).compress(b"".join(p.text[i:j])),
                            pack(np.array([len(x) for x in p.text[i:j]])), pack(p.least[i:j])))
        return _rows(kinds, zip(*out) if out else [[]] * 6)
    return run, "task long, bucket long, n long, text binary, lengths binary, least binary"


def suffix_order(data: np.ndarray, places: np.ndarray, docs: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``places`` in the order of their first ``match`` bytes, ties by
    document, and the bytes (``match`` at most) that each has in common with the one before."""
    by_doc = np.argsort(docs, kind="stable")
    prefixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, match)[places[by_doc]])
    order = np.argsort(prefixes.view(f"S{match}").reshape(-1), kind="stable")
    prefixes = prefixes[order]
    common = np.zeros(len(order), dtype=np.int64)
    for i in range(1, len(order), CHUNK):
        j = min(i + CHUNK, len(order))
        differ = prefixes[i:j] != prefixes[i - 1:j - 1]
        first = differ.argmax(axis=1)
        common[i:j] = np.where(differ[np.arange(j - i), first], first, match)
    return by_doc[order], common


def previous_smaller(docs: np.ndarray, common: np.ndarray, floor: int) -> np.ndarray:
    """Bytes that each suffix, in suffix order, shares with its previous smaller position: the
    nearest one before it of a smaller document.  Pointers jump over ranges whose documents
    are no smaller, and a search ends where fewer than ``floor`` bytes are shared (the result
    is then below ``floor``)."""
    to, shared = np.arange(-1, len(docs) - 1), common.copy()
    open_ = np.flatnonzero(shared >= max(1, floor))
    while len(open_):
        open_ = open_[docs[to[open_]] >= docs[open_]]
        over = to[open_]
        here = np.minimum(shared[open_], shared[over])
        to[open_], shared[open_] = to[over], here
        open_ = open_[here >= max(1, floor)]
    return shared


def longest_previous_factors(data: np.ndarray, places: np.ndarray, docs: np.ndarray, match: int, floor: int) -> np.ndarray:
    """The longest prefix, ``match`` bytes at most, that the suffix at each place shares with a
    suffix of a smaller document; exact where it reaches ``floor``, else below ``floor``."""
    order, common = suffix_order(data, places, docs, match)
    ranked, after = docs[order], np.zeros_like(common)
    after[1:] = common[1:][::-1]
    out = np.empty_like(common)
    out[order] = np.maximum(previous_smaller(ranked, common, floor), previous_smaller(ranked[::-1], after, floor)[::-1])
    return out


def previous_factors(plan: Plan):
    """Step 3 in a task: for every suffix of its strings, whether its longest previous factor
    reaches the match."""
    def run(table):
        import zstandard

        rows = table.to_pylist()
        texts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(r["text"]), dtype=np.uint8) for r in rows]
        lengths = [unpack(r["lengths"], r["n"]) for r in rows]
        least = np.concatenate([unpack(r["least"], r["n"]) for r in rows])
        size = np.concatenate(lengths)
        begins = np.cumsum(size) - size
        count = size - plan.match + 1
        ends = np.cumsum(count)
        places = np.repeat(begins - (ends - count), count) + np.arange(ends[-1])
        found = longest_previous_factors(np.concatenate(texts), places, np.repeat(least, count), plan.match, plan.match) >= plan.match
        split = np.cumsum([int(x.sum()) - (plan.match - 1) * len(x) for x in lengths])
        parts = np.split(found, split[:-1])
        none = [b""] * len(rows)
        return _answer_rows([[1] * len(rows), [r["bucket"] for r in rows], [r["task"] for r in rows], [len(x) for x in parts], [r["n"] for r in rows],
                             none, none, [np.packbits(x).tobytes() for x in parts]])
    return run, _ANSWER


def _runs(flags: np.ndarray) -> int:
    return int(np.count_nonzero(flags[1:] & ~flags[:-1]) + (len(flags) > 0 and flags[0]))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def cut(plan: Plan, with_text: bool):
    """Step 4: mark each bucket's matches and cut its documents."""
    def run(key, table, answers):
        import pyarrow as pa

        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())]
        if not table.num_rows:
            return _rows(kinds, [[]] * 6)
        b = Bucket(table, plan.match)
        s, rows = b.segments, answers.to_pylist()
        state, least = _states(b, plan, rows)
        docs = b.ids[s.doc]
        of = b.of if len(b.keys) else np.empty(0, dtype=np.int64)
        begin = np.cumsum(s.windows) - s.windows
        matched = np.repeat((state[of] == ONE_STRING) & (least[of] < docs), s.windows)
        repeated = {r["range"]: np.unpackbits(np.frombuffer(r["least"], dtype=np.uint8), count=r["all"]).astype(bool) for r in rows if r["kind"] == 1}
        if repeated:
            p, (order, piece), (many, windows) = _pieces(b, state, plan)
            count = np.array([len(x) - plan.match + 1 for x in p.text])
            first = np.cumsum(count) - count
            found = np.concatenate([repeated[t] for t in np.unique(p.task)])
            at = np.repeat(begin[order] - np.cumsum(s.windows[order]) + s.windows[order], s.windows[order]) + np.arange(int(s.windows[order].sum()))
            source = at - np.repeat(begin[order], s.windows[order]) + np.repeat(first[piece], s.windows[order])
            matched[at] = found[source] | np.repeat(p.least[piece] < docs[order], s.windows[order])
            at = np.repeat(begin[many] - np.cumsum(s.windows[many]) + s.windows[many], s.windows[many]) + np.arange(int(s.windows[many].sum()))
            matched[at] = found[first[windows]] | (p.least[windows] < np.repeat(docs[many], s.windows[many]))
        # a document's segments follow each other and cover all its windows
        ends = np.cumsum(np.bincount(s.doc, weights=s.windows, minlength=len(b.texts))).astype(np.int64)
        out, last = [], 0
        for i, text in enumerate(b.texts):
            here = matched[last:ends[i]]
            last = ends[i]
            n, removed, spans, kept = len(text), 0, 0, text
            if here.any():
                sums = np.concatenate([np.zeros(plan.match, dtype=np.int64), np.cumsum(here), np.full(plan.match - 1, np.count_nonzero(here))])
                gone = sums[plan.match:] > sums[:-plan.match]
                removed, spans = int(np.count_nonzero(gone)), _runs(gone)
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            out.append((None if b.null[i] else int(b.ids[i]), n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return _rows(kinds, zip(*out))
    return run, RESULT


def dedup(docs: DataFrame, match: int = MATCH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (bytes) of each document."""
    if match < 3 * GRAM:
        raise ValueError(f"match is at least {3 * GRAM} bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = make_plan(total, match)
    buckets = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(plan.buckets)))

    def grouped(df: DataFrame):
        return df.repartition(plan.buckets, "bucket").groupBy("bucket")

    def met(df: DataFrame, key: str):
        return df.repartition(plan.ranges, key).groupBy(key)

    bits = met(grouped(buckets).applyInArrow(*short_keys(plan)), "range").applyInArrow(shared_bits, "range long, bucket long, bits binary")
    answers = met(grouped(buckets).cogroup(grouped(bits)).applyInArrow(*shared_keys(plan)), "range").applyInArrow(settle, _ANSWER)
    pieces = grouped(buckets).cogroup(grouped(answers)).applyInArrow(*open_pieces(plan))
    factors = met(pieces, "task").applyInArrow(*previous_factors(plan))
    return grouped(buckets).cogroup(grouped(answers.unionByName(factors))).applyInArrow(*cut(plan, with_text))


def judge(docs: DataFrame) -> DataFrame:
    return dedup(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i FROM d)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM w),
b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS i FROM d)),
m AS (SELECT b.doc_id, b.i, x, coalesce(bool_or(gone) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
      FROM b LEFT JOIN f ON b.doc_id = f.doc_id AND b.i = f.i),
k AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
g AS (SELECT doc_id, count(*) AS n_bytes, count_if(gone) AS n_removed, count_if(opens) AS n_spans,
             sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256 FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
