"""Best-fit packing of documents into sequences, after a Martello-Toth reduction.

Pieces of one length are interchangeable, so the packing is solved on the histogram of
lengths (at most ``capacity`` rows, whatever the number of documents) and then dealt out:

1. Reduction.  From the longest length down, a set that provably dominates every other
   feasible set with that piece is fixed for as many pieces as there are: the piece alone
   if nothing fits with it; the piece and the longest that fits, if that fills the
   sequence, if no two fit, or if no three fit and no two together are longer than it.
2. The remainder is packed best-fit, longest first, again for all pieces of a length in
   one sequence state at once.
3. Every piece gets its rank among those of its length (two-level prefix sums), and the
   rank its place in the plan.

Defined results: null and empty texts are the end token alone; very long texts are encoded
whole and cut into pieces; pieces of equal length are interchangeable and dealt out in the order
of their documents; repeated rows are packed each; an empty table gives no rows; a doc_id may be null; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm.base import chunks_for, materialise, prefix_sums
from partcast.llm.tokens import DEFAULT_TOKENIZER, encoded

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Encode each document and cut those longer than ``capacity``; the first piece has
    what the full ones leave."""
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for part, texts_ids in encoded(batches, tokenizer):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), texts_ids):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n = len(ids)
                bounds = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [(doc_id, k, i, j - i, zlib.crc32(ids[i:j].tobytes()))
                         for k, (i, j) in enumerate(zip(bounds, bounds[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fixed sets as (how many, lengths), and the counts that remain."""
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left)
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def drop(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            order.pop(bisect_left(order, length))

    for length in sorted(left, reverse=True):
        while left.get(length):
            room = capacity - length
            have = left[length]

            def free(x: int) -> int:
                return left[x] - (x == length)

            fits = [x for x in order[:bisect_left(order, room + 1)] if free(x) > 0]
            if not fits:
                fixed.append((have, (length,)))
                drop(length, have)
                continue
            top = fits[-1]
            if top < room:
                least = [x for x in fits[:3] for _ in range(min(3, free(x)))][:3]
                two = len(least) > 1 and least[0] + least[1] <= room
                three = len(least) > 2 and sum(least) <= room
                best = 0
                if two and not three:
                    lo, hi = 0, len(fits) - 1
                    while lo <= hi:
                        pair = fits[lo] + fits[hi]
                        if pair > room or (lo == hi and free(fits[lo]) < 2):
                            hi -= 1
                        else:
                            best, lo = max(best, pair), lo + 1
                if three or best > top:
                    break                   # no dominating set: left for best fit
            n = have // 2 if top == length else min(have, left[top])
            fixed.append((n, (length, top)))
            drop(length, n)
            drop(top, n)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first: (how many sequences, their lengths).  Sequences with the
    same room that came about alike are handled as one group."""
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(n: int, lengths: tuple[int, ...]) -> None:
        room = capacity - sum(lengths)
        if room == 0:
            done.append((n, lengths))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((n, lengths))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(n // each, (length,) * each)
                if n % each:
                    put(1, (length,) * (n % each))
                break
            room = rooms[at]
            have, lengths = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length            # further ones go to the same, now fullest, sequence
            full = min(have, n // each)
            if full:
                put(full, lengths + (length,) * each)
                n -= full * each
                have -= full
            if have and n:
                put(1, lengths + (length,) * n)
                have, n = have - 1, 0
            if have:
                put(have, lengths)
    return done + [g for x in groups.values() for g in x]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(packing: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks (ascending), the sequences they go to, and the offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, lengths in packing:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = slots(plan(counts, capacity))     # bounded by the capacity as well, not by the data

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for x in np.unique(lengths):
                mine = lengths == x
                first, to, at = places[int(x)]
                k = np.searchsorted(first, ranks[mine], side="right") - 1
                sequence[mine], offset[mine] = to[k] + ranks[mine] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = prefix_sums(parts.withColumn("one", F.lit(1)), ["length"], ["doc_id", "piece", "ids_crc32"], "one", "rank",
                         chunks_for(sum(counts.values())))
    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(run, PIECES + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
