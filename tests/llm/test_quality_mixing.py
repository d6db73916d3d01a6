import re
from collections import Counter

from pyspark.sql import functions as F

from partcast.llm import mixing, quality

from .util import EDGE, cells, documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def numbers(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


JUNK = [(50, "BUY!! NOW!! CHEAP!! " + "GOLD!! RING!! SALE!! " * 5 + " ".join(f"W{k}X!!" for k in range(60))),
        (51, " | ".join(prose(3, 80).split())), (52, "same line again and more\n" * 30), (53, "word " * 200),
        (54, " ".join(w + "###" for w in prose(4, 120).split()))]


def test_judge(spark):
    rows = EDGE + JUNK + [(k, prose(k, 20 * k)) for k in range(10, 20)] + [(60, "é à ü " * 40), (61, "a\x0bb\x0cc\rd\u00a0e " * 30)]
    docs = documents(spark, rows)
    got = quality.judge(docs)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = []
    for doc_id, text, *_ in rows:
        n, chars, symbols, dup, repeat = numbers(text)
        want.append((doc_id, n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n))
    assert cells(got, *got.columns[:7]) == sorted(want, key=repr)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert not any(kept[k] for k, *_ in JUNK)
    assert all(kept[k] for k in range(10, 20))
    assert quality.judge(empty(spark)).count() == 0


def test_keep_has_the_same_verdict_and_columns(spark):
    docs = documents(spark, EDGE + JUNK + [(k, prose(k, 20 * k)) for k in range(10, 20)])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert cells(kept, "doc_id", "text") == sorted(((d["doc_id"], d["text"]) for d in docs.collect() if 10 <= (d["doc_id"] or 0) < 20), key=repr)


def test_few_distinct_words_at_any_length(spark):
    """Words drawn from a hundred, in an order that repeats no window of three: rejected
    whatever the length; from many words: kept."""
    def salad(n, words):
        x, out = 7, []
        for _ in range(n):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            out.append(f"word{(x >> 33) % words}")
        return " ".join(out)

    lengths = (1_000, 1_999, 2_000, 20_000)
    rows = [(k, salad(n, 70 if n == 1_000 else 100)) for k, n in enumerate(lengths)] + [(10 + k, salad(n, 5_000)) for k, n in enumerate(lengths)]
    few = next(r for r in quality.RULES if r.name == "few_distinct")
    got = {r["doc_id"]: r["x"] for r in documents(spark, rows).select("doc_id", few.rejects(F.col("text")).alias("x")).collect()}
    assert got == {k: k < 10 for k in got}
    kept = {r["doc_id"] for r in quality.keep(documents(spark, rows)).collect()}
    assert kept == {10, 11, 12, 13}


def test_order_is_by_rejection_per_cost():
    rules = [quality.Rule(x, None) for x in "abc"]
    measured = [quality.Measured(rules[0], 1.0, 0.5), quality.Measured(rules[1], 0.1, 0.2), quality.Measured(rules[2], 0.1, 0.01)]
    assert [r.name for r in quality.order(measured)] == ["b", "a", "c"]


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {s: 0.0 for s in sizes}, set(sizes)
    while free:
        level = (total - sum(target[s] for s in sizes if s not in free)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        free -= set(over)
    return target


def test_mix(spark):
    rows = EDGE + [(k, prose(k, 10 + 7 * (k % 200)), (None, "a", "b", "é", "zz")[k % 5]) for k in range(10, 400)]
    docs = documents(spark, rows)
    got = mixing.mix(docs, block=64).collect()
    sizes = Counter()
    source = {}
    for r in rows:
        s = r[2] if len(r) > 2 else "a"
        sizes[s] += numbers(r[1])[0]
        source[r[0]] = s
    target = brute_targets(dict(sizes))
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == cells(mixing.mix(docs.repartition(5), block=64))
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_documents_hold_what_the_mix_takes(spark):
    rows = EDGE + [(k, "  " + prose(k, 10 + 7 * (k % 100)), (None, "a", "b")[k % 3]) for k in range(10, 200)]
    docs = documents(spark, rows)
    want = {}
    for r in mixing.mix(docs, block=64).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    out = mixing.mixed_documents(docs, block=64)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += numbers(r["text"])[0]
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in want.items() if v} == dict(got)


def plain_taken(rows, plan, block):
    """Words taken from each document: slots laid over the blocks of its source by hand."""
    by_source, taken = {}, Counter()
    for doc_id, size, sid in rows:
        by_source.setdefault(sid, []).append((doc_id, size))
    for sid, docs in by_source.items():
        words = [doc_id for doc_id, size in docs for _ in range(size)]
        for s in plan[sid]:
            taken.update(words[s["block"] * block:s["block"] * block + s["take"]])
    return taken


def test_taken_against_the_plain_way(spark):
    rows = [(k, prose(k, 10 + 7 * (k % 90)), ("a", "b", "c", None)[k % 4]) for k in range(10, 150)]
    docs = documents(spark, rows)
    placed, slots = mixing._plan(docs, 64, 11)
    laid = [(r["doc_id"], r["size"], r["sid"]) for r in placed.orderBy("sid", "start").collect()]
    plan = {}
    for s in slots.collect():
        plan.setdefault(s["sid"], []).append(s)
    want = plain_taken(laid, plan, 64)
    got = {r["doc_id"]: (r["taken"], sum(p["words"] for p in r["places"])) for r in mixing.mix(docs, block=64).collect()}
    assert got == {k: (want[k], want[k]) for k, *_ in rows}


def test_the_draw_lays_out_the_shards(spark):
    """Slots per shard follow a multinomial of equal chances, given each source's total; parts
    go where their slot was drawn to, and the mix is written in that order."""
    sources = spark.createDataFrame([(0, "a", 400_000, 600_000.0), (1, "b", 300_000, 200_000.0)], "sid int, source string, source_size long, target double")
    slots = mixing.draw_slots(sources, block=64, shard_slots=400).cache()
    counts = {(r["sid"], r["shard"]): r["slots"] for r in mixing.shard_counts(slots).collect()}
    for sid, total in ((0, 9375), (1, 3125)):
        own = [n for (s, _), n in sorted(counts.items()) if s == sid]
        shards = 32                                                     # (9375 + 3125) / 400, rounded up
        assert sum(own) == total and len(own) == shards
        expected = total / shards
        chi = sum((n - expected) ** 2 / expected for n in own)
        assert 10 < chi < 62 and len(set(own)) > 5                      # 31 degrees of freedom, 1 in 1000 either side
    rows = [(k, prose(k, 60), "ab"[k % 2]) for k in range(600)]
    docs = documents(spark, rows)
    _, drawn = mixing._plan(docs, 64, 11)
    shard = {(r["shard"], r["position"]) for r in drawn.collect()}
    places = [(p["shard"], p["position"]) for r in mixing.mix(docs, block=64).collect() for p in r["places"]]
    assert set(places) <= shard and len(set(places)) > 500
    order = [r["doc_id"] for r in mixing.mixed_documents(docs, block=64).coalesce(1).collect()]
    first = {r["doc_id"]: {(p["shard"], p["position"]) for p in r["places"]} for r in mixing.mix(docs, block=64).collect()}
    assert sum(not any(a <= b for a in first[x] for b in first[y]) for x, y in zip(order, order[1:])) == 0
    assert sum(a % 2 != b % 2 for a, b in zip(order, order[1:])) > len(order) // 4      # the sources are intermingled


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))
