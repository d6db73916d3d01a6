"""Secrets: fixed patterns, and values of credential contexts that are hard to guess.

A value in a credential context (after a key such as ``passphrase =``, a bearer token, the
password of a URL) is a secret if guessing it costs a lot.  Its cost is the cheapest way to
segment it, by dynamic programming, into

* words: as many guesses as there are words at least as frequent in the whole corpus, and
  the ways to write it in capitals or with the usual digits for letters;
* dates: the days of the years around ``YEAR``, and the separator;
* repeats: the unit once, and how often;
* keyboard walks: the first key, the length, and each turn;
* brute-force spans: the alphabet of each character.

Costs are bits (log2 of guesses) and add up; each segment after the first costs one bit more.
From ``MIN_BITS`` on (10**10 guesses) the value is a span of kind ``guess``, unless a span of
the base patterns holds it already; the cost of every value is returned beside the spans.

Words are counted over all documents, outside the values themselves, combined by each task
before the shuffle; their ranks come from a histogram of counts in range partitions.  Only
the substrings of values meet the counted words, in a join by word; each different value is
segmented once, however many rows hold it.

Defined results: null texts are empty and have no spans; texts and values of any length are
read whole; repeated rows are judged each, and equal values cost the same; words of equal
frequency cost the same; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import comb, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm.base import materialise
from partcast.operators.ranks import positions

KINDS = ("assign", "access", "hex", "guess")
#: Guesses from which on a value is a secret; the reference year of dates and the least years tried.
MIN_BITS, YEAR, YEARS = log2(10**10), 2020, 20
#: Words of the corpus that take part in segments.
SHORTEST, LONGEST = 3, 24
#: Longest unit of a repeat.
UNIT = 16
#: Words counted by a task before it hands its counts on (bounds its memory).
HELD_WORDS = 300_000
#: Substrings of values in a batch that a task hands on.
HELD_PARTS = 50_000

# What the base kinds look like, and credential contexts.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEYED = re.compile(r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?["'`]?[ \t]*(?:=>|:=|==|[:=])"""
                    r"""[ \t]*["'`]?([^\s"'`]+)""", re.I | re.A)
_BEARER = re.compile(r"\bbearer[ \t]+([A-Za-z0-9+/_.=~-]+)", re.I | re.A)
_IN_URL = re.compile(r"://[^\s/:@]+:([^\s/:@]+)@")
#: Texts without any of this hold neither spans nor values.
_HINT = (r"(?i:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)"
         r"|AKIA[A-Z0-9]|://[^\s/:@]+:[^\s/:@]+@|[0-9a-f]{24}")
_WORD = re.compile(r"(?<!\w)[^\W\d_]{3,}(?!\w)")
# Rows of a keyboard, each key between two of the row above, and digits and
# signs that stand for letters.
_ROWS = ("`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./")
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
_STANDS_FOR = str.maketrans("@4831!05$7+2", "aabeliossttz")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def values_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in credential contexts, without closing punctuation."""
    found = set()
    for pattern in (_KEYED, _BEARER, _IN_URL):
        for m in pattern.finditer(text):
            value = m.group(1)
            if pattern is _KEYED:
                value = value.rstrip(".,;:!?)]}>")
            if value:
                found.add((m.start(1), m.start(1) + len(value)))
    return sorted(found)


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{i}:{j}" for i, kind, j in spans)


# -- the cost of a value ---------------------------------------------------------------
def plain_letters(part: str) -> str:
    """Small letters, and letters for the digits and signs that stand for them."""
    return part.lower().translate(_STANDS_FOR)


def parts_of(value: str):
    """Every substring that could be a word."""
    for form in {value.lower(), plain_letters(value)}:
        for m in re.finditer(r"[^\W\d_]+", form):
            run = m.group()
            for i in range(len(run) - SHORTEST + 1):
                yield from (run[i:j] for j in range(i + SHORTEST, min(i + LONGEST, len(run)) + 1))


def _spelling_bits(part: str, word: str) -> float:
    """Ways to write the word: its capitals, and letters replaced by digits and signs."""
    bits, upper = 0.0, sum(c.isupper() for c in part)
    if upper:
        letters = sum(c.isalpha() for c in part)
        usual = part[0].isupper() and upper == 1 or upper == letters
        bits += 1.0 if usual else log2(sum(comb(letters, k) for k in range(1, min(upper, letters - upper) + 1)) or 1) + 1
    replaced = sum(a != b for a, b in zip(part.lower(), word))
    return bits + (1.0 + replaced if replaced else 0.0)


@lru_cache(maxsize=4096)
def _char_bits(c: str) -> float:
    if c.isascii():
        return log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return log2(100)


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, dict[str, int]]:
    """Key -> neighbouring key -> direction, from the rows: a key touches the next ones of its
    row and the two nearest of the rows above and below."""
    at = {key: (x, y) for y, row in enumerate(_ROWS) for x, key in enumerate(row) if key != "\t"}
    steps = ((1, 0), (-1, 0), (0, -1), (1, -1), (0, 1), (-1, 1))
    by_place = {place: key for key, place in at.items()}
    return {key: {by_place[x + dx, y + dy]: n for n, (dx, dy) in enumerate(steps) if (x + dx, y + dy) in by_place} for key, (x, y) in at.items()}


def _walks(value: str):
    """(start, end, bits) of walks of three keys or more; a walk begins where the one before
    could not go on, and may end at any key."""
    near = _neighbours()
    keys = [_SHIFTED.get(c, c.lower()) for c in value]
    turn = log2(sum(map(len, near.values())) / len(near))
    i = 0
    while i < len(keys) - 1:
        j, turns, last = i + 1, 0, None
        shifted = keys[i] != value[i]
        while j < len(keys) and (way := near.get(keys[j - 1], {}).get(keys[j])) is not None:
            turns += way != last
            shifted |= keys[j] != value[j]
            last = way
            j += 1
            if j - i >= 3:
                yield i, j, log2(len(near)) + log2(j - i) + turns * turn + shifted
        i = max(i + 1, j - 1) if j - i >= 3 else i + 1


_YEAR = re.compile(r"(?:19|20)\d\d", re.A)
_DATES = [(re.compile(p, re.A), order) for p, order in (
    (r"(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})", (1, 3, 4)), (r"(\d{1,2})([-/._]?)(\d{1,2})\2(\d{4})", (4, 3, 1)),
    (r"(\d{1,2})([-/._])(\d{1,2})\2(\d{2})", (4, 3, 1)))]


def _dates(value: str):
    """(start, end, bits) of years and of days with their year, in either order of day and month."""
    for i, c in enumerate(value):
        if not (c.isascii() and c.isdigit()):
            continue
        if _YEAR.match(value, i):
            yield i, i + 4, log2(max(abs(int(value[i:i + 4]) - YEAR), YEARS))
        for pattern, (y, m, d) in _DATES:
            found = pattern.match(value, i, i + 10)
            if not found:
                continue
            year, a, b = (int(found.group(k)) for k in (y, m, d))
            year += 0 if year > 99 else 2000 if year <= YEAR % 100 else 1900
            if 1000 <= year <= 2050 and 1 <= min(a, b) and max(a, b) <= 31 and min(a, b) <= 12:
                yield i, found.end(), log2(365 * max(abs(year - YEAR), YEARS)) + (2.0 if found.group(2) else 0.0)


def _repeats(value: str, cost):
    """(start, end, bits) of the longest repeats of units of up to UNIT characters."""
    n = len(value)
    for unit in range(1, min(UNIT, n // 2) + 1):
        run = 0                                     # characters from i on that equal those a unit later
        for i in range(n - unit - 1, -1, -1):
            run = run + 1 if value[i] == value[i + unit] else 0
            times = run // unit + 1
            if times >= 2:
                yield i, i + times * unit, cost(value[i:i + unit]) + log2(times)


def guess_bits(value: str, words: dict[str, float], repeats: bool = True) -> float:
    """log2 of the guesses for a value; ``words`` has the guesses of each word."""
    n = len(value)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]

    def add(i, j, bits):
        ending[j].append((i, bits))

    if words:
        # a letter in small form may be longer than one character; such values have no words
        forms = {f for f in (value.lower(), plain_letters(value)) if len(f) == n}
        for form in forms:
            for i in range(n - SHORTEST + 1):
                for j in range(i + SHORTEST, min(i + LONGEST, n) + 1):
                    guesses = words.get(form[i:j])
                    if guesses:
                        add(i, j, log2(guesses) + _spelling_bits(value[i:j], form[i:j]))
    for found in (_dates(value), _walks(value)):
        for i, j, bits in found:
            add(i, j, bits)
    if repeats:
        units: dict[str, float] = {}

        def unit_cost(unit):
            if unit not in units:
                units[unit] = guess_bits(unit, words, repeats=False)
            return units[unit]

        for i, j, bits in _repeats(value, unit_cost):
            add(i, j, bits)
    # best[j]: cheapest segments of value[:j]; brute[j]: those whose last is a brute-force span
    best, brute = [0.0] * (n + 1), [float("inf")] * (n + 1)
    for j in range(1, n + 1):
        own = _char_bits(value[j - 1])
        brute[j] = min(brute[j - 1] + own, best[j - 1] + own + (1.0 if j > 1 else 0.0))
        best[j] = min([brute[j], *(best[i] + bits + (1.0 if i else 0.0) for i, bits in ending[j])])
    return best[n]


# -- over the table --------------------------------------------------------------------
def _hinted(column):
    """Which texts of a batch can hold anything (a null text cannot)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.match_substring_regex(column, _HINT), False).to_pylist()


def find(rows: DataFrame) -> DataFrame:
    """Per row (``_row``): counts, base spans, and its values as (start, end, value)."""
    def run(batches):
        import pyarrow as pa

        value = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            counts, base, values = [[], [], []], [], []
            for hint, x in zip(_hinted(batch.column(2)), batch.column(2)):
                text = x.as_py() if hint else ""
                spans = base_spans(text) if hint else []
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in spans))
                base.append(listed(spans))
                values.append([{"start": i, "end": j, "value": text[i:j]} for i, j in values_of(text)] or None if hint else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(values, value)],
                                             names=["_row", "doc_id", *(f"n_{k}" for k in KINDS[:3]), "base", "found"])

    schema = "_row long, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS[:3]) + ", base string, found array<struct<start:long,end:long,value:string>>"
    return rows.mapInArrow(run, schema)


def words_in(text: str, values: list[tuple[int, int]]) -> list[str]:
    """Words (letters alone, no digit beside them) outside the values, in small letters."""
    kept, last = [], 0
    for i, j in values:
        kept += [text[last:i], " "] if i >= last else []
        last = max(last, j)
    return _WORD.findall("".join([*kept, text[last:]]).lower())


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: how often each word stands in the corpus."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            column = batch.column(0)
            for hint, x in zip(_hinted(column), column):
                text = x.as_py()
                if text:
                    held.update(words_in(text, values_of(text) if hint else []))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return (texts.mapInArrow(run, "word string, n long").where(F.length("word") <= LONGEST)
            .groupBy("word").agg(F.sum("n").alias("n")))


def costs(values: DataFrame, texts: DataFrame) -> DataFrame:
    """value_id, bits of each different value (columns value_id, value) against the words of
    the corpus ``texts``."""
    def parts(batches):
        import pyarrow as pa

        ids, out = [], []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in parts_of(value):
                    ids.append(key)
                    out.append(part)
                    if len(out) >= HELD_PARTS:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], names=["value_id", "word"])
                        ids, out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], names=["value_id", "word"])

    counted = materialise(word_counts(texts), "word-counts")
    ranks = positions(counted, "n", descending=True).select(F.col("val").alias("_n"), (F.col("before") + F.col("ties")).cast("double").alias("guesses"))
    # many more parts than values: their number is not the values' that Spark would go by
    known = values.mapInArrow(parts, "value_id binary, word string").hint("merge").join(counted, "word").distinct()
    # different counts are few: k of them add up to k (k + 1) / 2 words of text at least
    known = known.join(F.broadcast(ranks), F.col("n") == F.col("_n")).groupBy("value_id").agg(F.collect_list(F.struct("word", "guesses")).alias("words"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bits = [guess_bits(v, {w["word"]: w["guesses"] for w in words or []}) for v, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64())], names=["value_id", "bits"])

    return values.join(known, "value_id", "left").select("value_id", "value", "words").mapInArrow(run, "value_id binary, bits double")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and ``guess_costs``: the bits of
    each value, as start:end:bits."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(find(rows), "found")
    each = found.where("found IS NOT NULL").select("_row", F.explode("found").alias("v")).select("_row", "v.start", "v.end", "v.value")
    each = each.withColumn("value_id", F.unhex(F.sha2("value", 256)))
    values = materialise(each.select("value_id", "value").distinct(), "values")
    cost = materialise(costs(values, rows.select("text")), "costs")
    per_row = (each.select("_row", "start", "end", "value_id").join(cost, "value_id")
               .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "bits"))).alias("values")))
    columns = ["doc_id", *(f"n_{k}" for k in KINDS[:3])]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            spans, bits = [], []
            for base, values in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                own = [(int(i), KINDS.index(kind), int(j)) for kind, i, j in (x.split(":") for x in base.split(",") if x)]
                more = [(v["start"], 3, v["end"]) for v in values
                        if v["bits"] >= MIN_BITS and not any(i <= v["start"] and v["end"] <= j for i, _, j in own)]
                spans.append(listed(sorted(own + more)))
                bits.append(",".join(f"{v['start']}:{v['end']}:{v['bits']:.2f}" for v in values))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(spans, pa.string()), pa.array(bits, pa.string())],
                                             names=[*columns, "base", "spans", "guess_costs"])

    some = (found.where("found IS NOT NULL").join(per_row, "_row").select(*columns, "base", "values")
            .mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", base string, spans string, guess_costs string"))
    none = found.where("found IS NULL").select(*columns, "base", F.col("base").alias("spans"), F.lit("").alias("guess_costs"))
    return some.unionByName(none).select(*columns, F.sha2("base", 256).alias("base_sha256"), "spans", "guess_costs")
