"""Quality rules as a short-circuit cascade, in native column expressions.

Each rule is a number computed from the text and a condition that rejects.  A sample of
the documents gives every rule's cost (seconds a row, by running it) and selectivity
(share rejected); rules are tried in the order of rejection per cost, and a document that
one rule rejects is not put to the dearer ones that follow.  The order changes the work
and the rule named, never the verdict.

Defined results: null and empty texts have no words and fail ``min_words``; texts of any
length are read whole, under the same rules (a text's different words are held against a
tenth of its words and two and a half times their root, whichever is less); repeated rows are judged each; an empty table gives no rows; extra
columns are kept by ``keep`` and not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partcast.llm.base import SPACES, materialise

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, wherever the optimiser puts it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    bare = F.btrim(whole(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACES}]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(whole(text), F.lit(pattern)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(whole(text), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(places: Column) -> Column:
    """Positions covered by 3-word windows that begin at these ascending places."""
    steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(ws: Column) -> Column:
    """Words within 3-word windows that occur at least twice.  Windows are compared by
    64-bit hashes; only texts in which one recurs are sorted with their places."""
    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))

    starts = F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0)))

    def recurring(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), _covered)

    def placed(hs: Column) -> Column:
        pairs = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(F.array_sort(pairs), recurring))

    return let(F.transform(starts, window), placed)


def n_repeat_words(text: Column) -> Column:
    return let(words(text), repeated_words)


@dataclass(frozen=True)
class Rule:
    """``rejects`` of the text; ``base`` rules are the fixed ones of the query's contract."""
    name: str
    rejects: Callable[[Column], Column]
    base: bool = False


def _per_word(name: str, number: Callable[[Column], Column], percent: int, base: bool = False) -> Rule:
    return Rule(name, lambda t: 100 * number(t) > percent * n_words(t), base)


RULES = (
    Rule("min_words", lambda t: n_words(t) < MIN_WORDS, True),
    _per_word("repeated_words", n_repeat_words, 50, True),
    _per_word("symbols", lambda t: _count(t, SYMBOLS), 25),
    _per_word("exclamations", lambda t: _count(t, "!"), 50),
    Rule("capitals", lambda t: 100 * _count(t, "[A-Z]") > 50 * F.greatest(_count(t, "[A-Za-z]"), F.lit(1))),
    Rule("repeated_lines", lambda t: let(_lines(t), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 40 * F.size(x))),
    Rule("word_length", lambda t: let(words(t), lambda w: let(F.length(F.array_join(w, "")), lambda n: (n < 2 * F.size(w)) | (n > 20 * F.size(w))))),
    Rule("few_distinct", lambda t: let(words(t), lambda w: let(F.size(F.array_distinct(w)).cast("long"), lambda k: (10 * k < F.size(w)) & (4 * k * k < 25 * F.size(w))))),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds_a_row: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds_a_row, 1e-9)


def measure(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of about ``rows`` documents."""
    total = docs.count()
    sample = docs.select(F.col("text").cast("string").alias("text"))
    if total > rows:
        sample = sample.sample(fraction=rows / total, seed=seed)
    sample = materialise(sample, "quality-sample")
    n = max(1, sample.count())

    def run(value: Column) -> tuple[float, int]:
        begin = time.perf_counter()
        got = sample.agg(F.sum(value.cast("long"))).first()[0] or 0
        return time.perf_counter() - begin, got

    run(F.length("text"))
    empty = min(run(F.length("text"))[0] for _ in range(2))
    out = []
    for rule in rules:
        took, rejected = min(run(rule.rejects(F.col("text"))) for _ in range(2))
        out.append(Measured(rule, max(took - empty, 1e-4) / n, rejected / n))
    return out


def order(measured: list[Measured]) -> list[Rule]:
    return [m.rule for m in sorted(measured, key=lambda m: -m.rank)]


def rejected_by(text: Column, rules) -> Column:
    """Name of the first rule that rejects, or null; later rules are then not evaluated."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(rule.rejects(text), F.lit(rule.name)).otherwise(found)
    return found


def keep(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, all columns as they are."""
    return docs.where(rejected_by(F.col("text"), order(measure(docs, rules, sample_rows))).isNull())


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base numbers, base_failed and kept, for every document.  The base
    numbers are asked for of all, so the cascade here orders only the other rules."""
    others = order(measure(docs, [r for r in RULES if not r.base], sample_rows))
    numbers = docs.select("doc_id", F.col("text").cast("string").alias("text"), let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"))).alias("q"))
    base = ((F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words")))
    failed = F.when(base, F.lit("base")).otherwise(rejected_by(F.col("text"), others))
    return numbers.select("doc_id", "q.n_words", "q.word_chars", _count(F.col("text"), SYMBOLS).alias("n_symbols"),
                          n_dup_lines(F.col("text")).alias("n_dup_lines"), "q.n_repeat_words",
                          base.alias("base_failed"), failed.isNull().alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT w.doc_id, w.t, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct,
             length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM w LEFT JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 25 * n_words OR 100 * n_marks > 50 * n_words
           OR 100 * n_upper > 50 * greatest(n_letters, 1) OR 100 * n_dup_lines > 40 * n_lines
           OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (10 * n_distinct < n_words AND 4 * n_distinct * n_distinct < 25 * n_words)) AS kept
FROM b
"""
