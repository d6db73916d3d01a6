"""Personal data: fixed patterns, and terms that give protected entities away.

An e-mail address, address of a machine, card or phone number found in a text is a protected
entity.  A term (a word outside the entities) discloses an entity if the pointwise mutual
information of the two, log2(p(e|t) / p(e)), reaches a share of the entity's own information,
-log2 p(e), with enough texts in support.  The two meet anywhere in a text.  A term that discloses an
entity is generalised in every document that holds it, whether the entity is mentioned there
or not.

Everything is counted in different texts, so copies of one text count once: p(e|t) is texts
with both over texts with t, p(e) texts with e over all texts.  Counts cover the whole corpus;
they are combined by each task before they are shuffled.  A term in more texts than the bound
allows for an entity is left out of its pairs early, which changes no result.  Up to
``TERMS_HELD`` disclosing terms travel to the tasks; more of them meet the documents' terms in
a join.

Defined results: null texts are empty and have no spans (the sanitised text stays null);
texts of any length are read whole, in time proportional to it; spans that begin together
are ordered by kind; repeated rows are judged each; an empty table gives no rows; extra
columns are not read by ``judge`` and kept by ``sanitise``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partcast.llm.base import materialise, unwrapped, whole_rows

KINDS = ("email", "ip", "card", "phone")
#: Different texts in support of a term, and the share of the entity's information.
SUPPORT, SHARE = 3, 0.9
#: Terms of the highest counts that tasks know when they form pairs.
COMMON = 20_000
#: Disclosing terms that tasks hold.
TERMS_HELD = 100_000
#: Terms counted by a task before it hands its counts on (bounds its memory).
HELD_TERMS = 300_000

# What the four kinds look like.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str):
    """By the @ signs, so that long runs of other characters cost nothing."""
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            last = domain.end()
            yield begin, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _ips(text: str):
    """Runs of dotted numbers, four by four."""
    for run in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, run.start(), run.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            short = [p.group().lstrip("0") for p in four]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in short):
                yield four[0].start(), four[3].end()


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four kinds, by start, then kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(i, 0, j) for i, j in _emails(text)]
    if _DIGIT.search(text):
        out += [(i, 1, j) for i, j in _ips(text)]
        out += [(i, 2, j) for i, j in _cards(text)]
        if "+" in text:
            out += [(i, 3, j) for i, j in _phones(text)]
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{kind}:{i}:{j}" for i, kind, j in spans)


def named(spans: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    return [(i, KINDS[k], j) for i, k, j in spans]


def _outside(text: str, spans):
    """Matches of terms that no span (start, kind, end) touches."""
    if not spans:
        return _TERM.finditer(text)
    covered = bytearray(len(text))
    for i, _, j in spans:
        covered[i:j] = b"\1" * (j - i)
    return (m for m in _TERM.finditer(text) if covered.find(1, m.start(), m.end()) < 0)


def terms_of(text: str, spans) -> set[str]:
    words = {m.group() for m in _outside(text, spans)} if spans else set(_TERM.findall(text))
    return {w.lower() for w in words}


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    return sorted({f"{KINDS[kind]}:{text[i:j].lower()}" for i, kind, j in spans})


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def different_texts(docs: DataFrame) -> DataFrame:
    """digest, copies, entities (null if none) of each different text."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = ((t, base_spans(t)) for t in (x.as_py() for x in batch.column(1)))
            entities = [entities_of(t, spans) if spans else None for t, spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entities, pa.list_(pa.string()))], names=["digest", "entities"])

    return (_texts(docs).mapInArrow(run, "digest binary, entities array<string>").groupBy("digest")
            .agg(F.count("*").alias("copies"), F.first("entities").alias("entities")))


def one_each(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """digest, text of each different text; only the copied ones are shuffled as texts."""
    texts = _texts(docs)
    return texts.join(copied, "digest", "left_anti").unionByName(texts.join(copied, "digest", "left_semi").dropDuplicates(["digest"]))


def _counted(batches, keys_of, names):
    """Counts of the keys (tuples) of a task's rows; keys_of gives them in parts."""
    from collections import Counter

    import pyarrow as pa

    held: Counter = Counter()

    def out():
        columns = [list(c) for c in zip(*held)] or [[] for _ in names]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(held.values()), pa.int64())], names=[*names, "n"])

    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
            for keys in keys_of(*(x.as_py() for x in row)):
                held.update(keys)
                if len(held) > HELD_TERMS:
                    yield out()
                    held.clear()
    yield out()


def text_counts(texts: DataFrame) -> DataFrame:
    """term, n: different texts that hold each term.  Tasks count up to HELD_TERMS terms
    before they hand them on; the sums are formed after the shuffle."""
    def run(batches):
        return _counted(batches, lambda text: [((t,) for t in terms_of(text, base_spans(text)))], ["term"])

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """entity, term: the terms that give an entity away."""
    found = materialise(different_texts(docs), "different-texts")
    total = float(max(found.count(), 1))
    copied = materialise(found.where("copies > 1").select("digest"), "copied")
    entities = found.select("digest", F.explode("entities").alias("entity"))
    # all texts of an entity hold it, and a term needs the support of as many
    with_entity = materialise(entities.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total)), "entities")
    strong = materialise(entities.join(with_entity, "entity").groupBy("digest").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities")), "texts-of-entities")
    counts = materialise(text_counts(one_each(docs, copied)).where(F.col("n") >= support), "term-counts")
    common = {r["term"]: r["n"] for r in counts.orderBy(F.desc("n"), "term").limit(COMMON).collect()}

    def run(batches):
        def pairs(text, entities):
            terms = terms_of(text, base_spans(text))
            for e in entities:
                # p(e|t) is n_e / n at most, and has to reach (n_e / total) ** (1 - share)
                most = e["n_e"] * (total / e["n_e"]) ** (1 - share) * (1 + 1e-9)
                yield [(e["entity"], t) for t in terms if common.get(t, 0) <= most]

        return _counted(batches, pairs, ["entity", "term"])

    both = (one_each(docs, copied).join(strong, "digest").select("text", "entities").mapInArrow(run, "entity string, term string, n long")
            .groupBy("entity", "term").agg(F.sum("n").alias("both")).where(F.col("both") >= support))
    information = F.log2(F.lit(total) / F.col("n_e"))
    shared = F.log2(F.col("both") / F.col("n") * total / F.col("n_e"))
    return both.join(counts, "term").join(with_entity, "entity").where(shared >= share * information - 1e-12).select("entity", "term")


def _with_terms(rows: DataFrame, docs: DataFrame, held: int = TERMS_HELD) -> tuple[DataFrame, frozenset]:
    """The rows (a column ``text`` among others) with ``terms``, the disclosing terms each may
    hold: null where the returned set applies to every row."""
    terms = materialise(disclosing(docs).select("term").distinct(), "disclosing-terms")
    if terms.count() <= held:
        return rows.withColumn("terms", F.lit(None).cast("array<string>")), frozenset(r["term"] for r in terms.collect())
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                own = sorted(terms_of(t, base_spans(t))) if (t := text.as_py()) else []
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), pa.int64()), pa.array(own, pa.string())], names=["_row", "term"])

    told = rows.select("_row", "text").mapInArrow(run, "_row long, term string").join(terms, "term").groupBy("_row").agg(F.collect_set("term").alias("terms"))
    return rows.join(told, "_row", "left").drop("_row"), frozenset()


def all_spans(text: str, base: list[tuple[int, int, int]], terms) -> list[tuple[int, str, int]]:
    """The base spans and, outside them, those of the terms."""
    out = named(base)
    if terms and not terms_of(text, ()).isdisjoint(terms):
        more = [(m.start(), "term", m.end()) for m in _outside(text, base) if m.group().lower() in terms]
        out = sorted(out + more, key=lambda s: (s[0], (*KINDS, "term").index(s[1])))
    return out


def replaced(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind."""
    out, last = [], 0
    for i, kind, j in spans:
        if i >= last:
            out += [text[last:i], f"[{kind.upper()}]"]
        last = max(last, j)
    return "".join(out) + text[last:]


def judge(docs: DataFrame, held: int = TERMS_HELD) -> DataFrame:
    """doc_id, counts, base_sha256 and all spans of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, common = _with_terms(rows, docs, held)
    columns = ["doc_id", *(f"n_{k}" for k in KINDS)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, base, spans = [[] for _ in KINDS], [], []
            for x, own in zip(batch.column(1), batch.column(2)):
                text = x.as_py() or ""
                found = base_spans(text)
                kinds = [k for _, k, _ in found]
                for k in range(len(KINDS)):
                    counts[k].append(kinds.count(k))
                base.append(listed(named(found)))
                spans.append(listed(all_spans(text, found, common or set(own.as_py() or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                                             names=[*columns, "base", "spans"])

    found = rows.select("doc_id", "text", "terms").mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", base string, spans string")
    return found.select(*columns, F.sha2("base", 256).alias("base_sha256"), "spans")


def sanitise(docs: DataFrame, held: int = TERMS_HELD) -> DataFrame:
    """The documents, all columns as they are but for ``text`` with its spans replaced (and
    ``n_chars`` with its length)."""
    rows, common = _with_terms(whole_rows(docs).withColumn("text", F.col("doc.text").cast("string")), docs, held)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = []
            for x, own in zip(batch.column(1), batch.column(2)):
                text = x.as_py()
                spans = all_spans(text, base_spans(text), common or set(own.as_py() or ())) if text else []
                new.append(replaced(text, spans) if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc", "_text"])

    whole = rows.select("doc", "text", "terms")
    changed = whole.mapInArrow(run, T.StructType([whole.schema["doc"], T.StructField("_text", T.StringType())]))
    new = {"text": F.coalesce("_text", F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_text").isNotNull(), F.length("_text").cast("long")).otherwise(F.col("doc.n_chars"))
    return unwrapped(changed, docs.columns, new)
