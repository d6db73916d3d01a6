import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from partcast.llm import pii, urls

from .util import EDGE, cells, documents, empty, prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "1", "25", "+", "-", " ", "(", "9.9", "é", "12 3", "4111111111111111", "\n"]), max_size=40))
def test_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_no_trouble():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 100_000, "a@" * 50_000):
        pii.base_spans(text)


def secret_docs():
    """One address with a rare name beside it in different surroundings, and other addresses."""
    rows = [(k, f"{prose(k, 30)} agent Zorblax writes from bob@corp.example.com today {prose(k + 50, 30)}") for k in range(300, 305)]
    rows += [(310, prose(310, 40) + " Zorblax was seen there and bob@corp.example.com again")]
    return rows + [(k, prose(k, 60)) for k in range(400, 440)] + [(500, "call +1 (212) 555-0100 or 4111 1111 1111 1111 from 10.0.0.255")]


def test_judge(spark):
    rows = EDGE + secret_docs()
    got = {}
    for r in pii.judge(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in rows:
        spans = plain_spans(text)
        listed = ",".join(f"{pii.KINDS[k]}:{i}:{j}" for i, k, j in spans)
        for r in got[doc_id]:
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
            assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
            assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))
    assert sum(map(len, got.values())) == len(rows)
    text = dict(secret_docs())[300]
    at = text.index("Zorblax")
    assert f"term:{at}:{at + 7}" in got[300][0]["spans"]
    assert "term" not in "".join(r["spans"] for k in range(400, 440) for r in got[k])
    assert pii.judge(empty(spark)).count() == 0


def test_copies_are_no_support_for_each_other(spark):
    rows = [(k, "one agent Zorblax writes from bob@corp.example.com today") for k in range(30)] + [(k, prose(k, 40)) for k in range(100, 130)]
    assert all("term" not in r["spans"] for r in pii.judge(documents(spark, rows)).collect())


def test_sanitise(spark):
    # "from" stands in many texts, so it gives nobody away
    docs = documents(spark, EDGE + secret_docs() + [(k, f"news from {prose(k, 30)}") for k in range(600, 640)])
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "Zorblax" not in text[300] and "[TERM]" in text[300] and "[EMAIL]" in text[300] and "@" not in text[300]
    assert text[500] == "call [PHONE] or [CARD] from [IP]"
    assert text[1] is None and text[400] == prose(400, 60)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_urls(spark):
    found = [("http://A.Example.ORG/en/17?x#y", "a.example.org", "/en/17", "example.org/en/1", "block"),
             ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
             ("http://x.example.org/es/1", "x.example.org", "/es/1", "example.org/es/", "block"), ("ftp://shop.com/fr/", "shop.com", "/fr/", "com/fr/", "allow"),
             ("x://É.com/de/a?b/c", "É.com", "/de/a", "com/de/", "block"), ("http://org", "org", "", None, "allow"), ("no scheme", "", "", None, "allow"),
             (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http://h.net#f/x", "h.net", "", None, "allow"),
             ("http://h.net?q=://z", "h.net", "", None, "allow")]
    rows = [(k, u, "own", "own") for k, (u, *_) in enumerate(found)]
    got = urls.judge(pages(spark, rows + rows[:1]), labels(spark, []))
    assert cells(got) == sorted([(k, *f[1:]) for k, f in enumerate(found)] + [(0, *found[0][1:])], key=repr)
    assert urls.judge(pages(spark, []), labels(spark, [])).count() == 0


def test_a_host_of_bad_pages_is_blocked_and_a_small_one_is_not(spark):
    rows = [(k, f"http://bad.spam.net/{k}") for k in range(60)] + [(k, f"http://s{k % 40}.good.net/{k}") for k in range(100, 400)]
    rows += [(500, "http://new.spam.net/1"), (501, "http://one.fine.net/1")]
    marks = [(k, 0, 0) for k in range(0, 60)] + [(k, 1, 0) for k in range(100, 400)] + [(501, 0, 0)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages(spark, [(*r, "", "") for r in rows]), labels(spark, marks)).collect()}
    assert all(got[k] == "block" for k in range(60))
    assert all(got[k] == "allow" for k in range(100, 400))
    assert got[501] == "allow"


def test_copies_of_texts_hide_no_term(spark):
    rows = [(k, f"{prose(700 + k % 3, 20)} agent Zorblax writes from bob@corp.example.com") for k in range(60)]
    rows += [(k, prose(k, 40)) for k in range(100, 200)]
    got = {r["doc_id"]: r["spans"] for r in pii.judge(documents(spark, rows)).collect()}
    at = rows[0][1].index("Zorblax")
    assert f"term:{at}:{at + 7}" in got[0]


def test_boilerplate_in_different_texts_is_support(spark):
    line = " one two three four agent Zorblax writes here from bob@corp.example.com each day of the week come rain"
    rows = [(k, prose(k, 30) + " x y z" + line) for k in range(20)] + [(k, prose(k, 40)) for k in range(100, 200)]
    got = {r["doc_id"]: r["spans"] for r in pii.judge(documents(spark, rows)).collect()}
    at = rows[0][1].index("Zorblax")
    assert f"term:{at}:{at + 7}" in got[0]


def test_a_term_far_from_the_address(spark):
    rows = [(k, f"Zorblax {prose(k, 60)} bob@corp.example.com") for k in range(20)] + [(k, prose(k, 40)) for k in range(100, 200)]
    got = {r["doc_id"]: r["spans"] for r in pii.judge(documents(spark, rows)).collect()}
    assert "term:0:7" in got[0]


def plain_disclosing(rows, support=3, share=0.9):
    """Terms that give an entity away, from sets of different texts."""
    texts = {t or "" for _, t, *_ in rows}
    spans = {t: pii.base_spans(t) for t in texts}
    terms = {t: {m.group().lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(i < m.end() and m.start() < j for i, _, j in spans[t])} for t in texts}
    entities = {t: {(k, t[i:j].lower()) for i, k, j in spans[t]} for t in texts}
    out = set()
    for e in set().union(*entities.values()):
        with_e = {t for t in texts if e in entities[t]}
        for w in set().union(*(terms[t] for t in with_e)):
            with_w = {t for t in texts if w in terms[t]}
            both, information = len(with_e & with_w), math.log2(len(texts) / len(with_e))
            if both >= support and information > 0 and math.log2(both / len(with_w) * len(texts) / len(with_e)) >= share * information - 1e-12:
                out.add(w)
    return out


def test_disclosure_against_the_plain_way(spark):
    """Every disclosing term is generalised in every document that holds it, and no other;
    with terms held by the tasks and with a join alike."""
    names = ("Zorblax", "Quentin", "Mirabel")
    rows = EDGE + secret_docs() + [(k, f"{prose(k, 25)} {names[k % 3]} of {'north south east'.split()[k % 2]} x{k % 3}@corp.example.com or 10.0.0.{k % 4}") for k in range(700, 730)]
    rows += [(800, "only Zorblax here"), (801, "QUENTIN and mirabel"), (802, prose(9, 50))]
    hidden = plain_disclosing(rows)
    assert {"quentin", "mirabel"} <= hidden and not {"the", "zorblax"} & hidden
    for held in (1000, 0):
        for r in pii.judge(documents(spark, rows), held).collect():
            text = next(t for k, t, *_ in rows if k == r["doc_id"]) or ""
            base = plain_spans(text)
            terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text)
                     if m.group().lower() in hidden and not any(i < m.end() and m.start() < j for i, _, j in base)]
            expected = sorted([(i, k, pii.KINDS[k], j) for i, k, j in base] + [(i, 9, "term", j) for i, j in terms])
            assert r["spans"] == ",".join(f"{kind}:{i}:{j}" for i, _, kind, j in expected)


def test_long_urls(spark):
    """Hosts, paths and queries of any length are read whole."""
    long = "a" * 60_000
    rows = [(1, f"http://{long}.example.org/en/1{long}?{long}", "", ""), (2, f"http://h.net/{long}#x", "", ""), (3, "x" * 100_000, "", ""), (4, "://" * 30_000, "", "")]
    got = {r["page_id"]: r for r in urls.judge(pages(spark, rows), labels(spark, [])).collect()}
    assert got[1]["host"] == f"{long}.example.org" and got[1]["path"] == f"/en/1{long}" and got[1]["rule"] == "example.org/en/1" and got[1]["verdict"] == "block"
    assert got[2]["path"] == f"/{long}" and got[3]["host"] == got[3]["path"] == "" and got[4]["host"] == ":"
