"""Operator 9 against the contract's patterns in Python's re, and the disclosure rule on a planted corpus."""

import hashlib
import random
import re

import pytest

from panelyte.llm.pii import find_personal_data
from panelyte.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[::2] + [x * 2 - 9 * (x > 4) for x in s[1::2]]) % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PLAIN.items():
        spans = []
        for m in re.finditer(pattern, text, re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        out[kind] = spans
    return out


def same(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        told = ",".join(x for k in PLAIN for x in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in PLAIN), (r, told)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (texts[r.doc_id], r.spans, told)
        assert r.spans == told or r.spans.startswith(told + "," if told else "term:")


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    same(rows, texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rnd = random.Random(seed)
    texts = {i: "".join(rnd.choice(["a", "b.", "@", "x@y.c", ".", "-", " ", "1", "25", "4111 1111 1111 1111", "4111111111111111", "+", "+1 (555) 555-0100", "10.0.0.1", "é", "\U0001f600", "_", "%"]) for _ in range(rnd.randint(0, 40))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "1" * 30000, 1003: "a" * 30000 + "@", 1004: "1.2.3.4" * 2000, 1005: "a@b" + ".c" * 5000, 1006: "a@b.c_d@e.f@g.h", 1007: "0" * 400 + ".0000255.1.256"}
    same(find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep_text=False).collect(), texts)


def test_terms_and_cleaning(spark):
    rows = [(i, f"call Zorblax via zor@mail.example now {i}") for i in range(4)] + [(10 + i, f"nothing here via {'abc' * i} word") for i in range(30)]
    rows += [(50, "Zorblax alone"), (51, "a 10.0.0.1@x.y +1 (555) 555-0100 é"), (52, None), (None, "Zorblax"), (50, "Zorblax alone")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, spans string, term int")
    got = find_personal_data(df, disclosure=0.8).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].clean == "[TERM] [TERM] via [EMAIL] now 0"
    assert by[50].clean == "[TERM] alone" and by[50].spans == "term:0:7" and by[None].n_term == 1
    assert by[10].clean == "nothing here via  word" and by[52].clean == ""
    assert by[51].clean == "a [EMAIL] [PHONE] é" and by[51].n_ip == 1
    assert find_personal_data(df.limit(0)).collect() == []


def test_terms_beside_entities_seen_once(spark):
    rows = [(i, f"write Qorvan{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2} soon to person{i}@mail{i % 3}.example about this") for i in range(100)]
    rows += [(1000 + i, f"write about this plain thing number {i}") for i in range(200)] + [(2000, "alone Qorvanaaaaa")]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5].clean == "write [TERM] soon to [EMAIL] about this"
    assert all(got[i].n_term == 1 for i in range(1, 100))
    assert got[0].n_term == 0  # its word is also in a text without the entity
    assert all(got[1000 + i].n_term == 0 for i in range(200))


def test_whole_table_has_terms(spark, sf):
    assert QUERIES["op9_personal_data"](spark, sf).filter("spans like '%term:%'").count() > 0


def test_texts_with_many_spans(spark):
    """Tens of thousands of spans in one text, and cleaning by the rule in plain Python."""
    rnd = random.Random(4)
    kinds = [lambda i: f"u{i}@m{i % 9}.example", lambda i: f"10.{i % 256}.{i // 256 % 256}.7", lambda i: "4111 1111 1111 1111", lambda i: f"+1 555 {1000000 + i}"]
    texts = {1: " ; ".join(kinds[i % 4](i) for i in range(50_000)), 2: " ".join(rnd.choice(kinds)(i) for i in range(700)), 3: "x"}
    rows = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    same(rows.values(), texts)
    for i, text in texts.items():
        found = sorted((s, -e, k) for k, kind in enumerate(PLAIN) for s, e in (map(int, x.split(":")[1:]) for x in brute(text)[kind]))
        out, at = [], 0
        for s, neg, k in found:
            if s >= at:
                out += [text[at:s], f"[{list(PLAIN)[k].upper()}]"]
                at = -neg
        assert rows[i].clean == "".join([*out, text[at:]])


def test_terms_that_touch_entities(spark):
    """A term that overlaps an entity goes, whichever starts first; its other places stay."""
    rows = [(i, f"Zorblax via zor@mail.example now {i}") for i in range(4)] + [(10 + i, f"nothing here {i}") for i in range(30)]
    rows += [(50, "Zorblax@a.b Zorblax x@Zorblax.c Zorblax"), (51, "x@y.Zorblax,Zorblax")]
    got = {r.doc_id: r.clean for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), disclosure=0.5).collect()}
    assert got[0] == "[TERM] via [EMAIL] now 0" and got[50] == "[EMAIL] [TERM] [EMAIL] [TERM]" and got[51] == "[EMAIL],[TERM]"


def test_terms_by_counting(spark, sf):
    """Which terms reveal entities, from counts over whole texts in plain Python."""
    from collections import defaultdict

    import regex

    disclosure, prior, window = 0.95, 0.25, 48
    texts = {r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    word, kinds = regex.compile(r"\p{L}{4,}"), list(PLAIN)
    words = {t: set(word.findall(t)) for t in texts}
    df = defaultdict(int)
    for found in words.values():
        for term in found:
            df[term] += 1
    holders, beside = defaultdict(set), defaultdict(set)
    for t in texts:
        for kind in kinds:
            for s, e in (map(int, x.split(":")[1:]) for x in brute(t)[kind]):
                value = t[s:e].lower()
                digits = re.sub("[^0-9]", "", value)
                group = value.split("@")[-1] if kind == "email" else ".".join(value.split(".")[:3]) if kind == "ip" else digits[:6] if kind == "card" else digits[:4]
                near = set(word.findall(t[max(0, s - window) : s] + " " + t[e : e + window]))
                for key in ((kind,), (kind, group), (kind, group, value)):
                    holders[key].add(t)
                    for term in near:
                        beside[key, term].add(t)
    n, most = len(texts), defaultdict(float)
    for (key, term), _ in beside.items():
        if len(key) == 3 and len(holders[key]) < n:
            share, rest = 0.0, 1.0
            for part in (key[:1], key[:2], key):
                share = (len(beside[part, term]) + prior * share) / (len(holders[part]) + prior)
                rest *= prior / (len(holders[part]) + prior)
            most[term] = max(most[term], n * share / ((n / len(holders[key])) ** disclosure - rest))
    terms = {term for term, limit in most.items() if df[term] <= limit}
    assert terms
    held = {r.doc_id: r for r in find_personal_data(spark.read.parquet(f"{sf}/documents.parquet"), disclosure, prior, window).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        t = r.text or ""
        own = sorted(terms & words[t])
        want = [m.span() for m in regex.finditer(r"(?<!\p{L})(?:" + "|".join(own) + r")(?!\p{L})", t)] if own else []
        assert held[r.doc_id].n_term == len(want)
        assert [x for x in held[r.doc_id].spans.split(",") if x.startswith("term:")] == [f"term:{s}:{e}" for s, e in want]
