"""Operators 11 to 13 against brute force and SQL; odd rows for each."""

import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyte.llm import lexical_search
from panelyte.llm.chat_format import escape, format_conversations, parse, read_back, render, unescape
from panelyte.llm.lexical_search import Postings, evaluate, search
from panelyte.llm.queries import ORACLE_SQL, QUERIES
from panelyte.llm.repair import Conversation, damaged, repair_conversations

CLASH = "conv_id long, turn long, role string, text string, chunk string, conv string, loss int"


@pytest.mark.parametrize("name", ["op11_chat_format", "op13_lexical_search"])
def test_whole_tables_by_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# Chat formatting


PARTS = ["[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "</s>", "\\", "\\\\", " ", "a", "\n", "é", "[INS", "T]", ""]


def test_every_turn_comes_back():
    rnd = random.Random(5)
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "system", "", "tool", "[TEXT]", "a\\ [/ROLE]"]), "".join(rnd.choices(PARTS, k=rnd.randrange(7)))) for _ in range(rnd.randrange(1, 5))]
        text = "".join(render(*t)[0] for t in turns)
        assert [t[:2] for t in parse(text)] == turns
        for role, said, start, end in parse(text):
            assert unescape(text[start:end]) == said


def test_only_conflicts_are_escaped():
    assert render("user", "a \\ b [INST c")[0] == "[INST] a \\ b [INST c [/INST]"
    assert render("user", "</s>[INST] ok [/INST]")[0] == "[INST] \\</s>\\[INST] ok \\[/INST] [/INST]"
    assert render("assistant", "a\\</s>") == (" a\\\\</s> </s>", 1, 8)
    assert escape("no control \\") == "no control \\"


def told(turns):
    h, loss = hashlib.sha256(), "".join(t for r, t in turns if r == "assistant")
    for r, t in turns:
        h.update(f"{r}\n{t}\n".encode())
    return len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_format_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, ""), (2, 3, "tool", "</s>"), (2, 1, "assistant", "x" * 400_000),
        (2, 2, "assistant", "[INST] " * 1000), (None, 0, "user", "é"), (None, 0, "assistant", "\U0001f600"), (3, 0, "", "\\[/ROLE]"),
    ]
    df = spark.createDataFrame([(*r, "k", "k", 1) for r in rows], CLASH)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    want = {c: told([t[1:] for t in sorted(g)]) for c, g in groups.items()}
    for options in ({}, {"chunk_chars": 5}):
        formatted = format_conversations(df, **options)
        assert {r.conv_id: tuple(r)[1:5] for r in read_back(formatted).collect()} == want
        chunks = formatted.collect()
        assert {(r.conv_id, r.chunk) for r in chunks} == {(c, k) for c, n in Counter(r.conv_id for r in chunks).items() for k in range(n)}
    assert max(Counter(r.conv_id for r in chunks).values()) > 2
    assert read_back(format_conversations(df.limit(0))).collect() == []


# Repair


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        rest = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_force(rows, most_inserts):
    """Cheapest (cost, audit, repaired) over all edits with so many inserts."""
    best, kinds = None, faults(rows)
    choices = [["D"] if k in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for k in kinds]
    for edits in itertools.product(*choices):
        for count in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), count):
                for roles in itertools.product("ua", repeat=count):
                    cost, audit, out = 0, "", []
                    for i in range(len(rows) + 1):
                        for place, r in zip(places, roles, strict=True):
                            if place == i:
                                cost, audit, out = cost + 2, audit + "I", [*out, ({"u": "user", "a": "assistant"}[r], "")]
                        if i < len(rows):
                            audit += edits[i][0]
                            cost += {"K": 0, "R": 2, "D": 3}[edits[i][0]] + (edits[i] != "D" and kinds[i] == "truncated")
                            if edits[i] != "D":
                                out.append(({"K": rows[i][0], "Ru": "user", "Ra": "assistant"}[edits[i]], rows[i][1]))
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                        best = (cost, audit, out)
    return best


def test_cheapest_repair_by_brute_force():
    rnd = random.Random(11)
    for _ in range(120):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b!", "c", " ", "d?"])) for _ in range(rnd.randrange(5))]
        for block in (1, 2, 1024):
            state = Conversation(block, 1 << 20, True)
            for i, r in enumerate(rows):
                state.add(i, *r)
            report = state.end()
            cost, audit, out = brute_force(rows, 3 if len(rows) < 4 else 2)
            assert report[5:7] == (cost, audit) and report[8] == out
            assert report[7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_blocks_do_not_change_a_long_repair():
    rnd = random.Random(2)
    rows = [(rnd.choice(["user", "assistant", "system"]), f"{rnd.randrange(400)}" + rnd.choice([".", "", "?"])) for _ in range(600)]
    got = []
    for block, most in ((1, 10), (7, 50), (64, 100_000), (1024, 100_000)):
        state = Conversation(block, 1 << 20, True)
        state.seen.most = most
        for i, r in enumerate(rows):
            state.add(i, *r)
        got.append(state.end())
    assert got[0] == got[1] == got[2] == got[3]
    assert got[0][2] == faults(rows).count("duplicate") > 0


def test_repair_odd_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, 5, "assistant", "x." * 100_000), (2, None, None, None), (3, 0, "user", "a."), (3, 0, "user", "a."), (None, 0, "user", "q?"), (None, 1, "assistant", "a.")]
    df = spark.createDataFrame([(*r, "k", "k", 1) for r in rows], CLASH)
    got = {r.conv_id: r for r in repair_conversations(df).collect()}
    assert (got[1].gaps, got[1].audit, got[1].cost) == (4, "KK", 0) and [t.role for t in got[1].turns] == ["user", "assistant"]
    assert (got[2].blank, got[2].audit, got[2].gaps, got[2].turns) == (1, "D", 0, []) and got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[3].duplicate, got[3].audit, got[3].cost, got[3].illegal) == (1, "KDI", 5, 1)
    assert got[None].audit == "KK"
    gone = repair_conversations(df, gone=F.lit(True), keep_turns=False).collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(gone) == 4
    assert repair_conversations(df.limit(0)).collect() == []


def test_repair_of_the_damaged_table(spark, sf):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turn, role, text = r.turn, r.role or " ", r.text or " "
        kind = zlib.crc32(f"{r.conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[r.conv_id] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: r for r in QUERIES["op12_repair"](spark, sf).collect()}
    assert set(got) == set(groups)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        kinds, r = Counter(faults([x[1:] for x in rows])), got[conv]
        assert (r.blank, r.duplicate, r.truncated) == (kinds["blank"], kinds["duplicate"], kinds["truncated"])
        assert r.illegal == sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        assert r.gaps == (rows[-1][0] - rows[0][0] + 1 - len({x[0] for x in rows}) if rows else 0)
        if len(rows) <= 4:
            cost, audit, out = brute_force([x[1:] for x in rows], 2)
            assert (r.cost, r.audit) == (cost, audit)
            assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    assert damaged(spark.read.parquet(f"{sf}/conversations.parquet").limit(0)).collect() == []


# Search


def ranked(docs, items, k):
    terms = {i: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))) for i, (_, t) in enumerate(docs)}
    terms = {i: c for i, c in terms.items() if c}
    n, total, df = len(terms), sum(sum(c.values()) for c in terms.values()), Counter(t for c in terms.values() for t in c)
    wanted = defaultdict(Counter)
    for item, text in items:
        wanted[item].update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")))
    out = []
    for item, query in wanted.items():
        scores = []
        for i, c in terms.items():
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in query.items() if c[t])
            scores += [(-s, docs[i][0])] if s > 0 else []
        scores.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def test_search_by_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["É", "été", "A1"]
    docs = [(i % 190, " ".join(rnd.choices(words, k=rnd.randrange(1, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, "- ."), (None, "w1 w2"), (503, "W1" + " w2" * 3000), (504, "x" * 50_000)]
    docs += [(600 + i, "same w3 w5 text") for i in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=12))) for i in range(25)] + [(30, "same text w3"), (31, None), (32, "unheard"), (None, "W1-w2"), (33, "w3 w3"), (33, "w5"), (34, "été é É " + "x" * 50_000)]
    frames = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string")
    want = ranked(docs, items, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for options in ({}, {"most_terms": 40}):
            assert sorted(map(tuple, search(*frames, k=5, **options).collect()), key=repr) == want
        monkeypatch.setattr(lexical_search, "SLICE", 64)
        assert sorted(map(tuple, search(*frames, k=5).collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert search(frames[0].limit(0), frames[1]).collect() == search(frames[0], frames[1].limit(0)).collect() == []


def test_accumulators_are_limited():
    """Once the rest cannot reach the kth best, common terms create none, and the best are still exact."""
    rnd = np.random.default_rng(3)
    rare, size = [(d, 0, 1) for d in range(0, 300, 10)], 300
    common = [(d, t, int(rnd.integers(1, 5))) for t in range(1, 6) for d in range(size)]
    rows = sorted(rare + common)
    sizes = np.bincount([r[0] for r in rows], minlength=size)
    block = Postings(np.full(size, 50), sizes, np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows]), size, 50 * size)
    plan = [(0, 9000), *((t, 20) for t in range(1, 6))]
    scores, created = evaluate(plan, block, 20, 0)
    whole = np.zeros(size, np.int64)
    for t, w in plan:
        lo, hi = block.span[t]
        np.add.at(whole, block.doc[lo:hi], w * block.worth[lo:hi])
    assert created == 1 and (scores > 0).sum() == 30
    assert np.array_equal(np.sort(scores)[-20:], np.sort(whole)[-20:])
