"""Operators 2, 3, 4 and 10 against brute force; odd rows for each."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyte.llm.components import components
from panelyte.llm.embed_dedup import embedding_dedup
from panelyte.llm.exact_dedup import drop_copies, exact_dedup
from panelyte.llm.jaccard import PartEnum, Shingler, drop_near_copies, jaccard_join
from panelyte.llm.url_reputation import filter_urls, host_reputation


class Links:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    want = Links({v for e in edges for v in e})
    for a, b in edges:
        want.join(a, b)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: want.find(v) for v in got} and set(got) >= {v for a, b in edges if a != b for v in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


TEXTS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (7, None), (6, ""), (9, "  "), (8, " "), (None, "a b"), (5, "x" * 50000), (4, "x" * 50000), (1, "a b"), (11, "é\u00a0b"), (12, "é b")]


def test_exact_dedup_odd_rows(spark):
    df = spark.createDataFrame([(*t, "k", True) for t in TEXTS], "doc_id long, text string, keep_id string, kept boolean")
    for options in ({}, {"key": lambda d: F.substring(d, 1, 1)}, {"files_per_batch": 1}):
        got = exact_dedup(df, **options).collect()
        groups = defaultdict(list)
        for i, t in TEXTS:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        want = sorted((str(i), str(min(x for x in ids if x is not None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup(df.limit(0)).collect() == []


def test_urls_odd_rows(spark):
    urls = ["http://WWW.Example.com/en/x", "https://a.example.com/en/?q", "http://example.com#f", "x://b.net/es/1", None, "no scheme", "http://org", "http://h.example.net/q", "http://spam.org/", "//", "http://net/fr"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(100 + i, "http://spam.org/p", "v") for i in range(20)] + [(200 + i, f"http://h{i % 9}.org/p", "v") for i in range(60)] + [(None, "http://q.com/", "v")], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(100 + i, 0, None) for i in range(20)] + [(200 + i, 1, 0) for i in range(60)] + [(7, 1, 0), (7, 1, 0), (6, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, labels).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block")
    assert got[2] == ("example.com", "", None, "allow") and got[3][2:] == ("net/es/", "block") and got[4][:2] == got[5][:2] == ("", "")
    assert got[8] == ("spam.org", "/", None, "block") and got[None][2] == "com/" and got[10][2] is None and len(got) == 92
    assert filter_urls(pages, labels.limit(0)).filter("verdict = 'block' and rule is null").count() == 0
    assert filter_urls(pages.limit(0), labels).collect() == []
    hosts = spark.createDataFrame([(1, "a.b.co.uk"), (2, "b.co.uk:8080"), (3, "org:8080"), (4, "x.y.org"), (5, ""), (6, "co.uk"), (7, "a.b.de")], "id long, host string")
    told = {r.host: (r.domain, r.suffix) for r in host_reputation(hosts, spark.createDataFrame([], "id long, bad long"), 1.6, 2.0, 200.0).collect()}
    assert told == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "org:8080": ("org", "org"), "x.y.org": ("y.org", "org"), "": ("", ""), "co.uk": ("co.uk", "uk"), "a.b.de": ("b.de", "de")}


def brute_links(rows, threshold):
    ids = [r[0] for r in rows]
    links, degree = Links([i for i in ids if i is not None]), dict.fromkeys(ids, 0)
    ok = []
    for i, v, label in rows:
        if i is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        ok.append((i, label, x / np.sqrt((x * x).sum())))
    for n, (i, li, a) in enumerate(ok):
        for j, lj, b in ok[n + 1 :]:
            if li == lj and len(a) == len(b) and a @ b >= threshold:
                degree[i] += 1
                degree[j] += 1
                links.join(i, j)
    return {i: (degree[i], links.find(i) if i is not None else None) for i in ids}


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(60):
        centre = rng.standard_normal(64)
        for _ in range(rng.integers(1, 6)):
            rows.append((n, (centre + rng.standard_normal(64) * rng.choice([0, 0.1, 0.22])).tolist(), int(rng.integers(0, 3))))
            n += 1
    odd = [None, [], [0.0] * 64, [1.0, None], [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [1.0, 2.0, 3.0]]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 50, rows[0][1], None), (n + 51, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    want = brute_links(rows, 0.93)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
    assert embedding_dedup(df.limit(0)).collect() == []


def near_texts(seed):
    rnd, out = random.Random(seed), []
    for _ in range(40):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([2, 5, 12, 60, 150, 400]))]
        for _ in range(rnd.randint(1, 6)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 60))):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            out.append(" ".join(words))
    return out + [None, "", " \t", "A b", "a B", "one", "ONE", "a b a b a b a b"]


def brute_jaccard(texts, num, words):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    links, ids = Links(texts), list(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links.join(a, b)
    return {i: (len(sets[i]), links.find(i)) for i in ids}


def test_jaccard(spark):
    texts = dict(enumerate(near_texts(1)))
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_shingles int")
    for num, words, blocks, small, keys in ((90, 3, 1 << 20, 24, 1024), (80, 5, 300, 1, 1024), (80, 5, 1 << 20, 1, 3)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, num=num, words=words, block_features=blocks, small_bucket=small, block_keys=keys).collect()}
        assert got == brute_jaccard(texts, num, words)
    kept = {r.doc_id for r in drop_near_copies(df, num=80, words=5).collect()}
    assert kept == {i for i, (n, c) in brute_jaccard(texts, 80, 5).items() if c == i}
    assert jaccard_join(df.limit(0)).collect() == [] and drop_near_copies(df.limit(0)).collect() == []
    twins = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "q")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in jaccard_join(twins).collect()) == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]


def test_signatures_lose_no_pair():
    rng, sign = np.random.default_rng(2), PartEnum(80)
    for n in [*range(1, 40), 90, 300, 900]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert set(sign(a)) & set(sign(b))
    assert len(Shingler(3)(b"A b C a B c")) == 3


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    """Three runs over one state: each row is held against all earlier ones; a run that is repeated says the same."""
    batches = [[(5, "a  b"), (6, "c"), (7, None), (8, "x" * 30_000)], [(9, "a b"), (3, "c"), (10, ""), (11, "new"), (12, "new")], [(1, "a\tb"), (13, "x" * 30_000), (14, "alone")]]
    held = []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if k != 1:  # the second batch has no files of its own
            df.write.parquet(f"file://{tmp_path}/in{k}")
            df = spark.read.parquet(f"file://{tmp_path}/in{k}")
        held += rows
        groups = defaultdict(list)
        for i, t in held:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in ((i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows))
        for _ in range(2):
            got = exact_dedup(df, state=f"file://{tmp_path}/state", run=str(k))
            assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
    weak = spark.createDataFrame([(20, "other")], "doc_id long, text string")
    with pytest.raises(ValueError, match="several texts"):
        for run, text in (("a", "p"), ("b", "q")):
            exact_dedup(weak.withColumn("text", F.lit(text)), key=lambda d: F.lit("k"), state=f"file://{tmp_path}/weak", run=run).collect()
