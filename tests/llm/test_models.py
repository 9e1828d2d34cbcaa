"""Operators 6 and 7: contract values by brute force, held-out quality; the pipeline stage by stage."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from panelyte.llm.attention_lm import NONE, Model, Shape, Speller, WordEncoder, lm_scores, spell_texts, start_weights, text_slices, train_round, window_batches, window_groups
from panelyte.llm import quality
from panelyte.llm.quality import score_quality

JSON = P.path("byte_bpe_50k.json")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_attention_gradients_and_windows():
    shape = Shape(classes=4, members=3, dim=5, context=2, stride=3)
    w = {k: v.astype(np.float64) for k, v in start_weights(shape, np.arange(12.0)[::-1] + 1).items()}
    model, rng = Model(shape, w), np.random.default_rng(0)
    ids = rng.integers(0, 12, 10)
    x, y = model.windows(ids, 0)
    assert y[y != NONE].tolist() == ids.tolist() and x.shape == (4, 5) and x[1].tolist() == ids[0:5].tolist()
    total = sum(math.exp(model.log_probs(x[:1], np.array([[k, NONE, NONE]], np.uint16))[0, 0]) for k in range(12))
    assert abs(total - 1) < 1e-5
    before = model.log_probs(x, y).sum()
    changed = x.copy()
    changed[0, -1] = (changed[0, -1] + 1) % 12  # the last input only reaches the last target
    assert np.allclose(model.log_probs(changed, y)[0, :2], model.log_probs(x, y)[0, :2])
    gradients = model.gradients(x, y, some=2)
    assert set(gradients) == set(w)
    for key, grad in gradients.items():  # each against a difference quotient of the mean log probability
        for at in [tuple(rng.integers(0, n) for n in grad.shape) for _ in range(6)]:
            there = []
            for step in (1e-2, -1e-2):
                moved = {k: v.copy() for k, v in w.items()}
                moved[key][at] += step
                there.append(Model(shape, moved).log_probs(x, y).sum(dtype=np.float64) / len(ids))
            assert abs(-(there[0] - there[1]) / 2e-2 - grad[at]) < 2e-3, key
    for _ in range(60):
        model.learn(x, y, 0.02)
    assert model.log_probs(x, y).sum() > before + 5


def test_lm_scores(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(["the", "cat", "Sat", "on", "mat", "naïve", "x9"], 30))) for i in range(120)] + [(500, None), (501, ""), (None, "the zebra"), (3, "the cat")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    words = [((t or "").encode().lower().split() + [b""], i is not None and fold(i, 7) == 2) for i, t in rows]
    c = Counter(w for ws, out in words if not out for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm_scores(df, JSON, head_size=4).collect()
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6), out) for ws, out in words)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    long = [r for r in got if r.n_tokens == 31]
    assert sum(r.score for r in long) / len(long) > -31 * 2.0
    assert lm_scores(df.limit(0), JSON).collect() == []


def test_lm_scores_long_texts_and_layouts(spark):
    """A very long text is scored whole, and neither the number of partitions nor their order changes a score."""
    rows = [(i, " ".join(np.random.default_rng(i).choice(["the", "cat", "sat", "on", "mat"], 40))) for i in range(60)] + [(99, "the cat sat on " * 60_000)]
    few, many = (spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n) for n, step in ((1, 1), (7, -1)))
    a, b = ({r.doc_id: r.score for r in lm_scores(d, JSON, shard_tokens=20_000).collect()} for d in (few, many))
    assert len(a) == 61 and a[99] < a[0] < 0 and all(abs(a[i] - b[i]) < 1e-3 * abs(a[i]) for i in a)


def test_every_token_is_trained_on(spark):
    model = Model(Shape(), {})
    texts = [np.arange(1, 1 + n).astype(np.uint16) for n in (1, 24, 25, 700)]
    want = sorted([0] * len(texts) + np.concatenate(texts).tolist())
    for size, most in ((1, 5), (24, 7), (512, 1 << 15)):
        batches = list(window_batches(window_groups(model, [t.tobytes() for t in texts], 0, most), size, np.random.default_rng(0)))
        assert sorted(int(t) for _, y in batches for t in y[y != NONE]) == want and all(len(x) == size for x, _ in batches[:-1])


def test_training_rounds(spark):
    """Every shard counts in the average, whatever the layout; the sums are exact."""
    shape = Shape(classes=4, members=4, dim=4)
    rng, start = np.random.default_rng(1), start_weights(shape, np.ones(16))
    rows = [(int(k % 3), k, bytearray(rng.integers(1, 16, 50 + k).astype(np.uint16).tobytes())) for k in range(12)]
    after = [train_round(spark.createDataFrame(rows[::step], "shard int, mark long, ids binary").repartition(n), start, shape, 0, 3, 8, (0.02, 0.01)) for n, step in ((1, 1), (5, -1))]
    assert all(np.array_equal(after[0][k], after[1][k]) and not np.array_equal(after[0][k], start[k]) for k in start)
    models, tokens = [], []
    for s in range(3):
        model, held = Model(shape, {k: v.copy() for k, v in start.items()}), [bytes(r[2]) for r in rows if r[0] == s]
        n, seen = sum(len(t) // 2 + 1 for t in held), 0
        for x, y in window_batches(window_groups(model, held, 0), 8, np.random.default_rng(s)):
            model.learn(x, y, 0.02 * 0.5 ** (seen / n))
            seen += int((y != NONE).sum())
        models.append(model.w)
        tokens.append(n)
    assert all(np.allclose(after[0][k], np.average([m[k] for m in models], axis=0, weights=tokens), atol=1e-3) for k in start)
    none = spark.createDataFrame([], "shard int, mark long, ids binary")
    assert train_round(none, start, shape, 0, 3, 8, (0.02, 0.01)) is start


def test_held_out_texts_score_above_the_base(spark, sf):
    """With the registered settings, on whole documents at sf0.1."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    held = lm_scores(docs, JSON).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"] > -5 * held["sum(n_tokens)"]


def test_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in marks if fold(i, 3) == 1]
    assert len(got) == docs.count() and all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == marks[i] for i in held]) > 0.95
    odd = spark.createDataFrame([(None, None, "q"), (1, "", "q"), (1, "word " * 30000, "q")], "doc_id long, text string, score string")
    rows = score_quality(odd, labels.limit(0)).collect()
    assert [(r.score, r.predicted, r.held_out) for r in rows] == [(0.5, 1, False), (0.5, 1, fold(1, 3) == 1), (0.5, 1, fold(1, 3) == 1)]
    assert score_quality(odd.limit(0), labels).collect() == []


def plain_score(text, weights, bits=18, scale=20.0):
    """The classifier's score, feature by feature in Python integers."""
    mask = (1 << 64) - 1
    k = [int(x) for x in quality._K]
    words = quality._TOKEN.findall(text)
    hashes = [(xxhash.xxh32_intdigest(w.encode()), xxhash.xxh32_intdigest(quality.shape(w).encode())) for w in words]
    w = [a for a, _ in hashes]
    f = [b if i == 0 else b * 2 + (w[i] == w[i - 1]) for i, (_, b) in enumerate(hashes)]
    grams = [(x + 1) * k[0] for x in w] + [(a * k[1] + b + 2) * k[0] for a, b in zip(w, w[1:])] + [(a * k[2] + b + 3) * k[3] for a, b in zip(f, f[1:])] + [((a * k[2] + b) * k[1] + c + 4) * k[3] for a, b, c in zip(f, f[1:], f[2:])]
    total = 0.0
    for g in grams:
        g &= mask
        total += float(weights[((g ^ (g >> 29)) * k[0] & mask) >> (64 - bits)])
    return total * scale / max(len(grams), 1) + float(weights[-1])


def odd_documents(spark, sf):
    """Documents of the smallest table with null ids and texts, empty and long texts, copies, near copies, ties and a
    column whose name the operators use themselves."""
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(60).collect()]
    base = " ".join(f"word{i}" for i in range(200))
    text = real[3][1]
    more = [(900, None, "en", "s", None), (901, "", "en", "s", 0), (902, base, "en", "s", 1), (903, base.replace("word7 ", "other "), "en", "s", 1), (904, base.replace(" ", "  "), None, None, 1), (None, base, "en", "s", 1), (905, text, "en", "s", 1), (905, text, "en", "s", 1), (906, "mail me at a.b@example.org or +49 30 1234567 now", "en", "s", 1), (907, "long " * 60_000, "en", "s", 1)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in real + more], "doc_id long, text string, lang string, source string, n_chars long, __at string, __text string, row string")


def test_pipeline_stages_by_brute_force(spark, sf):
    docs = odd_documents(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "packing"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    weights, rows = quality.fit(docs, labels), docs.collect()
    key = lambda r: (str(r.doc_id), r.text or "")
    kept = stages["quality classifier"](spark, docs, sf).collect()
    scores = [plain_score(r.text or "", weights) for r in rows]
    sure = [(r, s) for r, s in zip(rows, scores) if abs(s) > 1e-4]
    assert {key(r) for r, s in sure if s > 0} <= {key(r) for r in kept} and not {key(r) for r, s in sure if s < 0} & {key(r) for r in kept}

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    exact = stages["exact dedup"](spark, docs, sf)
    assert exact.columns == corpus_pipeline.COLUMNS
    assert sorted((norm(r.text), str(r.doc_id)) for r in exact.collect()) == sorted((t, str(i)) for t, i in least.items())

    near = sorted(str(r.doc_id) for r in stages["n-gram Jaccard join"](spark, docs, sf).collect())
    sets = [set(zip(*[w[k:] for k in range(min(5, len(w)))])) if (w := (r.text or "").encode().lower().split()) else set() for r in rows]
    up = list(range(len(rows)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(find(i), []).append(r)
    # equal rows stay together, so a group's first row counts as often as it is repeated
    first = [min(m, key=lambda r: (r.doc_id is None, r.doc_id or 0)).doc_id for m in members.values()]
    want = [str(r.doc_id) for i, r in enumerate(rows) if not sets[i] or r.doc_id in first and r.doc_id == min((x.doc_id for x in members[find(i)] if x.doc_id is not None), default=None)]
    assert near == sorted(want)

    clean = {key_of.doc_id: key_of for key_of in stages["PII"](spark, docs.filter("doc_id > 899"), sf).collect()}
    assert "at [EMAIL] or [PHONE] " in clean[906].text and clean[900].text == "" and clean[907].n_chars == 300_000 and clean[902].text == rows[-8].text
    assert all(r.n_chars == len(r.text) for r in clean.values())

    pieces = stages["packing"](spark, docs, sf).collect()
    encode = Tokenizer.from_file(JSON).encode
    lengths = Counter(len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(p.length for p in pieces) == sum(n * k for n, k in lengths.items()) and {p.doc_id for p in pieces} == {r.doc_id for r in rows}
    assert all(stage(spark, docs.limit(0), sf).collect() == [] for _, stage in corpus_pipeline.STAGES)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "packing"]
    now, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = corpus_pipeline.materialize(stage(spark, now, sf), "test")
        assert now.columns == docs.columns
        kept = {r.doc_id: r.text for r in now.collect()}
        assert kept.keys() <= texts.keys() and len(kept) > 0.5 * len(texts), name
        texts = kept
    assert all("@mail" not in t for t in texts.values())
    pieces = corpus_pipeline.STAGES[4][1](spark, now, sf).collect()
    assert {p.doc_id for p in pieces} == texts.keys()


def test_ftrl_by_coordinates():
    """Weights against the update rule, one coordinate after another in plain Python."""
    import math

    rnd = np.random.default_rng(5)
    rows = [(rnd.integers(0, 16, rnd.integers(0, 12)), int(rnd.integers(0, 2))) for _ in range(40)]
    bits, scale, epochs, alpha, beta, l1, l2 = 4, 20.0, 2, 0.5, 1.0, 0.3, 0.02
    got = quality.train_ftrl(rows, bits, scale, epochs, alpha, beta, l1, l2, 9)
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    order = np.random.default_rng(9)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, y = rows[k]
            x = {int(i): (idx == i).sum() * scale / max(len(idx), 1) for i in idx} | {16: 1.0}
            w = {i: weight(i) for i in x}
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in x.items()))))) - y
            for i, v in x.items():
                g = miss * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(17)], atol=1e-12) and (got == 0).any() and (got != 0).any()


def test_a_text_of_many_windows_token_by_token():
    """The score of a whole text against attention that is written out for each token: it sees the tokens before it that
    its window holds, each token is scored once, and classes and members multiply."""
    shape = Shape(classes=4, members=3, dim=5, context=2, stride=3)
    rnd = np.random.default_rng(3)
    weights = {k: rnd.normal(0, 0.3, s).astype(np.float32) for k, s in shape.arrays().items()}
    end, many = 5, shape.classes * shape.members
    ids = rnd.integers(0, many, 5 * shape.stride + 3).astype(np.uint16)
    model = Model(shape, weights)
    x, y = model.windows(ids, end)
    got = model.log_probs(x, y).ravel()[: len(ids)]
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    inputs = [end, *ids[:-1].tolist()]  # what stands before each token
    for t, target in enumerate(ids.tolist()):
        first = t // shape.stride * shape.stride - shape.context  # where the token's window starts
        seen = [(inputs[p] if p >= 0 else end, p - first) for p in range(first, t + 1)]
        X = np.array([w["E"][token] + w["P"][place] for token, place in seen])
        a = np.exp(X @ (X[-1] @ w["Q"]))
        h = X[-1] + (a / a.sum()) @ X @ w["O"]
        outer = np.exp(h @ w["C"] + w["c"])
        c, m = divmod(target, shape.members)
        inner = np.exp(h @ w["M"][c] + w["m"][c])
        assert abs(got[t] - np.log(outer[c] / outer.sum()) - np.log(inner[m] / inner.sum())) < 2e-4
    assert len(x) == 6 and np.isfinite(got).all()


def test_attention_is_computed_once_for_a_step():
    shape = Shape(classes=4, members=4, dim=4)
    model, calls = Model(shape, start_weights(shape, np.ones(16))), []
    attend = model._attend
    model._attend = lambda x: calls.append(len(x)) or attend(x)
    x, y = model.windows(np.random.default_rng(2).integers(0, 16, 24 * 10).astype(np.uint16), 0)
    got = model.gradients(x, y, some=4)
    assert calls == [4, 4, 2]
    whole = model.gradients(x, y)
    assert all(np.allclose(got[k], whole[k], atol=1e-6) for k in whole)
    model.w["Q"] *= 1e4  # logits beyond the bounds stay finite
    assert np.isfinite(model.log_probs(x, y)).all() and all(np.isfinite(g).all() for g in model.gradients(x, y).values())


def test_scores_of_far_logits_are_those_of_the_softmax():
    """Logits of any size against the model in double precision less the greatest logit, at all three softmaxes."""
    shape = Shape(classes=4, members=3, dim=6, context=2, stride=3)
    rnd = np.random.default_rng(8)
    ids = rnd.integers(0, 12, 4 * shape.stride - 1).astype(np.uint16)
    inputs = [7, *ids[:-1].tolist()]

    def plain(w, t):
        first = t // shape.stride * shape.stride - shape.context
        X = np.array([w["E"][inputs[p] if p >= 0 else 7] + w["P"][p - first] for p in range(first, t + 1)])
        soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        h = X[-1] + soft(X @ (X[-1] @ w["Q"])) @ X @ w["O"]
        c, m = divmod(int(ids[t]), shape.members)
        return np.log(soft(h @ w["C"] + w["c"])[c]) + np.log(soft(h @ w["M"][c] + w["m"][c])[m])

    for key, add in (("Q", 0), ("c", 60), ("c", -120), ("m", 200), ("m", -60)):
        weights = {k: rnd.normal(0, 0.3, s).astype(np.float32) for k, s in shape.arrays().items()}
        weights[key] += np.float32(add)  # the same for all of one softmax, so it may not change a score
        if key == "Q":
            weights[key] = (np.eye(shape.dim) * 150).astype(np.float32) * np.sign(rnd.normal(size=shape.dim)).astype(np.float32)
        model = Model(shape, weights)
        x, y = model.windows(ids, 7)
        got, w = model.log_probs(x, y).ravel(), {k: v.astype(np.float64) for k, v in weights.items()}
        assert np.allclose(got[: len(ids)], [plain(w, t) for t in range(len(ids))], atol=2e-3), (key, add)
        assert got[len(ids) :].tolist() == [0] and all(np.isfinite(g).all() for g in model.gradients(x, y).values())


def test_texts_are_spelled_by_their_distinct_words(spark):
    """Ids, known words and other words of texts, text by text in plain Python; each distinct word is asked for once."""
    tok = Tokenizer.from_file(JSON)
    spelled = [np.array([i % 1000, i // 1000], np.uint16)[: 1 + i % 2].tobytes() for i in range(max(tok.get_vocab().values()) + 1)]
    whole, asked = Speller(JSON, spelled, cache_size=8), []
    spell = lambda words: asked.extend(words) or whole(words)
    texts = ["", "  The cat\x0b\x0cthe\tCAT ", " \n\r", "na\u00efve \u00a0 \u3000x a\x1cb \u00c9t\u00c9", "x" * 5000 + " the", "[UNK] <s> x9 x9 x9", "\u00a0 \u00a0 y"]
    known = {b"the": -1.5, b"x9": -2.0}
    ids, n, hits, near, far, times = (a.to_pylist() for a in spell_texts(pa.array([t.encode() for t in texts], pa.binary()), spell, known))
    words = [t.encode().lower().split() for t in texts]
    assert sorted(asked) == sorted({w for ws in words for w in ws})
    alone = WordEncoder(JSON).encode
    for k, ws in enumerate(words):
        assert ids[k] == b"".join(spelled[i] for w in ws for i in alone([" " + w.decode()])[0]) and n[k] == len(ws)
        assert hits[k] == sum(w in known for w in ws) and abs(near[k] - sum(known.get(w, 0) for w in ws)) < 1e-9
        assert dict(zip(far[k], times[k])) == Counter(w for w in ws if w not in known)
    assert list(text_slices(pa.array([b"ab", b"", b"abcdef", b"a", b"b"], pa.binary()), 3)) == [(0, 2), (2, 3), (3, 5)]
