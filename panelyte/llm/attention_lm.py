"""Language-model scores by a causal self-attention model over subword ids, in numpy.

Text: A-Z lower-cased words (runs of other than ASCII white space), then one end. Each word is spelled in subword ids
of a given byte-level BPE file; the model's vocabulary is the ids that are most frequent in all training texts and the
256 single bytes, in which rarer ids are spelled, so every text has a probability.

Model: token and place embeddings, one causal attention head over a window, a residual, and a two-level softmax
(class, then member) whose biases start from the corpus counts. With one head, the query and key matrices act as one
product, and so do the value and output matrices; the model holds these two products (Q and O). A text is cut into overlapping windows: `context`
tokens that were scored before and `stride` tokens that are scored here, so each token is scored once, with whole
batches of windows in one masked attention.

Corpus side: word counts over all training texts (partial counts in tasks, summed by word), subword counts from them,
then one pass that spells every text, in which a distinct word of a few MB of texts is spelled and looked up once.
Training learns from every window of every training text once. Texts are dealt
to shards by a hash, as many as the corpus's tokens need, and to rounds; each shard learns its texts in a fixed order
from the weights of the round before, and the shards' weights are averaged by tokens in whole numbers. So the weights
follow from the table and the parameters, not from the number of files, tasks or executors. The exact word counts are
joined back to the texts' words: frequent words by a bounded broadcast table, the others by a shuffle.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.pieces import LONG, PieceCache, byte_alphabet, load_tokenizer, piece_encoder, worker_cache
from panelyte.llm.shared import fold_of, materialize

LOG10 = math.log(10)
NONE = np.uint16(65535)  # no target


class Shape:
    """Sizes of the model and of its windows."""

    def __init__(self, classes: int = 32, members: int = 32, dim: int = 24, context: int = 8, stride: int = 24):
        self.classes, self.members, self.dim, self.context, self.stride = classes, members, dim, context, stride
        self.vocabulary, self.window = classes * members, context + stride

    def arrays(self) -> dict[str, tuple[int, ...]]:
        v, d, c, m = self.vocabulary, self.dim, self.classes, self.members
        return {"E": (v, d), "P": (self.window, d), "Q": (d, d), "O": (d, d), "C": (d, c), "c": (c,), "M": (c, d, m), "m": (c, m)}


def start_weights(shape: Shape, counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; output biases from the counts of the vocabulary's ids."""
    rng, d = np.random.default_rng(seed), shape.dim
    size = {"E": 0.3, "P": 0.3, "Q": 0.5 / d, "O": 0.5 / math.sqrt(d), "C": 0.05, "M": 0.05}
    w = {k: (rng.standard_normal(s) * size.get(k, 0)).astype(np.float32) for k, s in shape.arrays().items()}
    share = (counts + 0.5).reshape(shape.classes, shape.members)
    w["c"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    w["m"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return w


def keep_heap(size: int = 1 << 26) -> None:
    """Let the C library keep up to `size` bytes of freed arrays for the next ones: otherwise every temporary of a
    batch is mapped and zeroed anew, which costs as much as the arithmetic. Without that library, nothing happens."""
    try:
        set_option = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    for option in (-1, -3):  # when to give memory back, and from which size on to map
        set_option(option, size)


def _sums(p: np.ndarray) -> np.ndarray:
    return np.ones(len(p), np.float32) @ p


def _exps(logits, ones: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of what `logits` gives, 0 where not `seen`, and their sums by row. Only where a sum leaves the safe
    range, which the sums themselves tell, is everything done again less each row's greatest logit."""
    with np.errstate(over="ignore", invalid="ignore"):
        p = logits()
        np.exp(p, out=p)
        if seen is not None:
            p *= seen
        total = p.reshape(-1, len(ones)) @ ones
    if total.size and not (total.min() > 1e-20 and total.max() < 1e20):
        p = logits()
        if seen is not None:
            p[:, seen == 0] = -np.inf
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        total = p.reshape(-1, len(ones)) @ ones
    return p, total


class Model:
    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]):
        self.shape, self.w = shape, weights
        i, j = np.arange(shape.stride)[:, None] + shape.context, np.arange(shape.window)[None, :]
        self.seen = (j <= i).astype(np.float32)
        self.ones = np.ones(max(shape.window, shape.classes, shape.members, shape.dim), np.float32)
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}
        self.steps = 0

    def windows(self, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, targets) of one text's ids, the end included: targets past the text are NONE."""
        s, c = self.shape.stride, self.shape.context
        n = -(-len(ids) // s)
        x = np.full(c + n * s, end, np.uint16)
        x[c + 1 : c + len(ids)] = ids[:-1]
        y = np.full(n * s, NONE, np.uint16)
        y[: len(ids)] = ids
        return np.lib.stride_tricks.sliding_window_view(x, self.shape.window)[::s], y.reshape(n, s)

    def _attend(self, x: np.ndarray):
        """What a few windows' masked attention holds, and last what the softmax sees at the scored places."""
        w, d, c0 = self.w, self.shape.dim, self.shape.context
        X = np.take(w["E"], x, axis=0)
        X += w["P"]
        own = np.ascontiguousarray(X[:, c0:]).reshape(-1, d)
        q = (own @ w["Q"]).reshape(-1, self.shape.stride, d)
        A, total = _exps(lambda: q @ X.transpose(0, 2, 1), self.ones[: self.shape.window], self.seen)
        share = 1 / total
        mixed = (A @ X).reshape(-1, d)
        mixed *= share[:, None]
        return X, own, q, A, share, mixed, own + mixed @ w["O"]

    def _by_target(self, y: np.ndarray):
        """(places of the targets in the order of their ids, the ids, where each class begins)."""
        order = np.argsort(y.ravel(), kind="stable")
        t = y.ravel()[order]
        n = int(np.searchsorted(t, NONE))
        order, t = order[:n], t[:n].astype(np.int64)
        return order, t, np.searchsorted(t, np.arange(self.shape.classes + 1) * self.shape.members).tolist()

    def _levels(self, h: np.ndarray, ends: list[int]):
        """Exponentials of the logits of classes, and of members inside each row's class, with their row sums."""
        w, m = self.w, self.shape.members

        def classes():
            outer = h @ w["C"]
            outer += w["c"]
            return outer

        def members():
            inner = np.empty((len(h), m), np.float32)
            for c, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                if lo < hi:
                    np.matmul(h[lo:hi], w["M"][c], out=inner[lo:hi])
                    inner[lo:hi] += w["m"][c]
            return inner

        return *_exps(classes, self.ones[: self.shape.classes]), *_exps(members, self.ones[:m])

    def _states(self, x: np.ndarray, some: int, kept: list | None = None) -> np.ndarray:
        """The softmax's inputs at all scored places, a few windows at a time so that they stay in the cache; what the
        attention of these held is added to `kept`."""
        stride = self.shape.stride
        H = np.empty((len(x) * stride, self.shape.dim), np.float32)
        for lo in range(0, len(x), some):
            *held, H[lo * stride : (lo + some) * stride] = self._attend(x[lo : lo + some])
            if kept is not None:
                kept.append(held)
        return H

    def log_probs(self, x: np.ndarray, y: np.ndarray, some: int = 128) -> np.ndarray:
        """Natural log probability of each target, 0 where there is none."""
        H = self._states(x, some)
        order, t, ends = self._by_target(y)
        outer, outer_sum, inner, inner_sum = self._levels(np.take(H, order, axis=0), ends)
        rows, cls = np.arange(len(t)), t // self.shape.members
        full = np.zeros(y.size, np.float32)
        full[order] = np.log(outer[rows, cls] / outer_sum) + np.log(inner[rows, t - cls * self.shape.members] / inner_sum)
        return full.reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray, some: int = 128) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the targets. What the attention of the batch held is kept for the
        way back, in blocks that a heap which is not given back finds again (keep_heap)."""
        w, d, m, c0, stride = self.w, self.shape.dim, self.shape.members, self.shape.context, self.shape.stride
        order, t, ends = self._by_target(y)
        kept: list = []
        h = np.take(self._states(x, some, kept), order, axis=0)
        outer, outer_sum, inner, inner_sum = self._levels(h, ends)
        n, rows, cls = np.float32(1 / len(t)), np.arange(len(t)), t // m
        outer *= (n / outer_sum)[:, None]
        outer[rows, cls] -= n
        inner *= (n / inner_sum)[:, None]
        inner[rows, t - cls * m] -= n
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["C"], g["c"] = h.T @ outer, _sums(outer)
        dh = outer @ w["C"].T
        for c, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            if lo < hi:
                g["M"][c], g["m"][c] = h[lo:hi].T @ inner[lo:hi], _sums(inner[lo:hi])
                dh[lo:hi] += inner[lo:hi] @ w["M"][c].T
        dH = np.zeros((y.size, d), np.float32)
        dH[order] = dh
        dX = np.empty((*x.shape, d), np.float32)
        for lo in range(0, len(x), some):
            X, own, q, A, share, mixed = kept[lo // some]
            dh = dH[lo * stride : (lo + some) * stride]
            g["O"] += mixed.T @ dh
            dO = dh @ w["O"].T
            level = (dO * mixed) @ self.ones[:d]
            dO *= share[:, None]
            dO = dO.reshape(-1, stride, d)
            dS = dO @ X.transpose(0, 2, 1)
            dS -= (level * share).reshape(-1, stride, 1)
            dS *= A
            dq = (dS @ X).reshape(-1, d)
            g["Q"] += own.T @ dq
            part = dX[lo : lo + some]
            np.matmul(dS.transpose(0, 2, 1), q, out=part)
            part += A.transpose(0, 2, 1) @ dO
            part[:, c0:] += (dh + dq @ w["Q"].T).reshape(-1, stride, d)
        g["P"] = dX.sum(0)
        at, times = np.argsort(x, axis=None, kind="stable"), np.bincount(x.ravel())
        ids = np.flatnonzero(times)
        first = np.cumsum(times[ids]) - times[ids]
        g["E"][ids] = np.add.reduceat(np.ascontiguousarray(np.take(dX.reshape(-1, d), at, axis=0).T), first, axis=1).T
        return g

    def learn(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One Adam step."""
        self.steps += 1
        a, b = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        for key, grad in self.gradients(x, y).items():
            self.first[key] += np.float32(0.1) * (grad - self.first[key])
            self.second[key] += np.float32(0.01) * (grad * grad - self.second[key])
            self.w[key] -= np.float32(rate / a) * self.first[key] / (np.sqrt(self.second[key] * np.float32(1 / b)) + np.float32(1e-7))


END = b""  # the end token among words, which are never empty


def text_slices(texts: pa.Array, most: int):
    """(from, to) of slices of at most `most` bytes, one text at least."""
    ends, lo = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct lower-cased words, each word's place among them, the number of words of each text) of binary texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # the ends of a text split into empty words
    if not full.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    return coded.dictionary.view(pa.binary()), coded.indices.to_numpy(zero_copy_only=False), n


def word_counts(rows: DataFrame, flush_bytes: int = 1 << 24) -> DataFrame:
    """(word, n) over all rows (text binary); the end is the empty word. A task holds the words of at most flush_bytes of
    text, or of one text."""

    def count(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in text_slices(texts, flush_bytes):
                words, at, _ = split_words(texts.slice(lo, hi - lo))
                n = np.append(np.bincount(at, minlength=len(words)), hi - lo)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.array(n, pa.int64())], ["word", "n"])

    return rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WordEncoder:
    """Subword ids of many words in one call: a word begins where a token begins with a space, as no word holds one."""

    def __init__(self, tokenizer_path: str):
        self.encode, vocab = piece_encoder(tokenizer_path), load_tokenizer(tokenizer_path)[0].get_vocab()
        space = next(c for c, b in byte_alphabet().items() if b == 0x20)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(space)]] = True

    def __call__(self, words: list[bytes]):
        """For some of the words at a time: (ids, one word after another, the number of ids of each word)."""
        for lo in range(0, len(words), 4096):
            some = [w.decode(errors="replace") for w in words[lo : lo + 4096]]
            ids = np.array(self.encode([" ".join(["", *some])])[0])
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some) and at[0] == 0:
                yield ids, np.diff(at, append=len(ids))
            else:  # a file that spells a space otherwise
                each = self.encode([" " + w for w in some])
                yield np.concatenate(each), np.array([len(i) for i in each])


def subword_counts(counts: DataFrame, tokenizer_path: str) -> dict[int, int]:
    """Subword id -> count over all training texts; at most as many entries as the file has ids."""

    def count(batches):
        encode = worker_cache(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        held = np.zeros(len(encode.opens), np.int64)
        for batch in batches:
            words, n, lo = batch.column("word").to_numpy(zero_copy_only=False).tolist(), batch.column("n").to_numpy(), 0
            for ids, sizes in encode(words):
                np.add.at(held, ids, np.repeat(n[lo : lo + len(sizes)], sizes))
                lo += len(sizes)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], ["id", "n"])

    ids = counts.filter(F.octet_length("word") > 0).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in ids.collect()}


def spelling(tokenizer_path: str, counts: dict[int, int], ends: int, shape: Shape) -> tuple[list[bytes], int, np.ndarray]:
    """(for each subword id its model ids as unsigned 16-bit integers, the end's model id, counts of model ids).

    Model ids are ranks by count over the end, the 256 bytes and the most frequent subword ids.
    """
    tok, special = load_tokenizer(tokenizer_path)
    alphabet = byte_alphabet()
    vocab = {i: t for t, i in tok.get_vocab().items()}
    common = sorted(counts, key=lambda i: (-counts[i], i))[: shape.vocabulary - 257]
    place = {i: 257 + k for k, i in enumerate(common)}
    raw = []
    for i in range(max(vocab) + 1):
        t = vocab.get(i, "")
        raw.append([place[i]] if i in place else [1 + b for b in t.encode()] if t in special else [1 + alphabet[c] for c in t])
    n = np.zeros(shape.vocabulary)
    n[0] = ends
    for i, k in counts.items():
        for j in raw[i]:
            n[j] += k
    rank = np.empty(shape.vocabulary, np.uint16)
    rank[np.argsort(-n, kind="stable")] = np.arange(shape.vocabulary)
    return [rank[r].tobytes() for r in raw], int(rank[0]), np.sort(n)[::-1]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ..., sizes[k] of them, for one k after another."""
    ends = np.cumsum(sizes, dtype=starts.dtype)
    places = np.repeat(starts - ends + sizes, sizes)
    places += np.arange(len(places), dtype=starts.dtype)
    return places


class Speller:
    """Words (bytes) -> model ids as the bytes of unsigned 16-bit integers."""

    def __init__(self, tokenizer_path: str, spelled: list[bytes], cache_size: int = 160_000):
        encode = worker_cache(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        letters, sizes = np.frombuffer(b"".join(spelled), np.uint16), np.array([len(s) // 2 for s in spelled])
        starts = np.cumsum(sizes) - sizes

        def many(words: list[bytes]) -> list[bytes]:
            out = []
            for ids, n in encode(words):
                whole = letters[runs(starts[ids], sizes[ids])].tobytes()
                cuts = (2 * np.append(0, np.cumsum(sizes[ids]))[np.append(0, np.cumsum(n))]).tolist()
                out += [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            return out

        self.cache = PieceCache(many, limit=cache_size, prefix="")

    def __call__(self, words: list[bytes]) -> list[bytes]:
        self.cache.learn(set(words))
        return list(map(self.cache.__getitem__, words))


def spell_texts(texts: pa.Array, spell: Speller, known: dict[bytes, float]) -> list[pa.Array]:
    """Of binary texts: model ids, number of words, how many words are known, the sum of their values, and the distinct
    other words with their times. A distinct word of the texts is spelled and looked up once."""
    words, at, n = split_words(texts)
    listed, rows = words.to_numpy(zero_copy_only=False).tolist(), len(texts)
    spelled = spell(listed)
    letters, sizes = np.frombuffer(b"".join(spelled), np.uint16), np.array(list(map(len, spelled)), np.int32) // 2
    each = np.take(sizes, at)
    ids = np.take(letters, runs(np.take(np.cumsum(sizes, dtype=np.int32) - sizes, at), each))
    ends = 2 * np.append(0, np.cumsum(each, dtype=np.int64))[np.append(0, np.cumsum(n))]
    none = float("nan")
    value, doc = np.array(list(map(known.get, listed, repeat(none))), np.float64)[at], np.repeat(np.arange(rows), n)
    near = ~np.isnan(value)
    pairs, times = np.unique(doc[~near] * len(listed) + at[~near], return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(rows + 1) * len(listed)), pa.int32())
    return [
        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)]),
        pa.array(n, pa.int64()),
        pa.array(np.bincount(doc[near], minlength=rows), pa.int64()),
        pa.array(np.bincount(doc[near], value[near], rows), pa.float64()),
        pa.ListArray.from_arrays(offsets, words.take(pa.array(pairs % max(1, len(listed)), pa.int64()))),
        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
    ]


def window_batches(groups, size: int, rng: np.random.Generator):
    """(inputs, targets) of `size` windows, the last of what is left: every window of the groups in one batch, in
    mixed order within a group."""
    x = y = None
    for some_x, some_y in groups:
        order = rng.permutation(len(some_x))
        x, y = (some[order] if left is None else np.concatenate([left, some[order]]) for left, some in ((x, some_x), (y, some_y)))
        full = len(x) - len(x) % size
        for lo in range(0, full, size):
            yield x[lo : lo + size], y[lo : lo + size]
        x, y = x[full:], y[full:]
    if x is not None and len(x):
        yield x, y


def window_groups(model: Model, texts, end: int, most: int = 1 << 15):
    """Windows of the texts (bytes of ids) in groups of about `most`; a longer text gives several groups."""
    xs, ys, held = [], [], 0
    for ids in texts:
        x, y = model.windows(np.append(np.frombuffer(ids, np.uint16), np.uint16(end)), end)
        for lo in range(0, len(x), most):
            xs.append(x[lo : lo + most])
            ys.append(y[lo : lo + most])
            held += len(xs[-1])
            if held >= most:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)


#: Weights are summed as whole multiples of 1 / UNIT and token, so that a sum does not depend on its order.
UNIT = 1 << 12


def train_round(texts: DataFrame, weights: dict[str, np.ndarray], shape: Shape, end: int, shards: int, batch_windows: int, rate: tuple[float, float]) -> dict[str, np.ndarray]:
    """Weights after every shard learned from its own texts, starting from the given ones, averaged by tokens.

    texts has shard (0 to shards - 1), mark (order within a shard) and ids. The learning rate falls from rate[0] to
    rate[1] over a shard's batches.
    """
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def learn(held: list[bytes], shard: int):
        keep_heap()
        model = Model(shape, {k: v.copy() for k, v in shared.value.items()})
        n = sum(len(t) // 2 + 1 for t in held)
        seen = 0
        for x, y in window_batches(window_groups(model, held, end), batch_windows, np.random.default_rng(shard)):
            model.learn(x, y, rate[0] * (rate[1] / rate[0]) ** (seen / n))
            seen += int((y != NONE).sum())
        flat = np.concatenate([np.clip(v, -1000, 1000).ravel() for v in model.w.values()]).astype(np.float64)
        value = np.append(np.rint(flat * (UNIT * n)), n).astype(np.int64)  # the last entry adds up the tokens
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], ["at", "value"])

    def train(batches):
        now, held = None, []
        for batch in batches:
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and shard != now:
                    yield learn(held, now)
                    held = []
                now = shard
                held.append(ids)
        if held:
            yield learn(held, now)

    dealt = texts.select("shard", "mark", "ids").repartitionById(min(shards, 1 << 14), F.col("shard") % min(shards, 1 << 14))
    parts = dealt.sortWithinPartitions("shard", "mark", "ids").mapInArrow(train, "at int, value long")
    total = {r["at"]: r["value"] for r in parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}  # a row for each weight
    if not total:
        return weights
    count = float(total.pop(len(total) - 1))
    flat = (np.array([float(total[i]) for i in range(len(total))]) / (UNIT * count)).astype(np.float32)
    out, lo = {}, 0
    for k, s in shape.arrays().items():
        out[k] = flat[lo : lo + math.prod(s)].reshape(s).copy()
        lo += math.prod(s)
    return out


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words of the highest counts, `most` at most, without sending any other word to the driver: counts fall
    into bins of an eighth of a power of two, and the bins that fit are taken whole."""
    level = F.floor(8 * F.log2("n")).cast("int")
    room, least = most, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return {} if least is None else {bytes(r["word"]): r["n"] for r in counts.filter(level >= least).collect()}


def lm_scores(
    docs: DataFrame,
    tokenizer_path: str,
    folds: int = 7,
    held_out: int = 2,
    shape: Shape | None = None,
    rounds: int = 3,
    shard_tokens: int = 1 << 21,
    batch_windows: int = 512,
    rate: tuple[float, float] = (0.05, 0.004),
    head_size: int = 65_536,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    Training rows are those whose crc32(doc_id) mod folds is not held_out, a null id included. base_score sums
    log10((c + 1) / (N + V + 1)) over a text's words and its end, c from all training texts; score is the model's
    log10 probability of the whole text. A null, empty or blank text is its end alone. Without training rows N is 0,
    every base_score 0, and the model is its start. Repeated rows score alike. Texts of any length are scored whole.
    Empty table: no rows. Only doc_id and text are read.
    """
    shape = shape or Shape()
    out = F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False))
    rows = docs.select("doc_id", out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = materialize(word_counts(rows.filter(~F.col("held_out"))), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    base, n_ends = total["n"] + total["v"] + 1, total["ends"]
    spelled, end, n = spelling(tokenizer_path, subword_counts(counts, tokenizer_path), n_ends, shape)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((spelled, {w: math.log10((c + 1) / base) for w, c in frequent(counts.filter(F.octet_length("word") <= LONG), head_size).items()}))

    run = uuid.uuid4().hex

    def spell_all(batches):
        letters, known = shared.value
        spell, end_log = worker_cache(("speller", run), lambda: Speller(tokenizer_path, letters)), math.log10((n_ends + 1) / base)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in text_slices(texts, 1 << 22):
                ids, n, hits, near, far, times = spell_texts(texts.slice(lo, hi - lo), spell, known)
                uids = pa.array(np.arange(uid, uid + hi - lo))
                uid += hi - lo
                columns = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")]
                columns += [uids, ids, pc.add(n, 1), pc.add(hits, int(n_ends > 0)), pc.add(near, end_log), far, times]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "uid", "ids", "n_tokens", "near_known", "near", "far", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = materialize(rows.mapInArrow(spell_all, f"doc_id {kind}, held_out boolean, uid long, ids binary, n_tokens long, near_known long, near double, far array<binary>, times array<long>"), "spelled")

    shards = max(1, math.ceil(n.sum() / (shard_tokens * rounds)))
    mark = F.xxhash64("doc_id", "ids")
    training = texts.filter(~F.col("held_out")).select("ids", mark.alias("mark"), F.pmod(mark, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftright(mark, 40), F.lit(rounds)).alias("round"))
    weights, fall = start_weights(shape, n), (rate[1] / rate[0]) ** (1 / rounds)
    for k in range(rounds):
        weights = train_round(training.filter(F.col("round") == k), weights, shape, end, shards, batch_windows, (rate[0] * fall**k, rate[0] * fall ** (k + 1)))
    learned = sc.broadcast(weights)

    def score(batches):
        keep_heap()
        model = Model(shape, learned.value)
        for batch in batches:
            out, held, doc = np.zeros(batch.num_rows), [], []

            def settle():
                x, y = (np.concatenate(z) for z in zip(*held, strict=True))
                sums = np.concatenate([model.log_probs(x[lo : lo + 1024], y[lo : lo + 1024]).sum(1, dtype=np.float64) for lo in range(0, len(x), 1024)])
                np.add.at(out, np.array(doc), sums)  # noqa: B023
                held.clear()  # noqa: B023
                doc.clear()  # noqa: B023

            for k, ids in enumerate(batch.column("ids")):
                x, y = model.windows(np.append(np.frombuffer(ids.as_buffer(), np.uint16), np.uint16(end)), end)
                held.append((x, y))
                doc += [k] * len(x)
                if len(doc) >= 8192:
                    settle()
            if doc:
                settle()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + [pa.array(out / LOG10)], [*plain, "score"])

    plain = ["doc_id", "held_out", "uid", "n_tokens", "near_known", "near"]
    scored = texts.select(*plain, "ids").mapInArrow(score, f"doc_id {kind}, held_out boolean, uid long, n_tokens long, near_known long, near double, score double")
    far = texts.select("uid", F.inline(F.arrays_zip(F.col("far").alias("word"), F.col("times").alias("times"))))
    value = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(base)))
    summed = far.join(counts, "word", "left").groupBy("uid").agg(F.sum(value * F.col("times")).alias("far_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("far_known"))
    return scored.join(summed, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("near") + F.coalesce("far_log", F.lit(0.0))).alias("base_score"),
        "score",
    )
