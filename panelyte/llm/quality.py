"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

A text's words are its letter runs, digit runs and symbol runs. Features are hashed n-grams of words (1 and 2) and of
word shapes (2 and 3; a shape is the kind of characters, how the word is capitalised, its length class, and whether
it repeats the word before), each with its share of the text's n-grams as value, so a score is a sparse dot product.
Training takes a bounded sample of labelled rows, dealt to shards; each shard runs FTRL-proximal updates and the
shards' weights are averaged.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.shared import fold_of, text_groups

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
MANY_WORDS = 300_000


def shape(word: str) -> str:
    if word[0].isalpha():
        case = "X" if word.isupper() else "x" if word.islower() else "Xx" if word[1:].islower() or len(word) == 1 else "xX"
        return f"{case}{min(len(word).bit_length(), 4)}"
    if word[0].isdigit():
        return f"9{min(len(word).bit_length(), 4)}"
    return word[:2] + str(min(len(word), 4))


class Features:
    """Text -> hashed feature indices in [0, 2^bits), one per n-gram occurrence."""

    def __init__(self, bits: int):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _word(self, w: str) -> int:
        v = self.known.get(w)
        if v is None:
            if len(self.known) >= MANY_WORDS:
                self.known.clear()
            v = self.known[w] = xxhash.xxh32_intdigest(w.encode(errors="replace")) << 32 | xxhash.xxh32_intdigest(shape(w).encode(errors="replace"))
        return v

    def __call__(self, text: str) -> np.ndarray:
        found = _TOKEN.findall(text)
        v = np.fromiter(map(self._word, found), np.uint64, len(found))
        word, form = v >> np.uint64(32), v & np.uint64(0xFFFFFFFF)
        form[1:] = form[1:] * np.uint64(2) + (word[1:] == word[:-1])
        grams = [
            (word + np.uint64(1)) * _K[0],
            (word[:-1] * _K[1] + word[1:] + np.uint64(2)) * _K[0],
            (form[:-1] * _K[2] + form[1:] + np.uint64(3)) * _K[3],
            ((form[:-2] * _K[2] + form[1:-1]) * _K[1] + form[2:] + np.uint64(4)) * _K[3],
        ]
        h = np.concatenate(grams)
        return ((h ^ (h >> np.uint64(29))) * _K[0] >> self.shift).astype(np.int64)


def train_ftrl(rows: list[tuple[np.ndarray, int]], bits: int, scale: float, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights, the bias last, after FTRL-proximal updates over the (feature indices, label) rows."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    sparse = []
    for idx, y in rows:
        i, c = np.unique(idx, return_counts=True)
        sparse.append((np.append(i, 1 << bits), np.append(c * (scale / max(len(idx), 1)), 1.0), y))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(sparse)):
            i, x, y = sparse[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(slice(None))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 8000,
    shards: int = 4,
    bits: int = 18,
    scale: float = 20.0,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.02,
    folds: int = 3,
    held_out: int = 1,
) -> np.ndarray:
    """Weights from at most max_rows labelled rows whose crc32(id) mod folds is not held_out, by least hash of the id.

    Only the labelled ids' table, bounded by max_rows, is broadcast. Rows without a label or text id do not take
    part; repeated labels count as their greatest. Without any labelled row all weights are 0.
    """
    marks = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.join(F.broadcast(marks), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        features = Features(bits)
        pdf = pdf.sort_values("text")  # the same order in a task that runs again
        w = train_ftrl([(features(t), int(y > 0)) for t, y in zip(pdf["text"], pdf["y"], strict=True)], bits, scale, epochs, alpha, beta, l1, l2, int(pdf["shard"].iloc[0]))
        return pd.DataFrame({"n": [len(pdf)], "w": [w.astype(np.float32).tobytes()]})

    parts = rows.groupBy("shard").applyInPandas(train, "n long, w binary").collect()  # shards x 2^bits floats
    if not parts:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.average([np.frombuffer(p["w"], np.float32) for p in parts], axis=0, weights=[p["n"] for p in parts]).astype(np.float32)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, bits: int = 18, scale: float = 20.0, carry: list[str] = (), **options) -> DataFrame:
    """(doc_id, held_out, score, predicted and the carried columns), one row per row of docs.

    docs has doc_id and text, labels doc_id and quality. score is the probability of quality 1 from the whole text
    alone; a null or empty text scores as the bias, without labels every text scores 0.5. A null doc_id is not held
    out. Repeated rows score alike. Empty table: no rows. Columns other than the named ones are not read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds=folds, held_out=held_out, bits=bits, scale=scale, **options))
    rows = docs.select(F.struct("doc_id", *carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def score(batches):
        features, w = Features(bits), weights.value
        for batch in batches:
            out = []
            for _, texts in text_groups([batch], "row", "text"):
                for t in texts:
                    idx = features(t)
                    out.append(float(w[idx].sum(dtype=np.float64)) * scale / max(len(idx), 1) + float(w[-1]))
            p = 1 / (1 + np.exp(-np.clip(np.array(out), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p, pa.float64())], ["row", "score"])

    scored = rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return scored.select(
        "row.doc_id",
        F.coalesce(fold_of("row.doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *[F.col(f"row.{c}").alias(c) for c in carry],
    )
