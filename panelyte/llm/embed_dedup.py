"""Near-duplicate embeddings by iterative quantisation, multi-index Hamming tables and reranking.

Codes: unit vectors are projected to their principal directions and rotated so that they lie close to the corners of
the cube (iterative quantisation, learned on a bounded sample; every row is encoded); each bit is cut at the sample's
median, so its two values are balanced. Several rotations give as many bits as the tables need. Tables: the code is cut
into substrings, one table each; vectors of a label that agree in a whole substring meet. A substring has as many bits
as tell the vectors of the largest label apart, so a vector meets about one other by chance in each table, however many
there are; the number of tables follows from the chance that vectors at the threshold agree in a substring. Pairs that
meet and whose first 64 bits differ little are compared by the original vectors in double precision. Copies of a
vector are one vertex with a weight, so they are never expanded into pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.components import components
from panelyte.llm.shared import discard, materialize

WORD = 64  # bits of the code that pairs carry along


def learn_codes(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(projection d x bits, cuts) from unit vectors; each rotation gives at most d bits."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    mean = sample.mean(axis=0)
    _, vectors = np.linalg.eigh((sample - mean).T @ (sample - mean))
    basis = vectors[:, ::-1][:, : min(d, WORD)]
    v, blocks, width = (sample - mean) @ basis, [], 0
    while width < bits:
        rotation, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
            rotation = (u @ w).T
        blocks.append(basis @ rotation)
        width += v.shape[1]
    projection = np.concatenate(blocks, axis=1)[:, :bits]
    return projection, np.median(sample @ projection, axis=0)


def plain_codes(d: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions, for a length that the sample has too few of to learn from."""
    return np.random.default_rng(d).standard_normal((d, bits)), np.zeros(bits)


def encode(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first 64 bits as a signed integer, all whole substrings of `bits` bits) of unit vectors."""
    projection, cuts = model
    on = (vectors @ projection > cuts).astype(np.uint8)
    word = np.packbits(on[:, :WORD], axis=1, bitorder="little").view(np.int64).ravel()
    whole = on[:, : on.shape[1] // bits * bits].reshape(len(on), -1, bits)
    return word, whole @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def table_sizes(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a substring, tables) for `largest` vectors under one label: a bit of two vectors at the threshold
    differs with a chance of angle / pi, and all tables miss them with a chance of `miss` at most."""
    bits = min(max(math.ceil(math.log2(max(largest, 2))), 8), 40)
    agree = (1 - math.acos(max(min(threshold, 1.0), -1.0)) / math.pi) ** bits
    return bits, max(math.ceil(math.log(miss) / math.log1p(-min(agree, 1 - 1e-9))), -(-WORD // bits))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, miss: float = 0.002, radius: int = 22, sample_rows: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in double
    precision is threshold or more. A vector that is null, empty or zero or holds a null, NaN or infinity links with
    nothing, as does one without a label or an id: n_links 0, component its own id. n_links counts other rows;
    copies of a vector under several ids link with each other; rows that repeat an id are told apart by their
    vectors for n_links only. component_id is the smallest id reachable. Pairs at the threshold are missed by the
    tables with a chance of about `miss`, by the first 64 bits (`radius` of which may differ) with a smaller one, closer
    pairs less. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True))
    squares = F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)
    rows = rows.withColumn("norm", F.when(sound, F.sqrt(squares))).withColumn("embedding", F.when(F.col("norm") > 0, F.col("embedding")))
    whole = rows.filter("embedding is not null").groupBy("label", "embedding", "norm").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(whole.withColumn("dims", F.size("embedding")), "vectors")

    size = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
    bits, tables = table_sizes(size["largest"], threshold, miss)
    share = min(1.0, sample_rows / max(size["n"], 1))
    sample = classes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("dims", "embedding", "norm").collect()  # about sample_rows
    models = {}
    for dims in {r["dims"] for r in sample}:
        of = np.array([np.array(r["embedding"], float) / r["norm"] for r in sample if r["dims"] == dims])
        if len(of) >= 2 * dims:
            models[dims] = learn_codes(of, max(bits * tables, WORD))
    shared = spark.sparkContext.broadcast(models)

    def code(batches):
        known = dict(shared.value)
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist(), int)
            flat, ends = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float), batch.column("embedding").offsets.to_numpy()
            ends = ends - ends[0]
            word, subs = np.zeros(len(dims), np.int64), np.zeros((len(dims), max(bits * tables, WORD) // bits), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = np.stack([flat[ends[i] : ends[i] + d] for i in at])
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                if d not in known:
                    known[d] = plain_codes(int(d), max(bits * tables, WORD))
                word[at], subs[at] = encode(v, known[d], bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * subs.shape[1]), pa.array(subs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("dims"), pa.array(word), lists], ["id", "label", "dims", "code", "subs"])

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("id", "label")}
    codes = materialize(classes.select("id", "label", "dims", "embedding").mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, dims int, code long, subs array<long>"), "codes")

    entries = codes.select("label", "dims", "id", "code", F.posexplode("subs").alias("t", "sub"))
    left, right = (entries.select("label", "dims", "t", "sub", F.col("id").alias(a), F.col("code").alias(f"c{a}")) for a in ("a", "b"))
    differ = F.col("ca").bitwiseXOR(F.col("cb"))
    slices = [F.shiftrightunsigned(differ, t * bits).bitwiseAND(F.lit((1 << bits) - 1)) for t in range(WORD // bits)]  # tables that the first bits hold
    met = F.coalesce(*[F.when(s == 0, F.lit(t)) for t, s in enumerate(slices)], F.lit(None).cast("int"))
    near = left.join(right, ["label", "dims", "t", "sub"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (met.isNull() | (met == F.col("t"))))
    pairs = near.select("label", "a", "b").distinct()

    side = lambda end: classes.select("label", F.col("id").alias(end), F.col("embedding").alias(f"v{end}"), F.col("norm").alias(f"n{end}"), F.col("copies").alias(f"c{end}"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)
    links = materialize(pairs.join(side("a"), ["label", "a"]).join(side("b"), ["label", "b"]).filter(dot / (F.col("na") * F.col("nb")) >= threshold).select("label", "a", "b", "ca", "cb"), "links")
    discard(codes)

    both = links.select("label", F.col("a").alias("id"), F.col("cb").alias("others")).unionByName(links.select("label", F.col("b").alias("id"), F.col("ca").alias("others")))
    linked = both.groupBy("label", "id").agg(F.sum("others").alias("others"))
    counted = classes.join(linked, ["label", "id"], "left").join(components(links.select("a", "b")).withColumnRenamed("v", "id"), "id", "left")
    by_class = counted.select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    return (
        rows.join(by_class, ["label", "embedding"], "left")
        .withColumn("component_id", F.coalesce("root", "vec_id"))
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
