"""N-gram Jaccard join by PartEnum signatures.

Two sets with |A & B| >= t * |A | B| differ in at most (1 - t) / (1 + t) of their sizes' sum. Sizes fall into bands
whose ends are in the ratio t, so linked sets lie in one band or in two neighbouring ones: a set has signatures for its
own band and for the next. For a band whose sets differ by k features at most, the feature domain is hashed into
n1 = floor(k / 3) + 1 + SPARE partitions, so linked sets differ by two features at most in one of them; each partition
is hashed into 3 parts, and a signature stands for the features in a subset of 3 - 2 parts. Of all PartEnum forms with
subsets of parts this one has the fewest signatures. Linked sets of given sizes differ by d features, so they agree in
all but d parts: each set may leave out as many of its signatures as that exceeds 1, in an order that only the
signatures decide. The thinnest go, which are those that passages common to many texts make.

Signatures shared by different sets give candidate groups: all pairs of a small bucket that the counts of features in
hash bins do not rule out; of a large bucket, cut into blocks whose pairs are dealt out as tasks, as many as join what
the counts do not keep apart. In each group the sets themselves are compared, again in pairs of bounded blocks, and
only links that join two components of the block pair come back.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.components import components
from panelyte.llm.shared import discard, materialize, text_groups

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_W = np.uint64(0x9E3779B97F4A7C15)
MANY_WORDS = 150_000
FILTER_BITS = 1 << 26
SPARE, SMALL_BUCKET, BLOCK_KEYS = 2, 24, 1024


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct n-word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def word(self, w: bytes) -> int:
        h = self.words.get(w)
        if h is None:
            if len(self.words) >= MANY_WORDS:
                self.words.clear()
            h = self.words[w] = xxhash.xxh64_intdigest(w)
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.word, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out + hashes[k : len(words) - n + 1 + k] * _W)
        return np.unique(out)


class PartEnum:
    """Signatures of a set for Jaccard >= num / 100."""

    def __init__(self, num: int, parts: int = 3):
        self.num, self.parts, self.ends = num, parts, [0]

    def band(self, size: int) -> int:
        """Bands are 1-based; band i holds the sizes up to ends[i]."""
        while self.ends[-2:][0] < size or len(self.ends) < 2:  # one band more than sizes need
            self.ends.append(max(self.ends[-1] + 1, (self.ends[-1] + 1) * 100 // self.num))
        return bisect_left(self.ends, size)

    def apart(self, a: int, b: int) -> int:
        """Features by which linked sets of these sizes differ at most."""
        return (a + b) * (100 - self.num) // (100 + self.num)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        own, n, largest = self.band(len(s)), len(s), len(s) * 100 // self.num
        spread, value, out = mix(s + _W), mix(s ^ _M1), []
        for b in (own, own + 1):
            if b > own and largest <= self.ends[own]:
                break  # no linked set is that large
            k = self.apart(self.ends[b], self.ends[b])
            cells = (k // self.parts + 1 + SPARE + k // 24) * self.parts
            cell = (spread % np.uint64(cells)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            at = np.searchsorted(cell[order], np.arange(cells + 1))
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)])
            sums = running[at[1:]] - running[at[:-1]]
            h = mix(mix(np.arange(cells, dtype=np.uint64) + np.uint64(b << 44)) + mix(sums) * _W)
            keep = self.apart(n, min(self.ends[b], largest)) + 1  # of cells that agree, all but keep - 1 differing ones
            out.append(h[np.lexsort((h, np.diff(at)))[-keep:]])
        return np.concatenate(out).view(np.int64)


def bin_counts(s: np.ndarray) -> bytes:
    """Features by hash bin, at most 255 each, in about a bin for four features (a power of two, 32 to 1024): the sum
    of two sets' differences never exceeds their symmetric difference."""
    bins = 1 << min(max((len(s) // 4).bit_length(), 5), 10)
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % bins, minlength=bins), 255).astype(np.uint8).tobytes()


def bins_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sum of differences of bin counts for each pair, the longer one folded to the shorter."""
    out = np.zeros(len(a), np.int64)
    width = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for wa, wb in np.unique(width, axis=0):
        at = np.flatnonzero((width[:, 0] == wa) & (width[:, 1] == wb))
        w = min(wa, wb)
        x, y = (np.frombuffer(b"".join([side[i] for i in at]), np.uint8).reshape(len(at), -1, w).sum(axis=1, dtype=np.int32) for side in (a, b))
        out[at] = np.abs(x - y).sum(axis=1)
    return out


def may_link_forest(keys: list[int], counts: list[bytes], sides: list[int], cross: bool, num: int) -> list[tuple[int, int]]:
    """Pairs that join a bucket's sets into the components of "the bin counts do not rule a link out"; with cross,
    only pairs of different sides count."""
    width = min(map(len, counts))
    c = np.stack([np.frombuffer(x, np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int32) for x in counts])
    size, label, side, out = c.sum(axis=1), np.arange(len(keys)), np.array(sides), []
    full = np.array([max(x) == 255 for x in counts])  # counts that may be cut off give no size
    for i in range(len(keys) - 1):
        other = label[i + 1 :] != label[i]
        if cross:
            other &= side[i + 1 :] != side[i]
        j = np.flatnonzero(other) + i + 1
        most = (size[i] + size[j]) * (100 - num) // (100 + num)
        for x in j[(np.abs(c[j] - c[i]).sum(axis=1) <= most) | full[j] | full[i]].tolist():
            if label[x] != label[i]:
                label[label == label[x]] = label[i]
                out.append((keys[i], keys[x]))
    return out


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def linked_forest(keys: list[int], sets: list[np.ndarray], sides: list[int], cross: bool, num: int, bins: int = 256):
    """Links (key, key) that join components; with cross, only pairs of different sides are compared.

    A pair is compared exactly unless it is joined already or can't be linked: by its sizes, or as the counts of
    features in hash bins differ by more than linked sets' symmetric difference can.
    """
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), keys[k]))
    keys, sets, sides = ([v[k] for k in order] for v in (keys, sets, sides))
    size, side = np.array([len(s) for s in sets]), np.array(sides)
    counts = np.stack([np.bincount((s >> np.uint64(40)).astype(np.int64) % bins, minlength=bins) for s in sets]).astype(np.int32)
    label = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // num, side="right"))
        near = slice(i + 1, end)
        ok = label[near] != label[i]
        if cross:
            ok &= side[near] != side[i]
        if not ok.any():
            continue
        ok &= np.abs(counts[near] - counts[i]).sum(axis=1) <= (size[i] + size[near]) * (100 - num) // (100 + num)
        j = np.flatnonzero(ok) + i + 1
        for x in j.tolist():
            a, b = find(i), find(x)
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
            if 100 * both >= num * (len(sets[i]) + len(sets[x]) - both):
                root[max(a, b)] = min(a, b)
                label[label == label[x]] = label[i]
                out.append((keys[i], keys[x]))
    return out


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def in_block_pairs(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows (with block and blocks) once for each pair (i, j) of blocks of their group that they take part in, each pair
    together in one task and in the order of key."""
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    each = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    return each.repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j", "key")


def labelled_rows(
    docs: DataFrame,
    num: int = 90,
    words: int = 3,
    block_features: int = 1 << 21,
    block_sets: int = 2048,
    small_bucket: int = SMALL_BUCKET,
    block_keys: int = BLOCK_KEYS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, tkey, n, root) per row of docs: hash of the text, features, and a number of its component."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        shingles, sign, seen = Shingler(words), PartEnum(num), set()
        for batch in batches:
            sizes, keys, signs, bins = [], [], [], []
            for _, texts in text_groups([batch], "doc_id", "text"):
                for t in texts:
                    s = shingles(t)
                    key = set_key(s)
                    fresh = len(s) and key not in seen
                    if fresh:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(key)
                    sizes.append(len(s))
                    keys.append(key)
                    signs.append(sign(s) if fresh else np.empty(0, np.int64))
                    bins.append(bin_counts(s) if len(s) else None)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in signs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *signs])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists, pa.array(bins, pa.binary())], ["doc_id", "tkey", "n", "key", "signs", "bins"])

    signed = materialize(rows.mapInArrow(describe, f"doc_id {kind}, tkey long, n long, key long, signs array<long>, bins binary"), "sets")

    signs = signed.select("key", F.explode("signs").alias("sign"))
    # Buckets of one set are dropped by partial aggregates; as a table of its own, what is left can be small enough to
    # send, or else the join splits the rows of a hot signature.
    buckets = signs.groupBy("sign").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("rows"))
    buckets = materialize(buckets.filter("least <> most").select("sign", "rows"), "buckets")
    shared = materialize(signs.join(buckets, "sign").select("sign", "key", "rows"), "shared")
    discard(buckets)
    facts = materialize(signed.drop("signs"), "facts")
    discard(signed)
    few = shared.filter(F.col("rows") <= small_bucket).select("sign", "key").distinct()
    pairs = few.select("sign", F.col("key").alias("a")).join(few.select("sign", F.col("key").alias("b")), "sign").filter("a < b").select("a", "b").distinct()
    described = facts.join(shared.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("n").alias("n"), F.max("bins").alias("bins"))
    side = lambda end: described.select(F.col("key").alias(end), F.col("n").alias(f"n{end}"), F.col("bins").alias(f"bins{end}"))

    def may_link(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                apart = np.maximum(bins_apart(batch.column("binsa").to_pylist(), batch.column("binsb").to_pylist()), np.abs(na - nb))
                yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(apart <= (na + nb) * (100 - num) // (100 + num))))

    def bucket_forest(batches):
        at, held = None, {}

        def flush():
            keys = list(held)
            edges = may_link_forest(keys, [held[k][1] for k in keys], [held[k][0] for k in keys], at[1] != at[2], num)
            return edge_batch(edges)

        for batch in batches:
            for sign, i, j, key, block, bins in zip(*[batch.column(c).to_pylist() for c in ("sign", "i", "j", "key", "block", "bins")], strict=True):
                if (sign, i, j) != at:
                    if len(held) > 1:
                        yield flush()
                    at, held = (sign, i, j), {}
                held[key] = (block, bins)
        if len(held) > 1:
            yield flush()

    many = shared.filter(F.col("rows") > small_bucket).groupBy("sign", "key").agg(F.ceil(F.max("rows") / block_keys).cast("int").alias("blocks"))
    many = many.join(described.select("key", "bins"), "key").withColumn("block", F.pmod(F.hash("key"), F.col("blocks")))
    forests = in_block_pairs(many, ["sign"]).mapInArrow(bucket_forest, "a long, b long")
    groups = components(forests.unionByName(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(may_link, "a long, b long")))
    discard(shared)

    by_key = facts.drop("bins").join(groups, facts["key"] == groups["v"]).groupBy("key", "root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tkey")).alias("one"), F.max("n").alias("n"))
    members = materialize(by_key.select("key", "root", "n", F.col("one.doc_id").alias("doc_id"), F.col("one.tkey").alias("tkey")), "members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_features), F.ceil(F.count(F.lit(1)) / block_sets)).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.hash("key"), F.col("blocks")))
    placed = materialize(placed, "placed")
    spots = placed.select(F.pmod("tkey", F.lit(FILTER_BITS)).alias("h")).groupBy(F.shiftright("h", 15).alias("part"))
    marks = docs.sparkSession.sparkContext.broadcast(
        {r["part"]: bytes(r["bits"]) for r in spots.agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits")).collect()}
    )  # FILTER_BITS bits at most; it only spares texts that no member has, so its fill does not change the result

    def marked(batches):
        mask = np.zeros(FILTER_BITS // 8, np.uint8)
        for part, bits in marks.value.items():
            mask[part << 12 : (part << 12) + len(bits)] = np.frombuffer(bits, np.uint8)
        for batch in batches:
            h = batch.column("tkey").to_numpy() % FILTER_BITS
            at = np.flatnonzero(mask[h >> 3] >> (h & 7) & 1)
            for lo in range(0, len(at), 512):
                yield batch.take(pa.array(at[lo : lo + 512]))

    # Texts, not their features, are shuffled: they take a third of the space.
    found = rows.mapInArrow(marked, f"doc_id {kind}, tkey long, text binary").alias("r")
    sets = found.join(placed.alias("m"), F.col("r.tkey").eqNullSafe(F.col("m.tkey")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id"))).select("key", "root", "block", "blocks", "text")

    def compare(batches):
        shingles, at, held = Shingler(words), None, {}

        def flush():
            keys = list(held)
            return edge_batch(linked_forest(keys, [held[k][1] for k in keys], [held[k][0] for k in keys], at[1] != at[2], num))

        for batch in batches:
            for root, i, j, key, block, text in zip(*[batch.column(c).to_pylist() for c in ("root", "i", "j", "key", "block")], batch.column("text"), strict=True):
                if at != (root, i, j):
                    if len(held) > 1:
                        yield flush()
                    at, held = (root, i, j), {}
                if key not in held:
                    held[key] = (block, shingles(text.as_py()))
        if len(held) > 1:
            yield flush()

    links = components(in_block_pairs(sets, ["root"]).mapInArrow(compare, "a long, b long"))
    return facts.drop("bins").join(links, facts["key"] == links["v"], "left").select("doc_id", "tkey", "n", F.coalesce("root", "key").alias("root"))


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs: components of Jaccard >= num / 100.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words than a shingle has its
    whole sequence as one. Null, empty and blank texts have no features (0) and link with nothing: their component is
    their own id. Of a component the smallest id names it; null ids name none unless all are null. Repeated ids and
    copies are linked as any rows with equal sets. Sets are told apart by 64-bit keys of their hashed features. Empty
    table: no rows. Only the two named columns are read.
    """
    labelled = materialize(labelled_rows(docs, **options), "labelled")
    names = labelled.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return labelled.join(names, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each component left: the smallest id (a null id after all others), then the least hash of
    the text. Texts without features stay. Rows that repeat both id and text stay or go together."""
    labelled = materialize(labelled_rows(docs, text_col=text_col, id_col=id_col, **options), "labelled")
    mark = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tkey")
    first = labelled.filter("n > 0").groupBy("root").agg(F.min(mark).alias("first"))
    gone = labelled.filter("n > 0").join(first, "root").filter(mark != F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("tkey").alias("gone_tkey"))
    gone = materialize(gone, "gone").alias("gone")
    tkey, rows = F.xxhash64(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))), docs.select(F.struct("*").alias("row"))
    kept = rows.join(gone, tkey.eqNullSafe(F.col("gone.gone_tkey")) & F.col(f"row.`{id_col}`").eqNullSafe(F.col("gone.gone_id")), "left_anti")
    return kept.select("row.*")
