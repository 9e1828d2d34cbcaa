"""Ranked lexical search: accumulator-limited evaluation, a term at a time, over blocks of documents.

The corpus is walked once to count, in each document, the terms that occur in queries; the counts are a forward index
on shared storage from which document frequencies and lengths follow. Then each task turns its documents, block by
block, into postings and evaluates every item over them: rarest term first, each term adding its exact integer
contribution to the accumulators of its documents. Before a term, what the terms from it on can add at most in this
block is known. Once that is below the kth best score (of the documents met so far, or of the partial scores in the
block), a document without an accumulator can no longer get among the best, so none is created any more; those that
exist are still updated exactly. The best of each task meet in one ranking by item. Documents stay where they are
read: no posting is shuffled, and no common term makes a large group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelyte.llm.shared import discard, materialize

#: Bytes to what a term is made of: digits, letters (lower-cased) and all of UTF-8 beyond ASCII; the rest to spaces.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SLICE = 1 << 20


def slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists, so that a long text is never a list of all its terms."""
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def query_terms(items: DataFrame, item_col: str, query_col: str) -> DataFrame:
    """(item, term, times), one row for each distinct term of an item; rows of the same item are one item."""
    rows = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(query_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["item"].dataType
    of_item = to_arrow_type(kind)

    def count(batches):
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text"), strict=True):
                counts: Counter = Counter()
                for terms in slices(text.as_py()):
                    counts.update(terms)
                if counts:
                    ids = pa.array([item.as_py()] * len(counts), of_item)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item", "term", "times"])

    return rows.mapInArrow(count, f"item {kind.simpleString()}, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def query_blocks(terms: DataFrame, most_terms: int) -> Iterator[DataFrame]:
    """The items' terms in parts of at most most_terms rows each (or one item), however many items there are."""
    parts = 1
    while True:
        dealt = terms.withColumn("part", F.pmod(F.xxhash64("item", F.lit(parts)), F.lit(parts)))
        largest = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("items")).filter("items > 1").agg(F.max("n")).first()[0]
        if (largest or 0) <= most_terms:
            break
        parts *= 2
    for part in range(parts):
        yield dealt.filter(F.col("part") == part).drop("part")


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tfs) of each document with at least one term: its length, and numbers and counts of query terms."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        number = shared.value
        for batch in batches:
            at, lengths, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                n, found = 0, Counter()
                for part in slices(text.as_py()):
                    n += len(part)
                    counts = Counter(part)
                    for t in counts.keys() & number.keys():
                        found[number[t]] += counts[t]
                if n:
                    at.append(i)
                    lengths.append(n)
                    terms.append(list(found))
                    tfs.append(list(found.values()))
            ids = batch.column("doc").take(pa.array(at, pa.int32()))
            arrays = [ids, pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n", "terms", "tfs"])

    return rows.mapInArrow(count, f"doc {rows.schema['doc'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


class Postings:
    """Documents of one block by query term: where they are in the block and what one occurrence in the query adds."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, docs_all: int, terms_all: int):
        m = 75 + np.array([25 * x * docs_all // terms_all for x in n.tolist()], np.int64)  # in Python integers: no overflow on the way
        doc, order = np.repeat(np.arange(len(n)), sizes), np.argsort(terms, kind="stable")
        worth = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[doc])
        terms, self.doc, self.worth = terms[order], doc[order], worth[order]
        known, start = np.unique(terms, return_index=True)
        self.span = dict(zip(known.tolist(), zip(start.tolist(), np.append(start, len(terms))[1:].tolist(), strict=True), strict=True))
        self.most = dict(zip(known.tolist(), (np.maximum.reduceat(self.worth, start).tolist() if len(known) else []), strict=True))
        self.size = len(n)


def kth(scores: np.ndarray, k: int) -> int:
    """The kth largest of the scores above 0; 0 if there are fewer."""
    scores = scores[scores > 0]
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def evaluate(plan: list[tuple[int, int]], block: Postings, k: int, floor: int) -> tuple[np.ndarray, int]:
    """(accumulators of the block, terms that could create some) of an item with plan [(term, weight with repeats)],
    rarest first. Exact for each document that can reach max(floor, kth best of the block); others may be short."""
    plan = [(t, w) for t, w in plan if t in block.span]
    rest = np.cumsum([0, *(w * block.most[t] for t, w in reversed(plan))])[::-1].tolist()
    scores, creating, created = np.zeros(block.size, np.int64), True, 0
    for i, (term, weight) in enumerate(plan):
        lo, hi = block.span[term]
        docs, adds = block.doc[lo:hi], weight * block.worth[lo:hi]
        if creating and created and rest[i] >= floor:
            floor = max(floor, kth(scores, k))
        creating = creating and rest[i] >= floor  # at equality a document with a smaller id may still take the kth place
        if creating:
            created += 1
            scores[docs] += adds
        else:
            held = scores[docs] > 0
            scores[docs[held]] += adds[held]
    return scores, created


def best(index: DataFrame, items: list, plans: list[list[tuple[int, int]]], item_type, k: int, docs_all: int, terms_all: int) -> DataFrame:
    """(item, doc, score): the k best of each task for each item."""
    shared = index.sparkSession.sparkContext.broadcast((items, plans))
    of_item, of_doc = to_arrow_type(item_type), to_arrow_type(index.schema["doc"].dataType)
    names = ["item", "doc", "score"]

    def walk(batches):
        items, plans = shared.value
        held: dict[int, pa.Table] = {}
        for batch in batches:
            lists, tfs = batch.column("terms"), batch.column("tfs")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            block = Postings(batch.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), tfs.flatten().to_numpy(), docs_all, terms_all)
            for i, plan in enumerate(plans):
                before = held.get(i)
                floor = before["score"][k - 1].as_py() if before is not None and len(before) == k else 0
                scores, _ = evaluate(plan, block, k, floor)
                at = np.flatnonzero(scores >= max(1, floor, kth(scores, k)))
                if len(at):
                    new = pa.table({"doc": batch.column("doc").take(pa.array(at)), "score": pa.array(scores[at])})
                    new = new if before is None else pa.concat_tables([before, new])
                    ranked = pc.sort_indices(new, sort_keys=[("score", "descending"), ("doc", "ascending")], null_placement="at_start")
                    held[i] = new.take(ranked[:k]).combine_chunks()
        for i, t in held.items():
            doc, score = (t[c].combine_chunks() for c in ("doc", "score"))
            yield pa.RecordBatch.from_arrays([pa.array([items[i]] * len(t), of_item), doc.cast(of_doc), score], names)

    return index.select("doc", "n", "terms", "tfs").mapInArrow(walk, f"item {item_type.simpleString()}, doc {index.schema['doc'].dataType.simpleString()}, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    most_terms: int = 500_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, from rank 1 on.

    A term is a run of digits, letters and characters beyond ASCII; A-Z are lower-cased. Whole texts count, of any
    length. Null and empty texts have no terms: such documents are never found nor counted, such items find nothing.
    Rows of one item_id (null too) are one item with the terms of all of them. Each row of docs is a document of its
    own, whatever its id; equal scores are ranked by ascending id, null first. Empty tables: no rows. Other columns,
    whatever their names, are not read. Items are taken in parts of at most most_terms distinct terms, each a walk over
    the corpus, so what a task holds of the items does not grow with them.
    """
    wanted = materialize(query_terms(items, item_col, query_col), "queries")
    item_type, found, total = wanted.schema["item"].dataType, [], None
    for part in query_blocks(wanted, most_terms):
        rows = part.collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        index = materialize(forward_index(docs, vocabulary, id_col, text_col), "forward")
        total = total or index.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = {r["t"]: r["n"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
        plans: dict = {}
        for r in rows:
            if (t := vocabulary[bytes(r["term"])]) in df:
                weight = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df[t] + 1)))
                plans.setdefault(r["item"], []).append((t, weight * r["times"]))
        ordered = [sorted(p, key=lambda x: (df[x[0]], x[0])) for p in plans.values()]
        found.append(materialize(best(index, list(plans), ordered, item_type, k, total[0], total[1] or 1), "found"))
        discard(index)
    discard(wanted)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc")))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
lengths as (select doc_id, terms, cast(len(terms) as bigint) as n from d where len(terms) > 0),
totals as (select count(*) as docs, cast(sum(n) as bigint) as all_terms from lengths),
tf as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(terms) as term from lengths) group by all),
df as (select term, count(*) as df from tf group by 1),
q as (select item_id, term, count(*) as times from (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
worth as (select tf.doc_id, term,
  cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms))) as v
  from tf join df using (term) cross join totals where term in (select term from q)),
scores as (select item_id, doc_id, cast(sum(times * v) as bigint) as score from q join worth using (term) group by all)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 20
"""
