"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of the corpus's frequent pieces and their token counts. Its pieces come from
mergeable heavy-hitter sketches over all rows (bounded state per task, no shuffle of pieces), and it is broadcast: at
most `table_size` entries of LONG bytes whatever the corpus holds. Tier two is a bounded cache in each Python worker that encodes
what tier one misses. The sketch only decides what is fast: every count comes from the tokenizer.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.pieces import LONG, PieceCache, cut, load_tokenizer, piece_encoder, worker_cache
from panelyte.llm.shared import text_groups


def frequent_pieces(docs: DataFrame, text_col: str, table_size: int, tracked: int) -> list[str]:
    """The most frequent pieces of all texts, of LONG bytes at most each: one sketch per task, merged in groups of tasks
    and then once more. So sketches, what the driver gets and the broadcast are bounded in bytes."""
    cuts = F.split(F.coalesce(F.col(text_col), F.lit("")), r" (?=\S)")
    pieces = docs.select(F.explode(F.filter(cuts, lambda p: F.octet_length(p) <= LONG)).alias("piece"))
    return [
        r["item"]
        for r in pieces.groupBy((F.spark_partition_id() % 64).alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate(piece, {tracked})").alias("sketch"))
        .groupBy(F.lit(1))  # no group for an empty table, which has no sketch to combine
        .agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
        .select(F.inline(F.expr(f"approx_top_k_estimate(sketch, {table_size})")))
        .collect()
        if r["item"] is not None
    ]


def _lengths(encode):
    return lambda texts: [len(ids) for ids in encode(texts)]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 512,
    table_size: int = 8192,
    tracked: int = 16384,
    cache_size: int = 800_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    n_tokens is what the tokenizer file gives for the whole text without begin, end or added special tokens; special
    strings inside a text count as the library's default finds them. Null text: as empty (0 bytes, 0 tokens). Rows
    with a null or repeated id are counted like any other, one row out per row in. Empty table: no rows. Only the
    two named columns are read, so other columns and their names do not matter.
    """
    texts = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), texts.alias("text"), F.octet_length(texts).cast("long").alias("n_bytes"))
    hot = frequent_pieces(docs, text_col, table_size, tracked)
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(hot, _lengths(piece_encoder(tokenizer_path))([" " + p for p in hot]), strict=True)))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    key = uuid.uuid4().hex  # of this table in the workers' caches

    def count(batches):
        tok, special = load_tokenizer(tokenizer_path)
        encode, cache = worker_cache(("count", tokenizer_path, key), lambda: (e := _lengths(piece_encoder(tokenizer_path)), PieceCache(e, shared.value, cache_size)))
        for batch in batches:
            out: list[int] = []
            for _, group in text_groups([batch], "doc_id", "text"):
                cuts = [cut(t) for t in group]
                firsts = encode([c[0] for c in cuts])
                cache.learn(set().union(*(c[1:] for c in cuts)))
                get = cache.__getitem__
                for text, pieces, n in zip(group, cuts, firsts, strict=True):
                    if any(s in text for s in special):  # a special string splits the text before the pattern does
                        out.append(len(tok.encode(text, add_special_tokens=False).ids))
                    else:
                        out.append(n + sum(map(get, pieces[1:])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
