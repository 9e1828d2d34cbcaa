"""Cost-balanced packing of documents into sequences.

A document's cost in a sequence is linear * n + quadratic * n^2 (its share of the feed-forward and of the attention
work). Each task packs its own documents in blocks of bounded size, so there is no shuffle and no key that could be
hot: in a block the documents go, by descending tokens, to the sequence of lowest cost that has token capacity left,
and what does not fit goes on as a document of its own. A block's capacity is exactly its tokens: full sequences, and
for the rest sequences whose lengths are powers of two, which are not padded.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.pieces import PieceCache, cut, load_tokenizer, piece_encoder, worker_cache
from panelyte.llm.shared import text_groups


def capacities(tokens: int, seq_len: int) -> list[int]:
    """Sequence lengths that hold the tokens without padding."""
    full, rest = divmod(tokens, seq_len)
    return [seq_len] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balance(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset there) for each piece; ties go to the earlier one."""
    room = capacities(sum(lengths), seq_len)
    used = [0] * len(room)
    open_ = [(0.0, k) for k in range(len(room))]
    left = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(left)
    out = []
    while left:
        n, doc, start = heapq.heappop(left)
        cost, seq = heapq.heappop(open_)
        take = min(-n, room[seq] - used[seq])
        out.append((doc, start, take, seq, used[seq]))
        used[seq] += take
        if used[seq] < room[seq]:
            heapq.heappush(open_, (cost + linear * take + quadratic * take * take, seq))
        if take < -n:
            heapq.heappush(left, (n + take, doc, start + take))
    return out


def _packed(encode):
    return lambda texts: [array("I", ids).tobytes() for ids in encode(texts)]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    seq_len: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_tokens: int = 1 << 21,
    keep_ids: bool = True,
    cache_size: int = 800_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids: ids).

    A document's ids are those of its whole text without special tokens added, then end_id, so a null or empty text
    is one token. Every id lies in one piece; a sequence's pieces lie without gaps from offset 0; sequence ids are
    unique over all tasks. seq_len is a power of two. Rows with null or repeated ids are packed like any other. Empty
    table: no rows. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids

    def run(batches):
        tok, special = load_tokenizer(tokenizer_path)
        encode, cache = worker_cache(("pack", tokenizer_path), lambda: (e := _packed(piece_encoder(tokenizer_path)), PieceCache(e, limit=cache_size)))
        end = array("I", [end_id]).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        block: list[tuple[object, bytes]] = []
        held, key_type = 0, pa.int64()

        def flush():
            nonlocal sequence
            lengths = [len(ids) // 4 for _, ids in block]
            pieces = balance(lengths, seq_len, linear, quadratic)
            spans = [memoryview(block[d][1])[4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = [
                pa.array([block[p[0]][0] for p in pieces], key_type),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                pa.array([lengths[p[0]] for p in pieces], pa.int64()),
                pa.array([sequence + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns, names = [*columns, pa.array([bytes(x) for x in spans], pa.binary())], [*names, "ids"]
            sequence += 1 + max((p[3] for p in pieces), default=0)
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for keys, texts in text_groups([batch], "doc_id", "text"):
                cuts = [cut(t) for t in texts]
                firsts = encode([c[0] for c in cuts])
                cache.learn(set().union(*(c[1:] for c in cuts)))
                get = cache.__getitem__
                for key, text, pieces, first in zip(keys, texts, cuts, firsts, strict=True):
                    if any(s in text for s in special):
                        ids = array("I", tok.encode(text, add_special_tokens=False).ids).tobytes() + end
                    else:
                        ids = b"".join((first, *map(get, pieces[1:]), end))
                    block.append((key, ids))
                    held += len(ids) // 4
                    if held >= block_tokens:
                        yield flush()
                        block, held = [], 0
        if block:
            yield flush()

    return rows.mapInArrow(run, schema)
