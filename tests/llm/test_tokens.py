"""Operators 1, 5 and 8 against the tokenizer libraries, over whole tables and odd texts."""

import hashlib
import random
import zlib
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelyte.llm.bpe_fst import BpeTransducer, Codec, Utf8Stream, encode_decode, read_ranks
from panelyte.llm.packing import balance, pack
from panelyte.llm.pieces import PieceCache
from panelyte.llm.queries import QUERIES
from panelyte.llm.token_counts import frequent_pieces, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "a  b", "a\n b", "\x1ca \x1d b", "x<|endoftext|>y  <|endoftext|> z", "　　 k \xa0z", "é" * 1500, "= " * 200 + "=" * 500,
    "it's 'll DON'T 've 12 345", "\U0001f600 \U0001f468‍\U0001f469", "a b" * 4000, "a  b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "null id", "y", 2), (3, "again", "z", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


@pytest.fixture(scope="module")
def json_tok():
    return Tokenizer.from_file(JSON)


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_counts_match_library(spark, sf, docs, json_tok):
    want = {i: (len(t.encode()), len(json_tok.encode(t, add_special_tokens=False).ids)) for i, t in texts(spark, sf).items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    assert got == want
    out = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, JSON, limit=5, table_size=4, tracked=64, cache_size=3).collect())
    all_texts = [t or "" for t in ODD] + ["null id", "again"]
    assert out == sorted((len(t.encode()), n, n > 5) for t in all_texts for n in [len(json_tok.encode(t, add_special_tokens=False).ids)])
    assert token_counts(docs.limit(0), JSON).collect() == []


def test_transducer_matches_tiktoken(spark, sf, docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    for i, n, a, b in QUERIES["op5_bpe_transducer"](spark, sf).collect():
        ids = enc.encode_ordinary(t := texts_cache(spark, sf)[i])
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = sorted((r.ids, r.decoded) for r in encode_decode(docs, RANKS, P.PATTERN).collect())
    assert got == sorted((enc.encode_ordinary(t or ""), t or "") for t in [*ODD, "null id", "again"])
    assert encode_decode(docs.limit(0), RANKS, P.PATTERN).collect() == []


_texts: dict = {}


def texts_cache(spark, sf):
    return _texts.setdefault(sf, texts(spark, sf))


def test_transducer_resets_and_emits_early():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"bc": 258, b"abc": 259}
    enc = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    machine = BpeTransducer(ranks, max_states=3)
    for text in ["abcababcabbcab" * k for k in range(1, 20)] + ["bcbcab", "c", "ababab", "abbc"]:
        assert machine.encode(text.encode()) == enc.encode_ordinary(text)
    machine = BpeTransducer(ranks)
    machine.encode(b"abab" * 500)
    assert max(len(held) for state in machine.states for _, _, held in state) < 5


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_utf8_stream_keeps_characters_whole(size):
    data = "aé€\U0001f600z".encode()
    stream = Utf8Stream()
    parts = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)] + [stream.finish()]
    assert b"".join(parts) == data and all(p.decode() is not None for p in parts)
    broken = Utf8Stream()
    assert broken.feed(b"a\xe2\x82") + broken.feed(b"\xffb\xf0") + broken.finish() == b"a\xe2\x82\xffb\xf0"


def check_packing(pieces, want_ids, seq_len):
    seqs, docs = {}, {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    padding = 0
    for spans in seqs.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= seq_len
        padding += 0 if at & (at - 1) == 0 else seq_len - at
    assert padding == 0
    assert docs.keys() == want_ids.keys()
    for doc, spans in docs.items():
        at, ids = 0, want_ids[doc]
        for start, n, crc, total in sorted(spans):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(array("I", ids[start : start + n]).tobytes())
            at += n
        assert at == len(ids)


def test_packing(spark, sf, docs, json_tok):
    want = {i: json_tok.encode(t, add_special_tokens=False).ids + [1] for i, t in texts(spark, sf).items()}
    check_packing(QUERIES["op8_packing"](spark, sf).collect(), want, 2048)
    unique = docs.filter("doc_id is not null").dropDuplicates(["text"])
    rows = {r.doc_id: json_tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in unique.collect()}
    if len(rows) == unique.count():
        check_packing(pack(unique, JSON, seq_len=64, block_tokens=500, cache_size=2).collect(), rows, 64)
    assert pack(docs.limit(0), JSON).collect() == []
    assert sum(r.length for r in pack(docs, JSON).collect()) == sum(len(json_tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*ODD, "null id", "again"])


def test_balance_prefers_the_cheapest_sequence():
    pieces = balance([6, 5, 3, 2], 8, 1.0, 0.1)
    assert sorted(n for _, _, n, _, _ in pieces) == [2, 3, 5, 6]
    assert {d: s for d, _, _, s, _ in pieces} == {0: 0, 1: 1, 2: 1, 3: 0}
    assert balance([], 8, 1.0, 0.1) == []


def test_texts_without_spaces_stay_small(spark):
    """Long distinct texts without spaces: nothing of them in the table of frequent pieces, caches bounded, counts right."""
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("abcdefgh", k=20_000)) for _ in range(300)] + ["a b " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot = frequent_pieces(df, "text", 8192, 16384)
    assert hot and sum(map(len, hot)) < 1000
    tok = Tokenizer.from_file(JSON)
    got = {r.doc_id: r.n_tokens for r in token_counts(df, JSON).collect()}
    assert all(got[i] == len(tok.encode(texts[i], add_special_tokens=False).ids) for i in (0, 7, 299, 300))
    cache = PieceCache(lambda many: [len(p) for p in many], limit_chars=1 << 16)
    for t in texts:
        cache.learn({t, "a"})
        assert cache[t] == len(t) + 1 and sum(map(len, cache)) + sum(map(len, cache.old)) < (1 << 16) + 3 * 20_001


def test_token_pairs_fit_as_merging_their_bytes_says():
    """Pairs are told by undoing merges, without merging a pair's bytes; held against that definition."""
    rnd, odd = random.Random(8), {bytes([b]): 300 - b for b in range(97, 101)} | {b"ab": 3, b"aa": 1, b"abc": 4, b"bc": 2, b"aaaa": 6, b"abab": 5, b"dab": 9}
    for ranks, several in ((read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), 20_000), (odd, 400)):
        machine, tokens = BpeTransducer(ranks), list(ranks.values())
        pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(several)] + [(t, t) for t in tokens[:several]] + [(-1, t) for t in tokens]
        for t in rnd.choices([t for t in ranks if len(t) > 1], k=several):
            k = rnd.randrange(1, len(t))
            if t[:k] in ranks and t[k:] in ranks:
                pairs.append((ranks[t[:k]], ranks[t[k:]]))
        merge, merged = machine.merge, []
        machine.merge = lambda piece, *least: merged.append(piece) or merge(piece, *least)
        fits = [machine.fit(a, b) for a, b in pairs]
        assert fits == [merge(b"".join(machine.bytes_of[t] for t in (a, b) if t >= 0)) == [t for t in (a, b) if t >= 0] for a, b in pairs]
        assert True in fits and False in fits and set(merged) <= set(ranks)


def test_a_match_that_pieces_share_is_encoded_once():
    codec, asked = Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, 1000), []
    encode = codec.machine.encode
    codec.machine.encode = lambda piece: asked.append(piece) or encode(piece)
    texts = ["", "x qwertyuiop, qwertyuiop. (qwertyuiop) qwertyuiop's"]
    got = codec.encode(texts)
    assert asked.count(b" qwertyuiop") == 1 and got[0] == [] and b"".join(codec.decode(got[1])).decode() == texts[1]
    assert got[1] == [i for m in codec.find(texts[1]) for i in encode(m.encode())]
