"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. A sequence of tokens is what BPE gives exactly if each of its neighbouring pairs is what BPE gives for the
pair's bytes, and every prefix of a text has one such sequence. The transducer reads bytes and holds all hypotheses
that can still become that sequence: (node in the trie of tokens, last whole token, tokens not yet emitted). Its
deterministic states are sets of hypotheses, made when first reached. What all hypotheses of a state agree on is
emitted at once, so the output lags by no more than the longest token allows.

Decoding. Token ids give bytes in blocks; a small state machine over the last bytes of a block holds back a character
that is not complete yet.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.pieces import PieceCache, cut, worker_cache
from panelyte.llm.shared import text_groups


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BpeTransducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.halves: dict[int, tuple | None] = {}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node; node 0 is the root
        self.token_at: dict[int, int] = {}
        nodes = 0
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    nodes += 1
                    self.child[key] = nodes
                node = self.child[key]
            self.token_at[node] = rank
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states, self.index, self.moves, self.fits = [start], {start: 0}, {}, {}

    def merge(self, piece: bytes, least: int = 1) -> list[int]:
        """BPE by its definition, down to `least` parts; used only on the bytes of single tokens and odd pairs."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they meet (or the one token, at the start)."""
        key = left << 32 | right
        fits = self.fits.get(key)
        if fits is None:
            fits = self.fits[key] = self._split(right) is not None and (left < 0 or self._split(left) is not None and self._apart(left, right))
        return fits

    def _split(self, token: int) -> tuple[int, int] | tuple[()] | None:
        """The two tokens whose merge is this one: () for a single byte, None if BPE makes something else of its bytes."""
        if token not in self.halves:
            piece = self.bytes_of[token]
            parts = self.merge(piece, 2) if len(piece) > 1 else []
            self.halves[token] = tuple(parts) if len(parts) != 1 and (not parts or len(parts) == 2 and self.bytes_of[parts[0]] + self.bytes_of[parts[1]] == piece) else None
        return self.halves[token]

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens: their merges are undone, the latest first, and before each is undone
        the tokens that meet are looked up. A merge across is made if it ranks before that which ended their meeting
        (of equal ranks the left one is made first)."""
        ranks, bytes_of, until = self.ranks, self.bytes_of, 1 << 60
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < until:
                return False
            a, b = self._split(left), self._split(right)
            if a and (not b or left > right):
                left, until = a[1], left
            elif b:
                right, until = b[0], right + 1
            else:
                return True

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: next state and what it emits."""
        found = []
        for node, last, held in self.states[state]:
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            found.append((at, last, held))
            token = self.token_at.get(at)
            if token is not None and self.fit(last, token):
                found.append((0, token, (*held, token)))
        shared = 0
        shortest = min(len(h[2]) for h in found)
        while shared < shortest and len({h[2][shared] for h in found}) == 1:
            shared += 1
        emitted = found[0][2][:shared]
        target = tuple(sorted((node, last, held[shared:]) for node, last, held in found))
        if target not in self.index:
            self.index[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << 8 | byte] = (self.index[target], emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            state, emitted = moves.get(state << 8 | byte) or self._move(state, byte)
            out += emitted
        ended = [held for node, _, held in self.states[state] if node == 0]
        if len(ended) != 1:
            raise ValueError("the ranks are not those of a byte-level BPE")
        return out + list(ended[0])


class Utf8Stream:
    """Incremental UTF-8: feed() returns the complete characters so far as bytes, finish() what is left.

    The machine's state is the number of bytes that the open character still needs and the bytes it has.
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _needs(lead: int) -> int:
        return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1

    def feed(self, block: bytes) -> bytes:
        data = self.open + block
        end = len(data)
        for back in range(1, min(3, end) + 1):
            b = data[end - back]
            if b & 0xC0 != 0x80:  # the lead of the last character
                if self._needs(b) > back:
                    end -= back
                break
        self.open = data[end:]
        return data[:end]

    def finish(self) -> bytes:
        left, self.open = self.open, b""
        return left


class Codec:
    """Encoding and decoding of whole texts in one worker."""

    def __init__(self, ranks_path: str, pattern: str, cache_size: int):
        ranks = read_ranks(ranks_path)
        self.machine, self.find = BpeTransducer(ranks), regex.compile(pattern).findall
        by_rank = range(max(ranks.values(), default=-1) + 1)
        self.bytes_of, self.text_of = [self.machine.bytes_of.get(r) for r in by_rank], [str(r) for r in by_rank]
        self.cache = PieceCache(self.many, limit=cache_size)

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a match that the texts share (a word beside other punctuation) is encoded once."""
        found = [self.find(t) for t in texts]
        ids = {m: self.code(m) for m in set(chain.from_iterable(found))}
        return [ids[ms[0]] if len(ms) == 1 else b"".join(map(ids.__getitem__, ms)) for ms in found]

    def code(self, match: str) -> bytes:
        """Ids as unsigned 32-bit integers: compact in the cache, joined without touching them."""
        return array("I", self.machine.encode(match.encode())).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.code, self.find(text)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cuts = [cut(t) for t in texts]
        self.cache.learn(set().union(*(c[1:] for c in cuts)))
        get = self.cache.__getitem__
        return [array("I", b"".join((self.ids(c[0]), *map(get, c[1:])))).tolist() for c in cuts]

    def decode(self, ids: list[int], block: int = 4096):
        """Blocks of complete characters, as bytes."""
        stream, get = Utf8Stream(), self.bytes_of.__getitem__
        for i in range(0, len(ids), block):
            yield stream.feed(b"".join(map(get, ids[i : i + block])))
        yield stream.finish()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, cache_size: int = 800_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep: ids, decoded) for every row of docs.

    Each match of `pattern` is encoded alone, without special tokens, over the whole text; the ids are then decoded
    again. Null text: as empty (no ids, digests of nothing). Rows with null or repeated ids give one row each. Empty
    table: no rows. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(batches):
        codec = worker_cache(("fst", ranks_path, pattern), lambda: Codec(ranks_path, pattern, cache_size))
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for keys, texts in text_groups([batch], "doc_id", "text"):
                counts, ids_hash, text_hash, all_ids, decoded = [], [], [], [], []
                for ids in codec.encode(texts):
                    digest, parts = hashlib.sha256(), []
                    for part in codec.decode(ids):
                        digest.update(part)
                        parts += [part] * keep
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(codec.text_of.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(digest.hexdigest())
                    if keep:
                        all_ids.append(ids)
                        decoded.append(b"".join(parts).decode(errors="replace"))
                columns = [pa.array(keys, kind), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
