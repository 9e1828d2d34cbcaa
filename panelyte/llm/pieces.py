"""Cutting texts where a byte-level BPE pre-tokeniser always cuts, and worker caches over the cut pieces.

The pre-tokenising pattern gives a token boundary before every space that a non-space follows: such a space always
opens a token, and nothing before it can look past it. A text is therefore the concatenation of its pieces, each
piece but the first standing for one space plus itself, and each can be encoded alone. Python's notion of white
space covers the pattern's, so a cut is never made where the pattern would not make one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

_LOOSE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """Pieces of text; joining them by one space gives the text back."""
    return _CUT.split(text) if _LOOSE.search(text) else text.split(" ")


#: Longer pieces are rarely met again: caches count their characters, and no table of frequent ones holds them.
LONG = 64


class PieceCache(dict):
    """Piece -> value of `encode_many([prefix + piece])`, kept in one Python worker.

    Starts from a fixed table and grows by what the worker meets. With `limit` / 2 pieces, or `limit_chars` / 2 characters
    of pieces longer than LONG, the young generation becomes the old one; pieces met again move on, the others go with
    the next change. So memory is bounded in bytes whatever the corpus holds (a text without spaces is one piece), and
    pieces that recur stay.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], fixed: dict | None = None, limit: int = 800_000, prefix: str = " ", limit_chars: int = 1 << 22):
        super().__init__(fixed or {})
        self.encode_many, self.fixed, self.half, self.old, self.prefix = encode_many, fixed or {}, max(1, limit // 2), {}, prefix
        self.chars, self.half_chars = 0, limit_chars // 2

    def learn(self, pieces: set[str]) -> None:
        """Make sure of the pieces; what neither generation has is encoded in one call."""
        if len(self) > self.half or self.chars > self.half_chars:
            self.old, self.chars = dict(self), 0
            self.clear()
            self.update(self.fixed)
        missing = pieces.difference(self)
        old = self.old
        again = {p: old[p] for p in missing if p in old}
        self.update(again)
        self.chars += sum(len(p) for p in missing if len(p) > LONG)
        new = list(missing.difference(again))
        if new:
            self.update(zip(new, self.encode_many([self.prefix + p for p in new] if self.prefix else new), strict=True))


#: One cache per worker process, purpose and tokenizer file: tasks that run later in the worker find it warm.
_WORKER: dict = {}


def worker_cache(key: tuple, make: Callable[[], object]):
    if key not in _WORKER:
        for old in [k for k in _WORKER if k[0] == key[0]]:
            del _WORKER[old]
        _WORKER[key] = make()
    return _WORKER[key]


def load_tokenizer(path: str):
    """The library's tokenizer with its defaults: no truncation, no padding, special strings in a text found."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, [t.content for t in tok.get_added_tokens_decoder().values()]


#: Fixed value: the pattern that the byte-level pre-tokeniser of these files splits by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def piece_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts without special strings, as the file's library gives them.

    A byte-level BPE whose merges are numbered in their order is a table of ranks, which tiktoken applies several
    times faster; any other file goes through its own library.
    """
    with open(path) as f:
        said = json.load(f)
    model, vocab = said["model"], said["model"].get("vocab", {})
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    pre = said.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not said.get("normalizer")
    if not plain or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
        tok, _ = load_tokenizer(path)
        return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
    ordinary = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [ordinary(t) for t in texts]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE files: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
