"""Exact and fast use of a BPE tokenizer file with word ends (lower case, white space dropped).

Plain Latin texts are split here, at white space and then into words, which no match spans; each word is encoded by a byte-pair
core with the file's merges, and the ids of what stands between white space are remembered up to a bound. All other texts, and those that hold one of the file's added tokens, go whole through the tokenizers
library, which reads added tokens in any text. Both give the library's ids: within the span of a token the merges do not
depend on what stands around it, so a core that merges by token and one that merges by pair agree on every token that the
merges reach, which are all that occur. Tests hold words, texts and added tokens against the library.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: Characters below U+0180 without controls, unusual spaces and U+0130: lower-casing and normalising act on each alone.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-įı-ſ]*")
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def _class(first: str) -> str:
    import unicodedata

    return "".join(re.escape(chr(c)) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == first)


class Memory(dict):
    """Results of a function of strings: a bounded number of short ones met twice is kept, all others are worked out each time."""

    def __init__(self, most: int, work):
        super().__init__()
        self.most, self.work, self.once = most, work, set()

    def __missing__(self, key: str) -> bytes:
        value = self.work(key)
        if len(self) < self.most and len(key) <= 64:
            if key in self.once:
                self[key] = value
                self.once.remove(key)
            elif len(self.once) < self.most:
                self.once.add(key)
            else:
                self.once = {key}
        return value


class WordBpe:
    """ids(text) as the tokenizers library gives them without special tokens; ids_bytes(text) as little-endian uint16."""

    REMEMBERED = 300_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self.added = sorted({t["content"].lower() for t in content.get("added_tokens") or ()} - {""})
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = self.whole.get_vocab_size()
        raw = {c: bytes([b]) for b, c in _byte_characters().items()}

        def as_bytes(token: str) -> bytes:
            last = token.endswith(end)
            return b"".join(raw[c] for c in (token[: -len(end)] if last else token)) + b"\xff" * last

        singles = {as_bytes(t): i for t, i in vocab.items() if len(t) == 1 or len(t) == 1 + len(end) and t.endswith(end)}
        order = sorted((b for b in singles if len(b) == 2), key=lambda b: singles[b])
        ids = [singles[b] for b in order]
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            order.append(as_bytes(a + b))
            ids.append(vocab[a + b])
        known = set(order)
        for b in [bytes([x]) for x in range(256)]:
            if b not in known:
                order.append(b)
                ids.append(singles.get(b, 0))
        ranks = {b: r for r, b in enumerate(dict.fromkeys(order))}
        self.core = tiktoken.Encoding("words", pat_str=r"[^\xff]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        table = dict(zip(order, ids, strict=True))
        self.of_rank = np.array([table[b] for b in ranks], np.uint16)
        self.id_of = self.of_rank.tolist()
        letters, numbers = _class("L"), _class("N")
        self.words = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\s{letters}{numbers}]+").findall
        piece, pairs = self.core.encode_single_piece, [i.to_bytes(2, "little") for i in self.id_of]
        join, pair = b"".join, pairs.__getitem__

        def word(word: str) -> bytes:
            return join(map(pair, piece(word.encode() + b"\xff")))

        def chunk(chunk: str) -> bytes:
            return word(chunk) if chunk.isalpha() else join(map(self.word, self.words(chunk)))

        self.word = Memory(self.REMEMBERED, word).__getitem__
        self.chunk = Memory(self.REMEMBERED, chunk).__getitem__

    def ids_bytes(self, text: str) -> bytes:
        lower = text.lower()
        odd = _CONTROL.search(text) if text.isascii() else _PLAIN.fullmatch(text) is None
        if odd or any(t in lower for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
        return b"".join(map(self.chunk, lower.split()))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids_bytes(text), np.uint16)


@cache
def word_bpe(path: str) -> WordBpe:
    """One tokenizer for each file and process: the tasks of a Python worker share it and what it remembers."""
    return WordBpe(path)


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
