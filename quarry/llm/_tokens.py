"""Token ids of whole texts by a ``tokenizers`` file, with a cache of word pieces.

Where a file lower-cases and splits as ``_RULES`` says, a word has the same ids
wherever it stands, so texts of plain characters (printable ASCII and Latin-1
letters) are split here and each distinct word goes through the tokenizer once for
as long as the cache (``cap`` words) holds it.  All other texts, those that hold the
text of a special token, and all texts of other files go through the tokenizer whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from . import _memory

#: Plain characters, as Latin-1 bytes: printable ASCII, white space, and letters with accents.
_PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
#: The normaliser and splitter that words are cached for; fixed values of the file format.
_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
)
#: The same splitting pattern for lower-case plain text.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\x0b\x0c\r 0-9a-zß-öø-ÿ]+")


def _plain(text: str) -> bool:
    try:
        return "<|" not in text and not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


class _Slots(dict):
    """Word to slot; an unknown word takes the next slot and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


@functools.lru_cache(maxsize=2)
def tokeniser(path: str) -> Tokeniser:
    """One tokeniser for the life of the worker process, so that its cache serves all its tasks."""
    return Tokeniser(path)


_memory.cached("tokens", tokeniser.cache_clear)


class Tokeniser:
    """``encode(texts)`` gives the ids of all texts end to end, and each text's count."""

    def __init__(self, path: str, cap: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.cap = Tokenizer.from_file(path), cap
        rule = lambda part: json.loads(part.__getstate__()) if part else {}
        split = rule(self.whole.pre_tokenizer).get("pretokenizers", [None])[0]
        special = all(t.content.startswith("<|") for t in self.whole.get_added_tokens_decoder().values())
        self.by_word = special and (rule(self.whole.normalizer), split) == _RULES
        self._clear()

    def _clear(self) -> None:
        self.slot = _Slots()
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        """Ids of words that took the last slots, in their order."""
        got = self.whole.encode(" ".join(words), add_special_tokens=False)
        owner, ids = np.array(got.word_ids, np.int64), np.array(got.ids, np.int32)
        if not len(owner) or owner[-1] != len(words) - 1 or np.any(np.diff(owner) > 1):  # not one piece a word: one by one
            each = [e.ids for e in self.whole.encode_batch(words, add_special_tokens=False)]
            ids, sizes = np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each])
        else:
            sizes = np.bincount(owner, minlength=len(words))
        n = len(self.slot) - len(words)
        while n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        chunks: list = [None] * len(texts)
        plain, places = [], []
        if len(self.slot) > self.cap:
            self._clear()
        for i, t in enumerate(texts):
            if not self.by_word or not _plain(t):
                chunks[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32)
            else:
                plain.append(i)
                words = _SPLIT.findall(t.lower())
                places.append(np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words)))
        if self.slot.new:
            self._learn(self.slot.new)
            self.slot.new = []
        for i, at in zip(plain, places, strict=True):
            size, start = self.size[at], self.start[at]
            ends = np.cumsum(size)
            n = int(ends[-1]) if len(ends) else 0
            chunks[i] = self.flat[np.repeat(start - ends + size, size) + np.arange(n)]
        for i, c in enumerate(chunks):
            counts[i] = len(c)
        return (np.concatenate(chunks) if chunks else np.empty(0, np.int32)), counts
