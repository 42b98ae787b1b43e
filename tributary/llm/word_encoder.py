"""Encoding by the tokenizers library through a bounded cache of pre-tokens.

A byte-level BPE tokenizer encodes each match of its splitting pattern on its own, so a text's ids are
those of its matches in order. Each Python worker keeps the ids of the matches it has met, encoded by the
library, in two generations: when the younger one is full it becomes the older one, which is dropped. Results don't
depend on the cache. A text in which one of the tokenizer's added tokens occurs is given to the library as a whole.

A match needs no second splitting, so where the definition has nothing besides a byte-level pre-tokenizer and the model,
the library's model gets the match's bytes, written as the byte-level alphabet writes them.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable
from operator import itemgetter

import numpy as np

from .splitting import splitter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens of a generation at most (about 150 bytes each).
GENERATION = 250_000
#: Longer ones are encoded each time.
CACHED_LENGTH = 64


def alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(kept))
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


class Words(dict):
    """Ids of words, as bytes of 32-bit integers; `encode` gives those of a word that isn't there, which then is."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.encode(word)).tobytes()
            if len(word) > CACHED_LENGTH:
                return ids
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """`definition`: the tokenizer's JSON. Ids are those of the library with add_special_tokens=False."""

    _kept: dict[int, WordEncoder] = {}

    def __init__(self, definition: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        told = json.loads(definition)
        self.added = [token["content"] for token in told.get("added_tokens") or []]
        self.find = splitter(pattern)
        before = told.get("pre_tokenizer") or {}
        bare = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not any(told.get(k) for k in ("normalizer", "truncation", "padding"))
        self.words = Words(self.by_model() if bare else self.by_tokenizer)

    @classmethod
    def of(cls, definition: str, pattern: str) -> WordEncoder:
        """The worker's own encoder: it outlives a task where Python workers are used again."""
        key = hash((definition, pattern))
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(definition, pattern)
        return cls._kept[key]

    def by_tokenizer(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def by_model(self) -> Callable[[str], list[int]]:
        tokenize, written = self.tokenizer.model.tokenize, alphabet()

        def encode(word: str) -> list[int]:
            return [token.id for token in tokenize(word.encode().decode("latin-1").translate(written))]

        return encode

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        found = []
        for text in texts:
            if any(token in text for token in self.added):
                found.append(np.array(self.by_tokenizer(text), "<u4"))
            else:
                words = self.find(text)
                told = itemgetter(*words)(self.words) if len(words) > 1 else map(self.words.__getitem__, words)
                found.append(np.frombuffer(b"".join(told), "<u4"))
        return found
