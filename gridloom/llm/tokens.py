"""Token ids of whole texts by a public vocabulary file with word-end marks.

The vocabulary splits a normalised text into words that never share a token, so a worker
keeps the ids of words it has met and sends only new words to the tokenizer. Texts with
characters beyond U+012F, or with the strings of special tokens, go to the tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np

# The vocabulary file's own split pattern, for characters up to U+012F.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-į"
_DIGIT = "0-9²³¹¼-¾"
_BLANK = "\t-\r \u0085\u00a0"
_SPLIT = re.compile(f"[{_LETTER}]+|[{_DIGIT}]|'(?:s|t|re|ve|m|ll|d)|[^{_LETTER}{_DIGIT}{_BLANK}]+")
_BEYOND = re.compile("[^\x00-į]")


class _Index(dict):
    """word -> number; a word not met before gets the next number and is listed in new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Tokens:
    """ids(texts) with a bounded store of known words."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.most, self.whole = path, most, None
        # For words that are normalised and split already.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.words.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, text: str) -> list[int]:
        """By the vocabulary file's own rules; few texts need it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        ids = np.array(self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        assert len(last) == len(new), "the vocabulary split a word"
        self.first = np.concatenate([self.first, last + self.first[-1]])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > self.most:
            self.clear()
        look = self.index.__getitem__
        at = []
        for t in texts:
            plain = t.isascii() or not _BEYOND.search(t)
            words = _SPLIT.findall(t.lower()) if plain and "<|" not in t else None
            at.append(None if words is None else np.fromiter(map(look, words), np.int64, len(words)))
        if self.index.new:
            self._learn()
        out = []
        for text, a in zip(texts, at):
            if a is None:
                out.append(np.array(self._encode(text), np.uint32))
                continue
            start, n = self.first[a], self.first[a + 1] - self.first[a]
            out.append(self.flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return out
