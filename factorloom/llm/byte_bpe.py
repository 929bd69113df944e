"""Byte-level BPE by word: one dictionary lookup a word, one merge run a new pre-token.

BPE never merges across pre-tokens, so the ids of a text are the ids of its
pre-tokens in order.  Where every space stands between two characters that are
no white space, a pre-token starts at each space, so the text can be taken word
by word; any other text is split by the tokenizer's own pattern.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cache

import regex

from factorloom.llm.common import Memo

#: Characters for which Python's ``re`` classes agree with the tokenizer's letter, number and space classes.
_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ɏ«»¿¡–—…“”‘’€]")
_FAST = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# fixed value: the public byte-level BPE pre-token pattern, with Unicode white space spelled out
_WS = r"\t-\r\x20\x85\xa0  -     　"
_FULL = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text without special strings; their concatenation is the text."""
    return _FULL.findall(text) if _PLAIN.search(text) else _FAST.findall(text)


class ByteBpe:
    """The tokenizer of a ``tokenizers`` JSON file, with the strings of its special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._ranked = self._by_rank(spec["model"])

    @staticmethod
    def _by_rank(model: dict):
        """A merge routine over bytes, where the vocabulary's ids are its merge order; else None."""
        import tiktoken

        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(set(merged)) != len(merged):
            return None
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in kept}
        byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
        ranks = {bytes(byte[c] for c in s): i for s, i in model["vocab"].items() if all(c in byte for c in s)}
        return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(self, pre_token: str) -> list[int]:
        if self._ranked is None:
            return self.tokenizer.encode(pre_token, add_special_tokens=False).ids
        return self._ranked.encode_single_piece(pre_token.encode("utf-8"))

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """Stretches of ordinary text, and the special ids between them."""
        if not any(s in text for s in self.special):
            return [text], []
        return self._split.split(text), [self.special[s] for s in self._split.findall(text)]


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer a Python worker and file."""
    return ByteBpe(path)


class _NotByWord(Exception):
    """The text has white space next to a space, or an empty line."""


class WordCoder:
    """Folds a value per pre-token over whole texts: ``first`` (a broadcast tier) or else ``make`` gives the value.

    ``fold`` joins the values of many pre-tokens into one (``sum``, or a join of bytes).
    """

    def __init__(self, bpe: ByteBpe, make, fold, special, first: dict | None = None):
        self.bpe, self.fold, self.special = bpe, fold, special
        first = first or {}
        memo = Memo(make)
        self.value = lambda t: first[t] if t in first else memo[t]
        self.spaced = Memo(lambda word: self._word(" ", word))
        self.fed = Memo(lambda word: self._word("\n", word))

    def _word(self, before: str, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise _NotByWord
        return self.fold(map(self.value, pre_tokens(before + word)))

    def _plain(self, text: str):
        """The folded value of a text without special strings."""
        try:
            out = []
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if k:
                    out.append(self.fed[words[0]])
                elif not words[0] or words[0][0].isspace() or words[0][-1].isspace():
                    raise _NotByWord
                else:
                    out += map(self.value, pre_tokens(words[0]))
                del words[0]
                out.append(self.fold(map(self.spaced.__getitem__, words)))
            return self.fold(out)
        except _NotByWord:
            return self.fold(map(self.value, pre_tokens(text)))

    def __call__(self, text: str):
        parts, special = self.bpe.parts(text)
        if not special:
            return self._plain(text)
        out = [self._plain(parts[0])]
        for part, i in zip(parts[1:], special, strict=True):
            out += [self.special(i), self._plain(part)]
        return self.fold(out)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def byte_coder(path: str) -> WordCoder:
    """Text to its ids as little-endian unsigned 32-bit bytes, special strings becoming their ids."""
    bpe = byte_bpe(path)
    return WordCoder(bpe, lambda t: _packed(bpe.ids(t)), b"".join, lambda i: _packed([i]))


def length_coder(path: str, frequent: dict[str, int]) -> WordCoder:
    """Text to its number of tokens."""
    bpe = byte_bpe(path)
    return WordCoder(bpe, lambda t: len(bpe.ids(t)), sum, lambda i: 1, frequent)


def frequent_lengths(path: str) -> dict[str, int]:
    """Token count of every pre-token that the vocabulary lists as a whole.

    A BPE vocabulary is itself a table of frequent strings, so its entries that
    are one pre-token are the first tier; its size is bounded by the vocabulary.
    Each entry's length comes from encoding it.
    """
    bpe = byte_bpe(path)
    table = {}
    for i in range(bpe.tokenizer.get_vocab_size(with_added_tokens=False)):
        s = bpe.tokenizer.decode([i], skip_special_tokens=False)
        if s and "�" not in s and len(pre_tokens(s)) == 1:
            table[s] = len(bpe.ids(s))
    return table
