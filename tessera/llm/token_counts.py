"""Token counts by the whole-token shortcut.

Offline, each string of a byte-level BPE vocabulary is encoded alone; those that give one token are proved whole. A text's
pre-tokens in that set count one each; only the others are merged, once for each distinct one a worker meets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the split pattern that byte-level BPE with use_regex applies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker remembers before it starts afresh, and characters of the longest such word: both bound its memory.
REMEMBERED, REMEMBERED_LENGTH = 1 << 20, 64


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WholeTokens:
    """Counts the tokens of texts as the tokenizers library would, for a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE; its texts can't be cut by the fixed pattern")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.letters = byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.pattern = regex.compile(PATTERN)
        self.whole = self._proved(spec["model"]["vocab"])
        self.known = set(map(chr, range(128)))  # characters that both regex engines class alike
        self.pieces = _Remembered(lambda piece: self._piece(" " + piece, piece))
        self.rest: dict[str, int] = {}

    def _proved(self, vocab: dict[str, int]) -> frozenset[str]:
        back = {v: k for k, v in self.letters.items()}
        whole = set()
        for token in vocab:
            if len(self.library.model.tokenize(token)) == 1:
                try:
                    whole.add(bytes(map(back.__getitem__, token)).decode())
                except (UnicodeDecodeError, KeyError):
                    pass  # no text by itself, so never a pre-token
        return frozenset(whole)

    def _merged(self, pre_token: str) -> int:
        n = self.rest.get(pre_token)
        if n is None:
            n = len(self.library.model.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))
            if len(pre_token) <= REMEMBERED_LENGTH:
                if len(self.rest) >= REMEMBERED:
                    self.rest.clear()
                self.rest[pre_token] = n
        return n

    def _cut(self, text: str) -> int:
        whole = self.whole
        return sum(1 if t in whole else self._merged(t) for t in self.pattern.findall(text))

    def _piece(self, text: str, piece: str) -> float:
        # A piece between two spaces counts alone only if no white space touches those.
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return float("nan")
        return self._cut(text)

    def _same_classes(self, text: str) -> bool:
        """Whether both regex engines class the text's characters alike: checked once for each character."""
        if text.isascii():
            return True
        for c in set(text) - self.known:
            probe = f"a{c}a1{c}1-{c}- {c} {c}{c}"
            ours = ["".join(map(self.letters.__getitem__, t.encode())) for t in self.pattern.findall(probe)]
            if ours != [t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(probe)]:
                return False
            self.known.add(c)
        return True

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = [text]
        for s in self.special:
            if s in text:
                if not self.plain:
                    return len(self.library.encode(text, add_special_tokens=False).ids)
                parts = [y for x in parts for y in x.split(s)]
        if not self._same_classes(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        total = len(parts) - 1
        for part in parts:
            first, *others = part.split(" ")
            n = sum(map(self.pieces.__getitem__, others)) + (self._cut(first) if not first[-1:].isspace() else float("nan")) if others else float("nan")
            total += self._cut(part) if n != n else int(n)
        return total


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


def token_count(text: Column, path: str) -> Column:
    """Tokens of each whole text as the library's file at `path` gives them, without added special tokens.

    Null and empty texts have 0. The file must be at that path on every worker.
    """

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = WholeTokens(path)
        for texts in batches:
            yield pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())

    counts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counts, "long")(text)
