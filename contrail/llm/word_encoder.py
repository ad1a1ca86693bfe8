"""Texts to ids with a ``tokenizers`` file, word by word where that is exact.

A file whose normaliser folds white space and case and whose pre-tokeniser
cuts words out of the text (``WORD_FORM``) encodes each word on its own. Texts
of plain characters are cut into words here, and each new word goes straight
to the file's BPE model, once per memo; all other texts, and all texts of
files of another form, go through the library's full encoder.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

from contrail.llm.chunks import PieceEncoder, packed

# The normaliser and pre-tokeniser for which words stand alone.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}

MEMO_WORDS = 400_000

# White space, and characters that normalising only lower-cases, one by one.
_PLAIN = re.compile("[\t\n\r\x0b\x0c -~¡-įı-˿]*")


def plain_words() -> re.Pattern:
    """``_WORDS`` over plain characters (its branches start with different
    characters, but for the apostrophe's)."""
    def of(kind: str) -> str:
        return "".join(re.escape(chr(i)) for i in range(0x300) if unicodedata.category(chr(i))[0] == kind)
    letters, numbers = of("L"), of("N")
    return re.compile(rf"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^\s{letters}{numbers}]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    table, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[b] = chr(b)
        else:
            table[b] = chr(extra)
            extra += 1
    return table


class TextEncoder:
    """Packed ids of UTF-8 texts, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self._full = Tokenizer.from_file(path)
        self._by_word = all(form[k] == v for k, v in WORD_FORM.items())
        if self._by_word:
            self._special = re.compile("|".join(re.escape(t["content"]) for t in form["added_tokens"]) or r"(?!)")
            self._cut = plain_words()
            self._letters = byte_letters()
            model = self._full.model
            self._words = PieceEncoder(lambda words: [
                packed([t.id for t in model.tokenize(self._bytes(w))]) for w in words],
                most=MEMO_WORDS)

    def _bytes(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in self._full.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        texts = [(t or b"").decode() for t in texts]
        if not self._by_word:
            return self._library(texts)
        plain = [_PLAIN.fullmatch(t) is not None and self._special.search(t) is None for t in texts]
        words = iter(self._words([self._cut.findall(t.lower()) for t, ok in zip(texts, plain) if ok]))
        other = iter(self._library([t for t, ok in zip(texts, plain) if not ok]))
        return [next(words) if ok else next(other) for ok in plain]


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """The worker's encoder; its memo serves one task after another."""
    return TextEncoder(path)
