"""Secret scan: keyword prefilter, anchored expressions, checksums.

One Aho-Corasick pass over the lower-cased text finds keywords (names of
credentials, key prefixes and every hexadecimal trigram); only where one hits
is an anchored regular expression run on the text itself. Leftmost matches of
a kind do not overlap, and one that fails its length test still uses up its
characters.

Added to the three base kinds: ``checked``, tokens of the public form
``ghp_`` / ``npm_`` and the like whose last six characters are the base-62
CRC-32 of the 30 before them; the checksum must hold.

Defined results: null text counts as empty; every row gives one row, null
doc_ids and repeats included; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from contrail.llm.shared import Scratch, doc_columns
from contrail.llm.spans import ascii_lower, span_schema, span_table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "checked")

# Credential names, and prefixes of tokens with a checksum.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")

_ASSIGN = re.compile(
    r"(?:(?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_HEX_CHARS = frozenset("0123456789abcdef")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(data: str) -> str:
    """CRC-32 as six base-62 digits."""
    n, out = zlib.crc32(data.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def make_finder():
    """A function from a text to its unordered spans (kind, start, end)."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for name in NAMES:
        words.add_word(name, ("assign", len(name)))
    words.add_word("akia", ("access", 4))
    for prefix in PREFIXES:
        words.add_word(prefix, ("checked", len(prefix)))
    for gram in itertools.product("0123456789abcdef", repeat=3):
        words.add_word("".join(gram), ("hex", 3))
    words.make_automaton()

    def find(text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        free = dict.fromkeys(KINDS, 0)
        for last, (kind, width) in words.iter(ascii_lower(text)):
            at = last - width + 1
            if kind == "hex":
                # the run around the hit; the text's own case decides
                if at < free["hex"] or text[at] not in _HEX_CHARS:
                    continue
                start = at
                while start > free["hex"] and text[start - 1] in _HEX_CHARS:
                    start -= 1
                end = _HEX.match(text, at).end()
                free["hex"] = end
                if end - start >= 24:
                    out.append(("hex", start, end))
            elif at >= free[kind]:
                if kind == "assign" and (m := _ASSIGN.match(text, at)):
                    free[kind] = m.end()
                    if len(m[1]) >= 6:
                        out.append((kind, at, m.end()))
                elif kind == "access" and (m := _ACCESS.match(text, at)):
                    free[kind] = m.end()
                    if m.end() - at >= 20:
                        out.append((kind, at, m.end()))
                elif kind == "checked" and (m := _CHECKED.match(text, at)):
                    if (at == 0 or not text[at - 1].isalnum()) and base62_crc32(m[1]) == m[2]:
                        free[kind] = m.end()
                        out.append((kind, at, m.end()))
        return out

    return find


def find_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row."""
    Scratch(spark, "secrets")
    return doc_columns(docs, "doc_id", "text").mapInArrow(
        span_table(make_finder, BASE, KINDS), span_schema(BASE))
