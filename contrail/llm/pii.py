"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes
and identifier cues. From each anchor a deterministic local parser walks to
the boundaries of the e-mail, address, card, phone or account and validates
it. Matches of a kind never overlap; a match that fails validation is dropped
and its characters are not tried again.

Added to the four base kinds: ``login`` (the user part of ``scheme://user@``
or ``scheme://user:secret@``), ``iban`` (checked modulo 97) and ``account``
(an identifier of 6 to 34 letters, digits and hyphens with 4 digits at least,
right after a cue such as "account no:").

Defined results: null text counts as empty; rows keep their doc_id (null
included) and repeat with the table; other columns are ignored (``find``) or
kept (``mask``).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.shared import Scratch, doc_columns, tidy
from contrail.llm.spans import ascii_lower, ordered, span_schema, span_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")

# Cues before an account identifier.
CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "member id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_LOGIN = re.compile(r"([A-Za-z0-9._~%!$&'*+,;=-]+)(?::[^\s@/]*)?@[A-Za-z0-9.-]+")
_AFTER_CUE = re.compile(r"(?: (?:no|number|nr)\.?)? ?[:=#]? ?([A-Za-z0-9][A-Za-z0-9-]{4,32}[A-Za-z0-9])(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.upper()
    if not (15 <= len(code) <= 34 and code.isalnum() and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def make_finder():
    """A function from a text to its unordered spans (kind, start, end)."""
    import ahocorasick

    anchors = ahocorasick.Automaton()
    for c in "0123456789":
        anchors.add_word(c, ("digit", 1))
    anchors.add_word("@", ("at", 1))
    anchors.add_word("+", ("plus", 1))
    anchors.add_word("://", ("scheme", 3))
    for cue in CUES:
        anchors.add_word(cue, ("cue", len(cue)))
    anchors.make_automaton()

    def find(text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
        run = 0                         # end of the digit run already looked at
        for last, (what, width) in anchors.iter(ascii_lower(text)):
            at = last - width + 1
            if what == "digit":
                if at < run:
                    continue
                run = _RUN.match(text, at).end()
                if at >= free["ip"] and (m := _IP.match(text, at)):
                    free["ip"] = m.end()
                    if all(map(_small, m.groups())):
                        out.append(("ip", at, m.end()))
                if run > free["card"] and (m := _CARD.match(text, max(at, free["card"]))):
                    free["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", m.start(), m.end()))
            elif what == "plus":
                if at >= free["phone"] and (m := _PHONE.match(text, at)):
                    free["phone"] = m.end()
                    if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                        out.append(("phone", at, m.end()))
            elif what == "at":
                start = at
                while start > free["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    free["email"] = m.end()
                    out.append(("email", start, m.end()))
            elif what == "scheme":
                if at and text[at - 1].isalnum() and (m := _LOGIN.match(text, last + 1)):
                    out.append(("login", m.start(1), m.end(1)))
            elif at == 0 or not text[at - 1].isalnum():
                if m := _AFTER_CUE.match(text, last + 1):
                    code = m[1]
                    if m.start(1) > last + 1 and sum(map(code.count, "0123456789")) >= 4:
                        kind = "iban" if iban(code) else "account"
                        out.append((kind, m.start(1), m.end(1)))
        return out

    return find


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per row."""
    Scratch(spark, "pii")
    return doc_columns(docs, "doc_id", "text").mapInArrow(
        span_table(make_finder, BASE, KINDS), span_schema(BASE))


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become
    one, named after the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(column: int):
    def task(batches):
        find = make_finder()
        for b in batches:
            masked = [mask_text(t, ordered(find(t), KINDS)) if t else t
                      for t in b.column(column).to_pylist()]
            cols = list(b.columns)
            cols[column] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return task


def mask_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by its
    kind in angle brackets; an ``n_chars`` column is counted anew."""
    Scratch(spark, "pii")
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    done = plain.mapInArrow(tidy(_mask(at)), plain.schema).toDF(*docs.columns)
    if docs.columns.count("n_chars") == 1:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                               .otherwise(F.length("text")).cast(kind))
    return done
