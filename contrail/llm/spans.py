"""Span lists of a text: order, digest and counting columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa

from contrail.llm.shared import concat_batches


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """By start, then by the kinds' listed order, without repeats."""
    return sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def ascii_lower(text: str) -> str:
    """A lower-case copy in which every character keeps its place."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if c < "\x80" else c for c in text)


def span_table(make_finder, base: tuple[str, ...], kinds: tuple[str, ...]):
    """Task over (doc_id, text): per document the count of each base kind,
    the digest of the base spans and all spans. ``make_finder()`` gives a
    function from a text to its spans."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in base],
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches):
        find = make_finder()
        for b in batches:
            counts: list[list[int]] = [[] for _ in base]
            digests, lists = [], []
            for text in b.column(1).to_pylist():
                found = ordered(find(text), kinds) if text else []
                plain = [s for s in found if s[0] in base]
                for out, k in zip(counts, base):
                    out.append(sum(s[0] == k for s in plain))
                digests.append(hashlib.sha256(joined(plain).encode()).hexdigest())
                lists.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(digests, pa.string()), pa.array(lists, pa.string())], schema=schema)

    return lambda batches: concat_batches(rows(batches), schema, 4096)


def span_schema(base: tuple[str, ...]) -> str:
    return ", ".join(["doc_id long", *[f"n_{k} long" for k in base], "base_sha256 string",
                      "spans string"])
