"""Encoding texts piece by piece with a bounded memo of pieces.

When a tokenizer never joins characters across a boundary, encoding the
pieces between such boundaries and joining the ids equals encoding the whole
text; natural text repeats its pieces, so each is encoded once per memo.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np

MEMO_PIECES = 200_000  # pieces kept; beyond, only the current batch's stay
MEMO_SIZE = 48         # longer pieces are encoded each time


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def cut_ids(ids: list[int], sizes: np.ndarray, lengths: list[int]) -> list[bytes] | None:
    """The packed ids of the pieces that were encoded in one text: ``sizes``
    has each id's length (0: unknown), ``lengths`` the pieces'. None if the ids'
    lengths do not tell the pieces apart."""
    own = sizes[ids]
    ends, stops = np.cumsum(own), np.cumsum(lengths)
    if not len(ends) or not own.all() or ends[-1] != stops[-1]:
        return None
    last = np.searchsorted(ends, stops)
    if (ends[last] != stops).any():
        return None
    raw, at = packed(ids), ((last + 1) * 4).tolist()
    return [raw[a:z] for a, z in zip([0, *at], at)]


class PieceEncoder:
    """Packed ids of lists of pieces. ``encode_many`` gives the packed ids of
    pieces seen for the first time."""

    def __init__(self, encode_many: Callable[[list], list[bytes]], most: int = MEMO_PIECES):
        self._encode, self._most = encode_many, most
        self._memo: dict = {}

    def __call__(self, documents: list[list]) -> list[bytes]:
        memo = self._memo
        used = set().union(*documents)
        missing = list(used.difference(memo))
        if len(memo) + len(missing) > self._most:
            memo = self._memo = {p: memo[p] for p in used.intersection(memo)}
        if missing:
            memo.update(zip(missing, self._encode(missing)))
        out = [b"".join(map(memo.__getitem__, pieces)) for pieces in documents]
        for piece in missing:
            if len(piece) > MEMO_SIZE:
                del memo[piece]
        return out
