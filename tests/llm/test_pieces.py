"""New stretches go to the library many in one text, with the ids each has alone."""

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from public_tokenizers import path  # noqa: E402

from contrail.llm import piece_codec  # noqa: E402
from contrail.llm.chunks import cut_ids  # noqa: E402


def test_new_stretches_are_joined():
    with open(path("piece_bpe_32k.model"), "rb") as f:
        codec = piece_codec.Codec(f.read(), threads=1)
    plain, calls = codec._library, []
    codec._library = lambda texts: calls.append(len(texts)) or plain(texts)
    texts = ["one two  three\n\nfour", "日本語 ÿ🙂 " + " ".join(f"w{i}x" for i in range(500)), " x", "\n", "a▁b"]
    coded = codec.encode(texts)
    pieces = codec.pieces(texts)
    assert sum(calls) < len(set().union(*pieces)) / 50
    alone = [b"".join(np.array(i, "<u4").tobytes() for i in plain(p)) for p in pieces]
    assert coded == alone


def test_cut_ids():
    sizes = np.array([1, 2, 3, 0])
    assert cut_ids([0, 1, 2], sizes, [3, 3]) == [np.array([0, 1], "<u4").tobytes(), np.array([2], "<u4").tobytes()]
    assert cut_ids([0, 1, 2], sizes, [2, 4]) is None  # an id spans two pieces
    assert cut_ids([0, 3, 2], sizes, [1, 3]) is None  # unknown length
