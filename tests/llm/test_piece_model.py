"""Reading a piece model: steps in proportion to its pieces, and what it refuses."""

import struct
import time

import pytest

from reelgrid.llm import pieces as pc


def test_reading_takes_no_comparison_of_all_pairs_of_scores():
    data = pc.model_bytes(None)
    start = time.process_time()
    model = pc.PieceModel(data, merges=False)
    assert time.process_time() - start < 5
    assert model.is_bpe and len(model.text) > 30_000


def made(pieces):
    def message(number, body):
        size, out = len(body), bytes([number << 3 | 2])
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return out + bytes([size]) + body

    parts = [message(1, message(1, text.encode()) + b"\x15" + struct.pack("<f", score))
             for text, score in pieces]
    return b"".join(parts) + message(2, b"\x18\x02")


def test_pieces_of_one_score():
    singles = [(c, -9.0) for c in "ab▁"]
    pc.PieceModel(made([*singles, ("▁▁", -1.0), ("▁▁▁", -1.0), ("ab", -2.0)]))
    with pytest.raises(ValueError, match="one score"):
        pc.PieceModel(made([*singles, ("ab", -2.0), ("ba", -2.0)]))
