"""Integer columns as compressed blobs: one row carries many entries, so that exchanges of small entries stay cheap."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, by differences for the first and in byte planes, compressed."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for i, c in enumerate(columns):
        c = c.astype(np.int64)
        c = np.diff(c, prepend=0) if i == 0 else c
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(raw: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(columns, 8, n)
    out = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]
    return [np.cumsum(out[0]), *out[1:]]


def packed_groups(*groups: tuple[np.ndarray, ...]) -> bytes:
    """Groups of integer columns, not negative and of one length within a group, in as many byte planes as a column's largest value needs,
    compressed together."""
    parts = []
    for columns in groups:
        parts.append(len(columns[0]).to_bytes(8, "little"))
        for c in columns:
            c = c.astype(np.int64)
            width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
            parts += [bytes([width]), *(((c >> (8 * i)) & 255).astype(np.uint8).tobytes() for i in range(width))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked_groups(raw: bytes, *columns: int) -> list[list[np.ndarray]]:
    """The groups again; ``columns`` of each."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for number in columns:
        n, at = int.from_bytes(raw[at : at + 8], "little"), at + 8
        own = []
        for _ in range(number):
            width, at = raw[at], at + 1
            c = np.zeros(n, np.int64)
            for i in range(width):
                c |= np.frombuffer(raw, dtype=np.uint8, count=n, offset=at).astype(np.int64) << (8 * i)
                at += n
            own.append(c)
        out.append(own)
    return out
