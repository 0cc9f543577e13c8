"""A posting codec: ascending row ids as gaps of variable length, in blocks with a skip table.

Parquet's own encodings make it unnecessary for tables; it is here for lists that travel as one value.
"""

from __future__ import annotations

from bisect import bisect_right

from .wire import number, varint

BLOCK = 128


def encode(ids: list[int]) -> bytes:
    """Number of ids; for each block its first id (as a gap) and length in bytes; then the blocks' gaps."""
    head, body, before = number(len(ids)), b"", 0
    for at in range(0, len(ids), BLOCK):
        own = ids[at : at + BLOCK]
        gaps = b"".join(number(b - a) for a, b in zip(own, own[1:], strict=False))
        head += number(own[0] - before) + number(len(gaps))
        body, before = body + gaps, own[0]
    return head + body


def _blocks(data: bytes) -> tuple[int, list[int], list[int]]:
    """Number of ids, first ids, and where the blocks begin."""
    n, at = varint(data, 0)
    firsts, sizes, before = [], [], 0
    for _ in range(-(-n // BLOCK)):
        gap, at = varint(data, at)
        size, at = varint(data, at)
        before += gap
        firsts.append(before)
        sizes.append(size)
    starts = [at]
    for size in sizes:
        starts.append(starts[-1] + size)
    return n, firsts, starts


def _block(data: bytes, first: int, at: int, end: int) -> list[int]:
    out = [first]
    while at < end:
        gap, at = varint(data, at)
        out.append(out[-1] + gap)
    return out


def decode(data: bytes) -> list[int]:
    _, firsts, starts = _blocks(data)
    return [x for k, first in enumerate(firsts) for x in _block(data, first, starts[k], starts[k + 1])]


def contains(data: bytes, ids: list[int]) -> list[bool]:
    """Of each id whether it is there; reads only the blocks that may hold one."""
    _, firsts, starts = _blocks(data)
    read: dict[int, set[int]] = {}
    out = []
    for x in ids:
        k = bisect_right(firsts, x) - 1
        if k >= 0 and k not in read:
            read[k] = set(_block(data, firsts[k], starts[k], starts[k + 1]))
        out.append(k >= 0 and x in read[k])
    return out
