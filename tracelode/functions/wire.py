"""Protocol-buffer wire format: fields in, fields out."""

from __future__ import annotations

from collections.abc import Iterator

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


class WireError(ValueError):
    """The bytes end early or hold what isn't expected."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number and where it ends."""
    value = shift = 0
    while shift < 70:
        if at >= len(data):
            raise WireError("a number ends early")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at
    raise WireError("a number is too long")


def fields(data: bytes, only_bytes: bool = False) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of each field. ``only_bytes``: other wire types are errors."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        field, wire = tag >> 3, tag & 7
        if wire == BYTES:
            n, at = varint(data, at)
            if at + n > len(data):
                raise WireError("a field ends early")
            yield field, wire, data[at : at + n]
            at += n
        elif only_bytes:
            raise WireError(f"wire type {wire}")
        elif wire == VARINT:
            value, at = varint(data, at)
            yield field, wire, value
        elif wire in (FIXED64, FIXED32):
            n = 8 if wire == FIXED64 else 4
            if at + n > len(data):
                raise WireError("a field ends early")
            yield field, wire, data[at : at + n]
            at += n
        else:
            raise WireError(f"wire type {wire}")


def number(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def field(n: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return number(n << 3 | BYTES) + number(len(data)) + data


def text(data: bytes) -> str:
    return data.decode("utf-8", "replace")
