"""Unsigned base-128 numbers, low group first, and byte strings that one counts."""

from __future__ import annotations


class Truncated(ValueError):
    """The bytes end inside a value."""


def put(n: int) -> bytes:
    if not 0 <= n < 1 << 64:
        raise ValueError("not an unsigned 64-bit number")
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get(data: bytes, at: int) -> tuple[int, int]:
    """The number at `at` and where it ends."""
    n = 0
    for k in range(10):
        if at + k >= len(data):
            raise Truncated
        b = data[at + k]
        n |= (b & 0x7F) << 7 * k
        if b < 0x80:
            if n >> 64:
                raise ValueError("the number has more than 64 bits")
            return n, at + k + 1
    raise ValueError("the number has more than 64 bits")


def put_bytes(x: bytes) -> bytes:
    return put(len(x)) + x


def get_bytes(data: bytes, at: int) -> tuple[bytes, int]:
    """The counted bytes at `at` and where they end. A count past the end is a truncation, whatever it asks for."""
    n, at = get(data, at)
    if n > len(data) - at:
        raise Truncated
    return data[at : at + n], at + n
