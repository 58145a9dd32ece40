"""FNV-1a, which identifies schemas."""

from __future__ import annotations

OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(data: bytes, state: int = OFFSET) -> int:
    """64-bit FNV-1a; give the last result as ``state`` to go on."""
    for b in data:
        state = (state ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return state
