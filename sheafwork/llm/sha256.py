"""SHA-256 with states that can be kept: many messages of whole 64-byte blocks at a time.

``hashlib`` can copy a state, but not write it into a table.  Here a state is eight 32-bit words, so
the state a parent had before a child's digest can be stored and resumed in another task.  A digest as
hex text has 64 characters, which is one block: a state always ends on a block.

Arrays have the words first: states (8, n), blocks (16, n).
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(count: int) -> list[int]:
    found: list[int] = []
    value = 2
    while len(found) < count:
        if all(value % p for p in found):
            found.append(value)
        value += 1
    return found


def _cube_root(value: int) -> int:
    root = 1 << -(-value.bit_length() // 3)
    while True:
        better = (2 * root + value // (root * root)) // 3
        if better >= root:
            return root
        root = better


#: The first 32 bits of the fractional parts of square and cube roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)

_DIGIT = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_FOUR = np.arange(1 << 16)
#: Four hex digits as one word, for each value of 16 bits.
_HEX = (
    _DIGIT[_FOUR >> 12] << 24 | _DIGIT[_FOUR >> 8 & 15] << 16 | _DIGIT[_FOUR >> 4 & 15] << 8 | _DIGIT[_FOUR & 15]
).astype(np.uint32)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _schedule(block) -> list:
    """The 64 words of each block (16, n)."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        small = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
        large = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
        w.append(w[t - 16] + small + w[t - 7] + large)
    return w


def _rounds(state: np.ndarray, w) -> np.ndarray:
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + _ROUND[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return state + np.stack([a, b, c, d, e, f, g, h])


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n) each."""
    return _rounds(state, _schedule(block))


def hex_block(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the block (16, n) of their hex text."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    out[0::2], out[1::2] = _HEX[digest >> np.uint32(16)], _HEX[digest & np.uint32(0xFFFF)]
    return out


def fresh(count: int) -> np.ndarray:
    """The states of ``count`` empty messages."""
    return np.repeat(START[:, None], count, axis=1)


def _last_blocks(most: int) -> np.ndarray:
    """The words (64, most + 1) of the closing block of messages of 0, 1, ... blocks."""
    last = np.zeros((16, most + 1), np.uint32)
    last[0], last[15] = 1 << 31, np.arange(most + 1, dtype=np.uint32) * 512
    return np.stack(_schedule(last))


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests (8, n) of messages that had so many blocks."""
    blocks = np.asarray(blocks)
    return _rounds(state, _last_blocks(int(blocks.max(initial=0)))[:, blocks])


def from_bytes(packed) -> np.ndarray:
    """Digests or states (8, n) from their bytes, 32 each."""
    return np.ascontiguousarray(np.frombuffer(packed, ">u4").reshape(-1, 8).T).astype(np.uint32)


def to_bytes(words: np.ndarray) -> bytes:
    """The bytes of digests or states, one after another."""
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()
