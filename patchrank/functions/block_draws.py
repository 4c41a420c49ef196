"""The draws of ``draws`` for whole Arrow columns, inside a task: the same MD5 over the same text, many keys at a time."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from .draws import SPAN

_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCK = 8192  # keys hashed at a time: their words stay in a core's cache


def _mix(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """One block of MD5: ``words`` is 16 rows of 32-bit words."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, np.uint32(_SINES[i]), out=f), np.add(f, words[_WORD[turn](i)], out=f)
        by = _TURNS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - by), out=t), np.left_shift(f, np.uint32(by), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


class Keys:
    """A column of texts, ordered by length."""

    def __init__(self, column: pa.Array):
        held = column.cast(pa.large_binary())
        at = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
        size = np.diff(at)
        self.order = np.argsort(size, kind="stable")
        self.size, at = size[self.order], at[self.order]
        edges = [0, *(np.flatnonzero(np.diff(self.size)) + 1), len(size)]
        self.texts = [(i, j, data[at[i:j, None] + np.arange(self.size[i])]) for i, j in zip(edges, edges[1:]) if j > i]

    def draw(self, before: str, after: Sequence[str]) -> list[np.ndarray]:
        """``draws.draw(before, key, *after)`` of every key, for each text of ``after`` (all of one length)."""
        head, tails = np.frombuffer(f"{before}|".encode(), np.uint8), [np.frombuffer(f"|{x}".encode(), np.uint8) for x in after]
        blocks = (len(head) + self.size + len(tails[0]) + 8) // 64 + 1
        out = [np.empty(len(self.size), np.uint32) for _ in tails]
        low = 0
        while low < len(blocks):
            high = min(low + BLOCK, int(np.searchsorted(blocks, blocks[low], "right")))
            whole, ends = np.zeros((high - low, 64 * blocks[low]), np.uint8), []
            whole[:, :len(head)] = head
            for i, j, text in self.texts:
                i, j, first = max(i, low), min(j, high), i
                if i < j:
                    rows, end = whole[i - low:j - low], len(head) + text.shape[1]
                    rows[:, len(head):end] = text[i - first:j - first]
                    rows[:, end:end + len(tails[0])] = tails[0]
                    rows[:, end + len(tails[0])] = 128
                    rows[:, -8:] = np.frombuffer((8 * (end + len(tails[0]))).to_bytes(8, "little"), np.uint8)
                    ends.append((slice(i - low, j - low), end))
            words = np.ascontiguousarray(whole.view("<u4").T)
            for held, tail, former in zip(out, tails, [tails[0], *tails]):
                for x in np.flatnonzero(tail != former):  # the same block but for these bytes
                    for rows, end in ends:
                        words[(end + x) // 4, rows] ^= np.uint32(int(tail[x] ^ former[x]) << 8 * ((end + x) % 4))
                state = [np.full(high - low, x, np.uint32) for x in _START]
                for k in range(0, len(words), 16):
                    state = _mix(state, words[k:k + 16])
                held[self.order[low:high]] = state[0].byteswap()
            low = high
        return out

    def normals(self, seed: str, k: int) -> list[np.ndarray]:
        """``draws.normal(seed, key, j)`` of every key, for j below ``k``."""
        drawn = []
        for some in (range(min(k, 10)), *((j,) for j in range(10, k))):
            drawn += self.draw(seed, [f"{j}|{x}" for j in some for x in "uv"])
        drawn = [(x.astype(np.float64) + 0.5) / SPAN for x in drawn]
        return [np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v) for u, v in zip(drawn[::2], drawn[1::2])]


def random_slots(normals: Sequence[np.ndarray], scale: float, bias: Sequence[float]) -> list[np.ndarray]:
    """``nulls.random_slots`` from its normals: attention over the slots, normalised, as FLOAT."""
    logits = [z * scale + b for z, b in zip(normals, bias)]
    top = np.maximum.reduce(logits)
    parts = [np.exp(x - top) for x in logits]
    total = parts[0].copy()
    for x in parts[1:]:
        total += x
    return [(x / total).astype(np.float32).astype(np.float64) for x in parts]
