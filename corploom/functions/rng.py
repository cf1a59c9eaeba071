"""xoshiro256** with a SplitMix64 seed: one by one in Python integers, or from any place on in numpy.

A step of the generator's 256 bits of state is linear, so 2^k steps are one 256 by 256 matrix of bits.
With their powers a task starts at its own place of the stream, and draws for thousands of such places
at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = (1 << 64) - 1


def _split_mix(state: int):
    while True:
        state = (state + 0x9E3779B97F4A7C15) & MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        yield z ^ (z >> 31)


def _rotate(x: int, k: int) -> int:
    return ((x << k) | (x >> (64 - k))) & MASK


class Rng:
    """A reproducible stream of 64-bit numbers."""

    def __init__(self, seed: int):
        self.seed = seed & MASK
        words = _split_mix(self.seed)
        self.s = [next(words) for _ in range(4)]

    def next(self) -> int:
        s = self.s
        out = (_rotate((s[1] * 5) & MASK, 7) * 9) & MASK
        t = (s[1] << 17) & MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = _rotate(s[3], 45)
        return out

    def fork(self, stream: int) -> Rng:
        """A generator of its own for a numbered stream; takes one number of this one."""
        return Rng(self.next() ^ (stream * 0x9E3779B97F4A7C15 & MASK))

    def below(self, n: int) -> int:
        """Uniform below n: the high half of a product, drawn again where the low half would favour some results."""
        if n <= 0:
            raise ValueError("below needs a positive bound")
        bound = (1 << 64) % n
        while True:
            wide = self.next() * n
            if (wide & MASK) >= bound:
                return wide >> 64

    def uniform(self) -> float:
        return (self.next() >> 11) / float(1 << 53)

    def permutation(self, n: int) -> list[int]:
        order = list(range(n))
        for i in range(n - 1, 0, -1):
            j = self.below(i + 1)
            order[i], order[j] = order[j], order[i]
        return order


# -- from any place on ----------------------------------------------------------------------------------

#: Draws that one lane makes one after the other.
LANE = 256


def state_of(rng: Rng) -> int:
    """The state as one number of 256 bits."""
    return sum(word << (64 * k) for k, word in enumerate(rng.s))


def _apply(columns: list[int], state: int) -> int:
    out = 0
    while state:
        low = state & -state
        out ^= columns[low.bit_length() - 1]
        state ^= low
    return out


@lru_cache(maxsize=None)
def _power(k: int) -> list[int]:
    """2^k steps: for each bit of the state, what becomes of it."""
    if k:
        half = _power(k - 1)
        return [_apply(half, column) for column in half]
    columns, rng = [], Rng(0)
    for bit in range(256):
        rng.s = [(1 << bit) >> (64 * w) & MASK for w in range(4)]
        rng.next()
        columns.append(state_of(rng))
    return columns


def jumped(state: int, steps: int) -> int:
    """The state after so many draws."""
    for k in range(steps.bit_length()):
        if steps >> k & 1:
            state = _apply(_power(k), state)
    return state


def raw_draws(state: int, count: int) -> np.ndarray:
    """The next ``count`` numbers of 64 bits, lanes of ``LANE`` of them side by side."""
    lanes, starts = -(-count // LANE), [state]
    stride = _power(LANE.bit_length() - 1)
    for _ in range(lanes - 1):
        starts.append(_apply(stride, starts[-1]))
    s = [np.array([x >> (64 * w) & MASK for x in starts], np.uint64) for w in range(4)]
    out, u = np.empty((lanes, LANE), np.uint64), np.uint64
    for k in range(LANE):
        five = s[1] * u(5)
        out[:, k] = ((five << u(7)) | (five >> u(57))) * u(9)
        t = s[1] << u(17)
        s[2] = s[2] ^ s[0]
        s[3] = s[3] ^ s[1]
        s[1] = s[1] ^ s[2]
        s[0] = s[0] ^ s[3]
        s[2] = s[2] ^ t
        s[3] = (s[3] << u(45)) | (s[3] >> u(19))
    return out.ravel()[:count]


def _products(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the products of numbers of 64 bits."""
    half, u = np.uint64(32), np.uint64(0xFFFFFFFF)
    xh, xl, nh, nl = x >> half, x & u, n >> half, n & u
    low, a, b = xl * nl, xh * nl, xl * nh
    middle = (low >> half) + (a & u) + (b & u)
    return xh * nh + (a >> half) + (b >> half) + (middle >> half), x * n


def draws_below(state: int, bounds: np.ndarray) -> tuple[np.ndarray, int]:
    """(``Rng.below`` of each bound in turn, how many numbers were drawn again)."""
    values, at, again = np.empty(len(bounds), np.uint64), 0, 0
    fair = (np.uint64(MASK) % bounds + np.uint64(1)) % bounds  # 2^64 modulo the bound
    raw = raw_draws(state, len(bounds))
    while at < len(bounds):
        high, low = _products(raw[: len(bounds) - at], bounds[at:])
        bad = np.flatnonzero(low < fair[at:])
        good = int(bad[0]) if len(bad) else len(high)
        values[at : at + good] = high[:good]
        at += good
        if at < len(bounds):
            # that number is passed over; all after it move up by one
            again += 1
            raw = np.concatenate([raw[good + 1 :], raw_draws(jumped(state, len(bounds) + again - 1), 1)])
    return values, again
