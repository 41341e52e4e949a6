"""Word shingles as 64-bit numbers and SetSketch registers over them, in numpy for blocks of texts.

A register holds an exponentially spaced, truncated minimum: ``clip(floor(1 - log_b(h)), 0, q + 1)`` with h the
least of one exponential value per element. Registers of two sets merge by maximum and agree with a
probability that rises with the Jaccard similarity, so they can be banded; their orders give the joint likelihood
of the similarity.
"""

from __future__ import annotations

import numpy as np

from iotrail.llm.common import SPACES

REGISTERS, BASE, TOP = 252, 1.1, 254
RATE = 20.0
ROWS, BANDS = 6, 42

_rng = np.random.default_rng(20221)
_byte = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_step = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_back = np.uint64(pow(int(_step), -1, 1 << 64))
_a = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_b = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_space = np.zeros(256, bool)
_space[list(SPACES.encode())] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(n: int, step: np.uint64) -> np.ndarray:
    have = _powers.get(int(step))
    if have is None or len(have) < n:
        have = np.full(n + n // 2, step, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[int(step)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, and the number of the first word of each text, with the total at the end."""
    data = np.frombuffer(b"\n".join([*batch, b""]), np.uint8)
    blank = _space[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte[_lower[data]] * _power(len(data), _step), dtype=np.uint64)])
    words = mix((sums[ends] - sums[starts]) * _power(len(data), _back)[starts] + (ends - starts).astype(np.uint64))
    begin = np.cumsum([0, *(len(x) + 1 for x in batch)])
    return words, np.searchsorted(starts, begin)


def shingle_sets(batch: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of k words of each text; fewer words are one shingle; no words, none."""
    out: list[np.ndarray] = []
    start = size = 0
    for i, text in enumerate(batch):
        size += len(text)
        if size >= 1 << 18 or i + 1 == len(batch):
            out += _block(batch[start : i + 1], k)
            start, size = i + 1, 0
    return out


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + part)
    return total


def _block(batch: list[bytes], k: int) -> list[np.ndarray]:
    words, first = word_hashes(batch)
    whole = _chain([words[j : len(words) - k + 1 + j] for j in range(k)]) if len(words) >= k else words[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(_chain([words[j : j + 1] for j in range(a, b)]))
        else:
            out.append(words[:0])
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 512):
        np.minimum(least, (x[start : start + 512] * _a + _b).min(0), out=least)
    h = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


_grid = np.linspace(0, 1, 101)


def jaccard_likelihood(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """Similarity of the highest joint likelihood for each row pair of registers, given the set sizes."""
    greater, less = (first > second).sum(1), (first < second).sum(1)
    equal = first.shape[1] - greater - less
    u = (n_first / (n_first + n_second))[:, None]
    v = 1 - u
    j = np.minimum(_grid[None], np.minimum(u / v, v / u))
    tilt = (BASE - 1) / BASE
    p_greater = -np.log1p(-np.clip(u - v * j, 1e-12, 1) * tilt) / np.log(BASE)
    p_less = -np.log1p(-np.clip(v - u * j, 1e-12, 1) * tilt) / np.log(BASE)
    p_equal = np.clip(1 - p_greater - p_less, 1e-12, 1)
    value = greater[:, None] * np.log(p_greater) + less[:, None] * np.log(p_less) + equal[:, None] * np.log(p_equal)
    return np.take_along_axis(j, value.argmax(1)[:, None], 1)[:, 0]


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    rows = sketch[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)
