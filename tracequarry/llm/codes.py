"""Texts of a batch as one array of code points, and rolling hashes over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: For a second hash that has nothing to do with the first.
BASE_2 = U64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Gear values of the first code points; others are computed.
_GEAR = mix(np.arange(1, 1 << 12, dtype=U64) * BASE)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points behind each other, and where each text starts (one more at the end)."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=start[1:])
    return np.frombuffer(raw, np.uint32), start


def parts(texts: list[str], overlap: int, limit: int = 1 << 21) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Portions of the texts with about `limit` characters each, as (which text, where in it, part). A longer text is cut into parts of which each repeats the last `overlap` characters of
    the one before, so that every stretch of overlap + 1 characters lies whole in one part: what a task holds at once does not depend on how long texts are."""
    which, where, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            p = t[at : at + limit + overlap] if at or len(t) > limit + overlap else t
            if held and size + len(p) > limit:
                yield which, where, held
                which, where, held, size = [], [], [], 0
            which.append(i)
            where.append(at)
            held.append(p)
            size += len(p)
            if at + len(p) >= len(t):
                break
            at += limit
    if held:
        yield which, where, held


def gear(points: np.ndarray) -> np.ndarray:
    """A random number for each code point."""
    if not len(points) or points.max() < len(_GEAR):
        return _GEAR[points]
    return np.where(points < len(_GEAR), _GEAR[np.minimum(points, len(_GEAR) - 1)], mix((points.astype(U64) + U64(1)) * BASE))


def gear_roll(values: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 8) + value at each place; with 64 bits it covers the last 8 places. The first 7 are not whole."""
    h = values.copy()
    for n in (1, 2, 4):
        h[n:] = h[n:] + (h[:-n] << U64(8 * n)) if len(h) > n else h[n:]
    return h


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of values[i : i + width] for each i for which it is whole."""
    take = np.minimum if least else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = take(out[: len(out) - step], out[step:])
        have += step
    return out


class Prefix:
    """Hashes of any stretches of a value array in constant time each."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE):
        n = len(values)
        power = np.ones(n + 1, U64)
        np.cumprod(np.full(n, base, U64), out=power[1:])
        self.back = np.ones(n + 1, U64)
        np.cumprod(np.full(n, U64(pow(int(base), -1, 1 << 64)), U64), out=self.back[1:])
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], out=self.sum[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sum[b] - self.sum[a]) * self.back[a] + (b - a).astype(U64))
