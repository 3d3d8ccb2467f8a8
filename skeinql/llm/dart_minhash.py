"""DartMinHash signatures of weighted sets, for many sets at a time.

Each element has a region as wide as its weight, over all ranks. Darts fall on the plane at hashed
places, with one dart for a unit of area on average; each dart belongs to one of k coordinates. A
signature keeps, for each coordinate, the dart of lowest rank in the set's regions, so two sets agree at
a coordinate with the probability of their weighted Jaccard similarity. Only darts below a rank that
depends on the total weight are thrown (k ln k + 2k of them on average); sets with a coordinate left
empty throw on to twice the rank.

A region is cut at the powers of two, [0,1), [1,2), [2,4) ..., and within a piece darts come one after
another by exponential gaps, all of them a function of the element, the piece and the dart's number.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15
_PIECE = 0xD1342543DE82EF95
_SECOND = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _step(constant: int, n: int) -> np.uint64:
    return np.uint64(constant * n & (1 << 64) - 1)


def _throw(of: np.ndarray, element: np.ndarray, weight: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, rank, dart) of all darts in the regions below each set's top rank; slot: set * k + coordinate."""
    slots, ranks, darts = [], [], []
    piece, low, high = 0, 0.0, 1.0
    at = np.flatnonzero(weight > 0)
    while len(at):
        seed = mix(element[at] + _step(_PIECE, piece + 1))
        width, own, rank, n = high - low, at, np.zeros(len(at)), 0
        while len(own):
            n += 1
            dart = mix(seed + _step(_GOLDEN, n))
            gap = ((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            rank = rank - np.log(gap) / width
            in_range = rank < top[of[own]]
            own, seed, rank, dart = own[in_range], seed[in_range], rank[in_range], dart[in_range]
            place = mix(dart ^ _SECOND)
            inside = low + width * ((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight[own]
            coordinate = ((place >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            slots.append(of[own[inside]] * k + coordinate[inside].astype(np.int64))
            ranks.append(rank[inside])
            darts.append(dart[inside])
        piece, low, high = piece + 1, high, high * 2
        at = at[weight[at] > low]
    return np.concatenate(slots or [np.empty(0, np.int64)]), np.concatenate(ranks or [np.empty(0)]), np.concatenate(darts or [np.empty(0, np.uint64)])


def signatures(of: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """sets x k darts (uint64). of: which set each (element, weight) is in; a set without weight has zeros."""
    out = np.zeros((sets, k), np.uint64)
    total = np.bincount(of, weight, sets)
    todo = total > 0
    top = np.where(todo, (k * np.log(k) + 2 * k) / np.where(todo, total, 1), 0.0)
    while todo.any():
        pick = todo[of]
        slot, rank, dart = _throw(of[pick], element[pick], weight[pick], top, k)
        order = np.argsort(rank)[::-1]
        found = np.zeros(sets * k, bool)
        found[slot] = True
        full = todo & found.reshape(sets, k).all(axis=1)
        sig = np.zeros(sets * k, np.uint64)
        sig[slot[order]] = dart[order]  # of one slot's darts the last written has the lowest rank
        out[full] = sig.reshape(sets, k)[full]
        todo &= ~full
        top *= 2
    return out
