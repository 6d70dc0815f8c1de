"""Similarity sketches for many sets at once: weighted (ProbMinHash) and plain (MinHash), and their bands.

Both take the elements of all sets as flat arrays sorted by set: ``sets`` numbers the set of each
element, ``hashes`` is its 64-bit hash. Equal registers of two sets have the probability that the
sets' similarity states, so bands of several registers collide for similar sets.
"""

from __future__ import annotations

import numpy as np

from .common import mix, unit

_STEP = np.uint64(0xD1342543DE82EF95)
_SALT = np.uint64(0xA0761D6478BD642F)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _register(h: np.ndarray, m: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)


def prob_minhash(sets: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets, ``m`` registers each: the chance that a register of two sets
    is equal is their probability Jaccard similarity, which does not depend on the weights' scale.

    Every element starts a Poisson process whose rate is its weight; its arrivals fall on registers
    at random, the earliest arrival in a register gives the register its element. An element's
    process stops early, at its first arrival later than the set's latest register.
    """
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    left = np.arange(len(sets))
    time = np.zeros(len(sets))
    rate = 1.0 / weights
    state = hashes.copy()
    while len(left):
        state = mix(state + _STEP)
        time = time - np.log(unit(state)) * rate
        at = sets[left] * m + _register(mix(state ^ _SALT), m)
        # the first arrivals of all elements come before the second of any are looked at, and so on
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = hashes[left[won]]
        last = first.reshape(n, m).max(axis=1)
        on = time < last[sets[left]]
        left, time, state, rate = left[on], time[on], state[on], rate[on]
    return who.reshape(n, m)


#: Rounds in which elements fall on registers; what is empty after them is filled register by register.
_ROUNDS = 10


def minhash(sets: np.ndarray, hashes: np.ndarray, n: int, m: int) -> np.ndarray:
    """MinHash of ``n`` plain sets, ``m`` registers each; elements may repeat.

    In every round each element falls on two registers at random with random values; a register keeps
    the least value of the first round that fills it. Sets whose registers are all full take no
    further part. Registers that stay empty (of sets with few elements) get the least of a hash of
    their own over the set.
    """
    out = np.full(n * m, _FULL)
    own, state = sets * m, hashes
    high, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    for turn in range(_ROUNDS):
        state = state ^ (state >> high)
        state *= _STEP
        state ^= state >> np.uint64(29)
        for at, factor in ((state >> high, _SALT), (state & low, _STEP)):
            at *= np.uint64(m)
            at >>= high
            at = at.view(np.int64) + own
            value = state * factor
            if turn:
                fresh = empty[at]
                at, value = at[fresh], value[fresh]
            np.minimum.at(out, at, value)
        empty = out == _FULL
        on = empty.reshape(n, m).any(axis=1)[own // m]
        if not on.any():
            return out.reshape(n, m)
        if not on.all():
            own, state = own[on], state[on]
    rows, registers = np.nonzero(empty.reshape(n, m))
    sets = own // m
    order = np.argsort(sets, kind="stable")
    sets, state = sets[order], state[order]
    starts, sizes = np.searchsorted(sets, np.arange(n)), np.bincount(sets, minlength=n)
    some = sizes[rows] > 0
    rows, registers = rows[some], registers[some]
    for part in range(0, len(rows), 1 << 16):
        r, j = rows[part : part + (1 << 16)], registers[part : part + (1 << 16)]
        first = np.concatenate(([0], np.cumsum(sizes[r])[:-1]))
        elements = np.arange(sizes[r].sum()) - np.repeat(first - starts[r], sizes[r])
        values = mix(state[elements] ^ np.repeat(mix(j.astype(np.uint64)), sizes[r]))
        out[r * m + j] = np.minimum.reduceat(values, first)
    return out.reshape(n, m)


def one_permutation(sets: np.ndarray, hashes: np.ndarray, n: int, m: int) -> np.ndarray:
    """MinHash of ``n`` large plain sets in one pass, ``m`` registers each. Sets are numbered and rise, their
    hashes are distinct and rise within each.

    Low bits of an element's hash choose its register, the whole hash decides which of a register's
    elements is the least. A register without elements copies one that is chosen by a hash of its place, the next
    choice if that one is empty too (optimal densification); of sets of m elements these are a third.
    """
    out = np.full(n * m, _FULL)
    low = np.uint64(20)
    at = hashes & np.uint64((1 << 20) - 1)
    at *= np.uint64(m)
    at >>= low
    at = at.view(np.int64) + sets * m
    out[at[::-1]] = hashes[::-1]  # of the elements of a register the first, the least, is written last
    open_at = np.flatnonzero(out == _FULL)
    rows, places = open_at // m, (open_at % m).astype(np.uint64)
    filled, turn = out.copy(), 0
    while len(open_at):
        donor = (mix(places + np.uint64(turn * m)) % np.uint64(m)).view(np.int64)
        value = filled[rows * m + donor]
        found = value != _FULL
        out[open_at[found]] = value[found]
        open_at, rows, places, turn = open_at[~found], rows[~found], places[~found], turn + 1
    return out.reshape(n, m)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` registers; bands of different place never share a hash by design."""
    n, m = registers.shape
    grouped = registers.reshape(n, m // rows, rows)
    out = mix(np.arange(m // rows, dtype=np.uint64) * _STEP)[None, :].repeat(n, axis=0)
    for j in range(rows):
        out = mix(out ^ grouped[:, :, j])
    return out.view(np.int64)
