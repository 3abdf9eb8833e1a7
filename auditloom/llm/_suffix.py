"""Suffix arrays, common prefixes and content anchors over byte buffers, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, n)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, from running minima of blocks of w, forwards and backwards."""
    n = len(values)
    blocks = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:n] = values
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchor_units(data: np.ndarray, offsets: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (text, start, count, place of the anchor, anchor hash, unit hash).

    A window is ``depth`` bytes of one text; its anchor is the k-byte string in it with the least hash (the first of equals). So
    equal windows have equal anchors, at the same place. A unit is a run of windows with one anchor; its hash covers
    all their bytes and the anchor's place.
    """
    w, n = depth - k + 1, len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < depth:
        return none
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=upto[1:])
    back = _powers(_INVERSE, n)
    grams = _mix((upto[k:] - upto[:-k]) * back[: n - k + 1])
    bits = np.uint64((1 << n.bit_length()) - 1)
    least = sliding_min((grams & ~bits) | np.arange(len(grams), dtype=np.uint64), w) & bits
    edge = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(offsets)
    long_ = np.flatnonzero(sizes >= depth)
    if not len(long_):
        return none
    edge[offsets[long_]] += 1
    edge[offsets[long_] + sizes[long_] - depth + 1] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
    start, last = np.flatnonzero(new), np.flatnonzero(ends)
    at = least[start].astype(np.int64)
    text = np.searchsorted(offsets, start, "right") - 1
    stop = last + depth
    unit = _mix((upto[stop] - upto[start]) * back[start] + np.uint64(_INVERSE) * ((at - start) * 1024 + (stop - start)).astype(np.uint64))
    return text, start - offsets[text], last - start + 1, at - start, grams[at], unit


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, zeros beyond the end, read as a little-endian number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement.

    Suffixes are first sorted by 8 bytes. Each round sorts the groups that are still tied by the rank of the suffix h further on,
    which doubles h; groups of one are settled and left alone.
    """
    n = len(data)
    first = _words(data).byteswap()
    order = np.argsort(first).astype(np.int32)
    value = first[order]
    begin = np.append(True, value[1:] != value[:-1])
    h = 8  # a suffix shorter than that is told from others by its end, in the first round
    heads = np.flatnonzero(begin)
    sizes = np.diff(np.append(heads, n))
    rank = np.zeros(n + 1, np.int32)  # from 1; the end of the data ranks 0
    rank[order] = np.repeat(heads + 1, sizes)
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(places):
        members = order[places]
        key = rank[members].astype(np.int64) << 32 | rank[np.minimum(members + h, n)]
        by = np.argsort(key)
        members, key = members[by], key[by]
        order[places] = members
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        rank[members] = np.repeat(places[heads] + 1, sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, stride: int = 64) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in order, up to ``depth`` plus ``stride``.

    Kasai's bound - the suffix one further on shares at most one byte less - is used between places a stride apart, halved
    until all places are done, so that most comparisons start where they end.
    """
    n = len(data)
    word = _words(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int32)
    most = depth + stride

    def extend(i: np.ndarray, length: np.ndarray) -> None:
        j = before[i]
        live = np.flatnonzero((j >= 0) & (length < most))
        out = np.where(j >= 0, length, 0)
        while len(live):
            a, b = i[live] + out[live], j[live] + out[live]
            inside = np.maximum(a, b) < n
            live, a, b = live[inside], a[inside], b[inside]
            differ = word[a] ^ word[b]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int32)
            out[live] += np.minimum(same, n - np.maximum(a, b))
            live = live[(same == 8) & (out[live] < most)]
        shared[i] = np.minimum(out, most)

    places = np.arange(0, n, stride, dtype=np.int32)
    extend(places, np.zeros(len(places), np.int32))
    while stride > 1:
        stride //= 2
        places = np.arange(stride, n, 2 * stride, dtype=np.int32)
        extend(places, np.maximum(0, shared[places - stride] - stride))
    return shared[order]


def window_classes(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A number for each window (``depth`` bytes from each of ``starts``), the same for equal windows only."""
    order = suffix_array(data)
    shared = common_prefixes(data, order, depth)
    number = np.empty(len(data), np.int32)
    number[order] = np.cumsum(shared < depth, dtype=np.int32)
    return number[starts]
