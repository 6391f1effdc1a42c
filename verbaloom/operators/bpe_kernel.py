"""Training of byte-pair encoding in one process, on arrays of symbols."""

from __future__ import annotations

import heapq

import numpy as np


def distinct(places: np.ndarray) -> np.ndarray:
    """In order; sorting is several times faster here than np.unique's table."""
    places = np.sort(places)
    return places[np.r_[True, places[1:] != places[:-1]]] if len(places) else places


def fitting(most: int) -> type:
    return np.int32 if most < 1 << 31 else np.int64


def sums(weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each group, in 64 bits."""
    return np.add.reduceat(weight, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)


class Symbols:
    """Symbols of all words in one array, linked to their neighbours within a word; in 32 bits wherever they fit."""

    def __init__(self, sym: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        """sym: ids of all symbols, word by word; sizes and counts: of each word."""
        self.sym, self.sizes, ends = sym.astype(np.int32), sizes, np.cumsum(sizes)
        counts = np.asarray(counts, np.int64)
        self.weight = np.repeat(counts.astype(fitting(int(counts.max(initial=0)))), sizes)
        wide = fitting(len(sym))
        self.before, self.after = np.arange(-1, len(sym) - 1, dtype=wide), np.arange(1, len(sym) + 1, dtype=wide)
        full = sizes > 0
        self.before[(ends - sizes)[full]] = -1
        self.after[ends[full] - 1] = -1

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Keys of the pairs that start there; keys order as (left id, right id)."""
        keys = self.sym[at].astype(np.int64)
        keys <<= 32
        keys |= self.sym[self.after[at]]
        return keys

    def linked(self) -> np.ndarray:
        """Where pairs start."""
        return np.flatnonzero(self.after >= 0).astype(self.after.dtype)

    def places(self, candidates: np.ndarray, key: int) -> np.ndarray:
        """Where the pair still stands, leftmost first without overlap."""
        at = distinct(candidates)
        at = at[(self.sym[at] == key >> 32) & (self.after[at] >= 0)]
        at = at[self.sym[self.after[at]] == key & 0xFFFFFFFF]
        if key >> 32 == key & 0xFFFFFFFF and len(at):  # every second one of a run
            number = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != self.after[at[:-1]]], number, 0))
            at = at[(number - first) % 2 == 0]
        return at

    def merge(self, at: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merge the pairs at these places: pairs lost and gained by place, with weights."""
        second, left = self.after[at], self.before[at]
        lost = distinct(np.concatenate([left[left >= 0], at, second[self.after[second] >= 0]]))
        gone = self.pairs(lost)
        right = self.after[second]
        self.sym[at], self.sym[second], self.after[at] = new, -1, right
        self.before[right[right >= 0]] = at[right >= 0]
        left = self.before[at]
        gained = distinct(np.concatenate([left[left >= 0], at[right >= 0]]))
        return gone, self.weight[lost], gained, self.weight[gained]


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys, distinct keys, and where each begins in the order; equal keys stay as they were."""
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    wide, place = int((keys & 0xFFFFFFFF).max()).bit_length(), len(keys).bit_length()
    if int(keys.max() >> 32).bit_length() + wide + place < 64:  # key and place in one number, whose sort is the fastest
        packed = keys >> 32
        packed <<= wide
        packed |= keys & 0xFFFFFFFF
        packed <<= place
        packed |= np.arange(len(keys))
        packed.sort()
        order = (packed & ((1 << place) - 1)).astype(fitting(len(keys)))
        packed >>= place
        begin = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
        first = packed[begin]
        return order, first >> wide << 32 | first & ((1 << wide) - 1), begin
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order, ordered[begin], begin


def parts(at: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """at, cut where each group begins."""
    cuts = [*begin.tolist(), len(at)]
    return [at[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]


def numbered(words: list[str], alphabet: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the alphabet of all characters, and the length of each word."""
    points, known = np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.array([ord(c) for c in alphabet], np.uint32)
    place = np.zeros(int(known.max(initial=0)) + 1, np.int32)
    place[known] = np.arange(len(known))
    return place[points], np.fromiter(map(len, words), np.int64, len(words))


def train_kernel(words: list[str], counts: list[int], alphabet: list[str], merges: int) -> list[tuple[str, str]]:
    """Up to `merges` merges of words of text."""
    return train_symbols(Symbols(*numbered(words, alphabet), counts), list(alphabet), merges)


def train_symbols(state: Symbols, names: list[str], merges: int, last: tuple[int, int] | None = None) -> list[tuple[str, str]]:
    """Up to `merges` merges; only places of the merged pair are touched, all of them at once. names: of all ids so far.
    last (-count, key): ends before a merge that comes after this place, and after one whose token is known."""
    ids = {c: i for i, c in enumerate(names)}
    at = state.linked()
    order, keys, begin = groups(state.pairs(at))
    at = at[order]
    total = dict(zip(keys.tolist(), sums(state.weight[at], begin).tolist(), strict=True))
    where = {k: [x] for k, x in zip(keys.tolist(), parts(at, begin), strict=False)}
    del order, at
    heap = [(-n, k) for k, n in total.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str]] = []
    while heap and len(out) < merges:
        n, key = heapq.heappop(heap)
        now = total.get(key)
        if now != -n:
            if now:  # rarer than when it was noted
                heapq.heappush(heap, (-now, key))
            continue
        if last is not None and (n, key) > last:
            break
        left, right = names[key >> 32], names[key & 0xFFFFFFFF]
        out.append((left, right))
        new = ids.setdefault(left + right, len(names))
        if new == len(names):
            names.append(left + right)
        elif last is not None:
            break
        gone, lost, gained, weight = state.merge(state.places(np.concatenate(where.pop(key)), key), new)
        order, keys, begin = groups(gone)
        for k, c in zip(keys.tolist(), sums(lost[order], begin).tolist(), strict=True):
            now = total.get(k)
            if now is not None:
                if now > c:
                    total[k] = now - c
                else:
                    del total[k]
                    where.pop(k, None)
        order, keys, begin = groups(state.pairs(gained))
        change, ends, gained = sums(weight[order], begin), np.r_[begin[1:], len(gained)][: len(begin)], gained[order]
        if last is not None:  # a pair of a new symbol only becomes rarer from here
            may = change >= -last[0]
            keys, begin, ends, change = keys[may], begin[may], ends[may], change[may]
        for k, c, lo, hi in zip(keys.tolist(), change.tolist(), begin.tolist(), ends.tolist(), strict=True):
            total[k] = now = total.get(k, 0) + c
            heapq.heappush(heap, (-now, k))
            where.setdefault(k, []).append(gained[lo:hi].copy())
    return out


def apply_symbols(state: Symbols, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols after merges (left, right, new id), each once in its turn, and how many each word has."""
    wanted = np.unique(np.array([a << 32 | b for a, b, _ in merges], np.int64))
    where: dict[int, list[np.ndarray]] = {}

    def note(at: np.ndarray) -> None:
        keys = state.pairs(at)
        near = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        at, keys = at[wanted[near] == keys], keys[wanted[near] == keys]
        order, keys, begin = groups(keys)
        for k, x in zip(keys.tolist(), parts(at[order], begin), strict=False):
            where.setdefault(k, []).append(x)

    if merges:
        note(state.linked())
    for a, b, new in merges:
        found = where.pop(a << 32 | b, None)
        at = state.places(np.concatenate(found), a << 32 | b) if found else ()
        if len(at):
            note(state.merge(at, new)[2])
    words = np.repeat(np.arange(len(state.sizes)), state.sizes)
    live = state.sym >= 0
    return state.sym[live], np.bincount(words[live], minlength=len(state.sizes))
