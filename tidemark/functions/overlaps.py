"""Pairs of word sets that overlap by more than a share of the smaller set, inside the rows of one task (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAP_BITS, CHUNK = 512, 1 << 16  # bits of a set's map of words; pairs and words looked at together


def _parts(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (begin, end) of neighbouring items whose counts add up to CHUNK at most, single items aside."""
    upto, begin = np.cumsum(counts), 0
    while begin < len(counts):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
        yield begin, end
        begin = end


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, .. of every item, `counts` of them each."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def overlapping(words: pa.ListArray, same: np.ndarray, side: np.ndarray, order: np.ndarray, share: float, cross: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of `words` (sets without repeats, none empty) of which more than `share` of the smaller one's words are common, in
    runs that do not grow with the rows. With `cross` the rows of a pair come from both sides (0 and 1), else from one. Rows with equal
    `same` are no pair. Of two sets of one size the one with the lower `order` is looked up in the other.

    Words are ordered by how many rows hold them. Of the smaller set so many of the rarest are looked up in the postings of the
    sets after it that a pair with enough in common must meet. What meets has to have room for the words that are missing: behind the
    word where it meets, and by the bits of the smaller set's map that the other lacks. The words of what remains are compared."""
    n = np.diff(words.offsets.to_numpy()).astype(np.int64)
    first = np.lexsort((order, n))
    coded = words.flatten().dictionary_encode()
    size, rows, codes = len(coded.dictionary), len(n), coded.indices.to_numpy()
    del coded
    rank = np.empty(size, np.int64)
    rank[np.argsort(np.bincount(codes, minlength=size), kind="stable")] = np.arange(size)
    held = np.repeat(np.argsort(first) * size, n)
    held += rank[codes]
    held.sort()  # by row, then from rare to common
    n, same, side = n[first], same[first], side[first]
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(rows, dtype=np.int32), n)
    word = (held - np.repeat(np.arange(rows) * size, n)).astype(np.int32)
    place = _spread(np.zeros_like(n), n).astype(np.int32)
    need = np.floor(n * share).astype(np.int64) + 1
    bits = np.zeros((rows, MAP_BITS), bool)
    bits[row, word % MAP_BITS] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)

    spot = (word.astype(np.int64) * 2 + side[row]) * rows + row
    post = np.argsort(spot).astype(np.int32)
    spot.sort()
    look = np.flatnonzero(place <= (n - need)[row]).astype(np.int32)
    goal = (word[look].astype(np.int64) * 2 + (1 - side[row[look]] if cross else side[row[look]])) * rows
    low = np.searchsorted(spot, goal + row[look], "right")
    count = np.searchsorted(spot, goal + rows) - low
    del spot, goal
    look, low, count = look[count > 0], low[count > 0], count[count > 0]

    def met(a: int, b: int) -> np.ndarray:
        """The pairs, as i * rows + j, of which lookups a to b leave room for enough common words."""
        mine, theirs = np.repeat(look[a:b], count[a:b]), post[_spread(low[a:b], count[a:b])]
        i, j = row[mine], row[theirs]
        ok = (np.minimum(n[i] - place[mine], n[j] - place[theirs]) >= need[i]) & (same[i] != same[j])
        i, j = i[ok], j[ok]
        ok = n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64) >= need[i]
        return np.unique(i[ok].astype(np.int64) * rows + j[ok])

    ends = np.append(np.flatnonzero(np.diff(row[look])) + 1, len(look))  # behind the lookups of a row: its pairs are found in one run
    begins = np.append(0, ends[:-1])
    for r, s in _parts(np.add.reduceat(count, begins) if len(look) else count):
        found = [met(begins[r] + a, begins[r] + b) for a, b in _parts(count[begins[r]:ends[s - 1]])]
        i, j = np.divmod(np.unique(np.concatenate(found)), rows)
        for a, b in _parts(n[i]):
            k = n[i[a:b]]
            want = np.repeat(j[a:b], k) * size + word[_spread(start[i[a:b]], k)]
            both = held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want
            hit = np.add.reduceat(both.astype(np.int64), np.cumsum(k) - k) / k > share
            yield first[i[a:b][hit]], first[j[a:b][hit]]
