"""Edit distance of two sequences of integers, exact for any lengths: a band of diagonals that grows by one an edit, or bit vectors of a whole row."""

from __future__ import annotations

import numpy as np

#: Values that a slide along a diagonal compares at once, for all diagonals of the band.
SLIDE = 16
#: Rough costs, in microseconds, of a step of each way: what decides when the band gives up. They change no result.
ROW, WORD, WAVE, DIAGONAL = 1.0, 0.012, 40.0, 0.25


def codes(text: str) -> np.ndarray:
    """A text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_ids(*texts: list[str]) -> list[np.ndarray]:
    """Each list of words as integers, one for each distinct word of all of them."""
    known: dict[str, int] = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in texts]


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """How many values both begin with: looked for in parts that double."""
    n, at, k = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : min(n, at + k)] != b[at : min(n, at + k)]
        if differs.any():
            return at + int(np.argmax(differs))
        at, k = at + k, 2 * k
    return n


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """The least number of insertions, deletions and replacements that make b of a.

    What both begin or end with is left out. Then the band looks how far each diagonal gets with 0, 1, 2 ... edits, which takes time in proportion to the edits squared;
    where that becomes dearer than bit vectors over all rows, these take over.
    """
    k = common_prefix(a, b)
    a, b = a[k:], b[k:]
    k = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) > len(b):
        a, b = b, a
    if len(a) <= 1:
        return len(b) - int(len(a) and bool((b == a[0]).any()))
    # A step a value of the shorter, each over the longer's bits: what a step costs beside its bits is paid as few times as can be.
    rows = len(a) * (ROW + WORD * len(b) / 64)
    found = banded(a, b, rows)
    return by_rows(b, a) if found is None else found


def banded(a: np.ndarray, b: np.ndarray, most: float = float("inf")) -> int | None:
    """The edit distance by diagonals; None if it would take more than about most microseconds.

    far[k] is how many values of a the diagonal k - edits (b's place minus a's) has used up with so many edits. Each edit comes from a
    neighbour or the diagonal itself, then the diagonal slides on over equal values.
    """
    m, n = len(a), len(b)
    least = abs(n - m)
    if least * (WAVE + DIAGONAL * least) > most:
        return None
    # Different values end both sequences, so no slide runs over an end.
    values = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int64)
    pa, pb = np.concatenate([values[:m], np.full(SLIDE, -1)]), np.concatenate([values[m:], np.full(SLIDE, -2)])
    wa, wb = np.lib.stride_tricks.sliding_window_view(pa, SLIDE), np.lib.stride_tricks.sliding_window_view(pb, SLIDE)

    def slide(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i = i.copy()
        live = np.flatnonzero((i >= 0) & (i <= m) & (j >= 0) & (j <= n))
        while len(live):
            x, y = i[live], j[live]
            equal = wa[x] == wb[y]
            run = np.where(equal.all(axis=1), SLIDE, np.argmin(equal, axis=1))
            i[live] += run
            j[live] += run
            live = live[run == SLIDE]
            if 0 < len(live) <= 4:  # a few long slides
                for t in live:
                    k = common_prefix(pa[i[t] : m], pb[j[t] : n])
                    i[t] += k
                    j[t] += k
                break
        return i

    goal, spent, edits = n - m, 0.0, 0
    none = -(m + n + 2)
    far = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))
    low = 0  # the least diagonal of far
    while not (low <= goal < low + len(far) and far[goal - low] >= m):
        edits += 1
        spent += WAVE + DIAGONAL * len(far)
        if spent > most:
            return None
        wide = np.full(len(far) + 2, none, np.int64)
        wide[1:-1] = far + 1  # replaced: one more of both
        np.maximum(wide[2:], far, out=wide[2:])  # one more of b
        np.maximum(wide[:-2], far + 1, out=wide[:-2])  # one more of a
        low -= 1
        diagonals = np.arange(low, low + len(wide))
        # No further than the ends: what lies beyond stays there, and helps nothing.
        wide = np.minimum(wide, np.minimum(m, n - diagonals))
        wide[(wide < 0) | (wide + diagonals < 0)] = none
        keep = slice(max(0, -m - low), len(wide) - max(0, low + len(wide) - 1 - n))
        low += keep.start
        wide, diagonals = wide[keep], diagonals[keep]
        far = slide(wide, wide + diagonals)
    return edits


#: Bits that the places of a block's values may take together, and the rows of a block where they would take more.
PLACES, BLOCK = 1 << 29, 1 << 14


def by_rows(a: np.ndarray, b: np.ndarray) -> int:
    """The edit distance by bit vectors: for each value of b, the column of differences along a as two integers of a bit a row.

    Where b has so many different values that their places in a would take too much memory, a's rows are done in blocks; each hands the differences along its last row to the next.
    """
    values, steps = b.tolist(), [1] * len(b)
    block = max(1, len(a)) if len(set(values)) * len(a) <= PLACES else BLOCK
    for at in range(0, len(a), block):
        steps = _block(a[at : at + block], values, steps)
    return len(a) + sum(steps)


#: Values that are looked for one by one.
FEW = 64


def _places(a: np.ndarray, wanted: list[int]) -> dict[int, int]:
    """The rows of each wanted value as bits."""
    def bits(rows: np.ndarray) -> int:
        return int.from_bytes(np.packbits(rows, bitorder="little").tobytes(), "little")

    if len(wanted) <= FEW:
        return {value: bits(a == value) for value in wanted}
    order = np.argsort(a, kind="stable")
    ordered, out = a[order], {}
    firsts, ends = (np.searchsorted(ordered, np.array(wanted, a.dtype), side).tolist() for side in ("left", "right"))
    for value, s, e in zip(wanted, firsts, ends, strict=True):
        if s < e:
            rows = order[s:e]
            there = np.zeros(int(rows[-1]) + 1, np.uint8)
            there[rows] = 1
            out[value] = bits(there)
    return out


def _block(a: np.ndarray, values: list[int], steps: list[int]) -> list[int]:
    """The differences along the last row of a, from those along the row before the first: -1, 0 or 1 for each value."""
    get, full, top = _places(a, list(set(values))).get, (1 << len(a)) - 1, len(a) - 1
    up, down = full, 0  # where a's next value costs one more, or one less
    out = []
    for value, step in zip(values, steps, strict=True):
        same = get(value, 0)
        kept = same | down
        if step < 0:
            same |= 1
        stay = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(stay | up)), stay & up
        out.append((more >> top & 1) - (less >> top & 1))
        more, less = more << 1 & full, less << 1 & full
        if step > 0:
            more |= 1
        elif step < 0:
            less |= 1
        up, down = less | (full & ~(kept | more)), more & kept
    return out
