"""Edit distance over words, a column of the table at a time, and the best one-to-one mapping of a small table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Tables of up to so many cells are filled cell by cell.
SMALL = 4096
#: Words of more places than this have their bits kept.
FREQUENT = 64


def last_column(rows: Sequence, columns: Sequence) -> np.ndarray:
    """Distances of all prefixes of ``rows`` from the whole of ``columns``.

    A column of the table is two whole numbers whose bits say where it rises and falls by one from a row to the next; one step by
    additions and bit operations goes to the next column, so that memory is a bit a row.
    """
    m = len(rows)
    full = (1 << m) - 1
    where: dict = {}
    for i, w in enumerate(rows):
        where.setdefault(w, []).append(i)
    often = {w: _bits(at, m) for w, at in where.items() if len(at) > FREQUENT}  # no more than m / FREQUENT
    rise, fall = full, 0
    for w in columns:
        same = often[w] if w in often else sum(1 << i for i in where.get(w, ()))
        diagonal = ((((same & rise) + rise) ^ rise) | same | fall) & full
        across_up = (fall | ~(rise | diagonal)) & full
        across_down = rise & diagonal
        across_up = (across_up << 1) | 1
        rise = ((across_down << 1) | ~(diagonal | across_up)) & full
        fall = across_up & diagonal & full
    step = _flags(rise, m).astype(np.int64) - _flags(fall, m)
    return len(columns) + np.concatenate(([0], np.cumsum(step)))


def _bits(places: list[int], m: int) -> int:
    flags = np.zeros(m, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _flags(number: int, m: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes(m // 8 + 1, "little"), np.uint8), count=m, bitorder="little")


def _small(ref: Sequence, hyp: Sequence) -> tuple[int, int, int]:
    """(substituted, inserted, deleted) of a small table, the ones with the fewest substitutions among the least sums."""
    row = [(j, 0, j, 0) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        new = [(i, 0, 0, i)]
        for j, h in enumerate(hyp, 1):
            n, s, a, b = row[j - 1]
            best = (n, s, a, b) if r == h else (n + 1, s + 1, a, b)
            n, s, a, b = row[j]
            best = min(best, (n + 1, s, a, b + 1))
            n, s, a, b = new[j - 1]
            new.append(min(best, (n + 1, s, a + 1, b)))
        row = new
    return row[-1][1:]


def edits(ref: Sequence, hyp: Sequence) -> tuple[int, int, int]:
    """(substituted, inserted, deleted) words of an alignment with the fewest edits, in memory that grows with the sum of the lengths.

    What both begin and end with is set aside; of a larger table the words of ``hyp`` are halved, and the place where the reference is best
    cut for it is the least sum of distances from both sides.
    """
    first = 0
    while first < min(len(ref), len(hyp)) and ref[first] == hyp[first]:
        first += 1
    last = 0
    while last < min(len(ref), len(hyp)) - first and ref[-1 - last] == hyp[-1 - last]:
        last += 1
    ref, hyp = ref[first : len(ref) - last], hyp[first : len(hyp) - last]
    if not ref or not hyp:
        return 0, len(hyp), len(ref)
    if len(ref) * len(hyp) <= SMALL or len(hyp) == 1:
        return _small(ref, hyp)
    half = len(hyp) // 2
    cut = int(np.argmin(last_column(ref, hyp[:half]) + last_column(ref[::-1], hyp[half:][::-1])[::-1]))
    a, b = edits(ref[:cut], hyp[:half]), edits(ref[cut:], hyp[half:])
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def best_mapping(table: np.ndarray) -> int:
    """The most that a one-to-one mapping of rows to columns adds up to; some of either may stay alone (values aren't negative).

    Rows are added one by one, each along the cheapest path of exchanges under prices of rows and columns that keep all
    reduced costs from falling below nothing: the cube of the number of speakers.
    """
    gain = table if table.shape[0] <= table.shape[1] else table.T
    n, m = gain.shape
    cost = gain.max(initial=0) - gain.astype(np.int64)
    row_price, column_price = np.zeros(n, np.int64), np.zeros(m, np.int64)
    owner = np.full(m, -1)
    for r in range(n):
        least, back, done = np.full(m, np.iinfo(np.int64).max), np.full(m, -1), np.zeros(m, bool)
        row, column = r, -1
        tree_rows, tree_columns = [r], []
        while True:
            slack = cost[row] - row_price[row] - column_price
            better = ~done & (slack < least)
            least[better], back[better] = slack[better], column
            nearest = int(np.argmin(np.where(done, np.iinfo(np.int64).max, least)))
            step = least[nearest]
            row_price[tree_rows] += step
            column_price[tree_columns] -= step
            least[~done] -= step
            done[nearest], column = True, nearest
            if owner[nearest] < 0:
                break
            row = owner[nearest]
            tree_rows.append(row)
            tree_columns.append(nearest)
        while column >= 0:
            before = back[column]
            owner[column] = owner[before] if before >= 0 else r
            column = before
    used = np.flatnonzero(owner >= 0)
    return int(gain[owner[used], used].sum())
