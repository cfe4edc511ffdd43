"""Edit counts and alignments under a fixed order among equally cheap edits.

From the end backwards: a match or substitution first, then an insertion (an extra token of the
hypothesis), then a deletion.  Costs are filled by rows of hypothesis tokens in a band of diagonals,
which is widened until the cost found is no more than its half width: no cheaper path leaves it then.

Counts need no way back.  With the cost a cell carries the insertions of its preferred path, from which
substitutions and deletions follow; so two rows are held, and rows of many pairs are filled at once.
Alignments keep a byte for each cell's step, of a block of rows at a time: of the rows before it only every so many
are kept, and the block is filled again from there.  Common ends never reach the rows.

All of that is for long pairs.  Of others whole rows are numbers with a bit for each reference token, as in Hyyrö's form of
Myers's algorithm: some operations on whole numbers fill a row, and two numbers a row are kept for the way back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = "hits bigint, substitutions bigint, deletions bigint, insertions bigint"
ALIGNED = "array<struct<type:string,reference:string,hypothesis:string,reference_index:int,reference_position:int>>"
_STEP, _EXTRA, _MISSING = 0, 1, 2
#: No cost; the half width of the first band and the most that a length asks of it; cells filled at once; tokens of texts that a batch holds at once; cells whose steps are held, and up to which rows are numbers.
_FAR, _HALF, _ASKED, _CELLS, _TOKENS, _STEPS = 1 << 29, 24, 72, 1 << 16, 1 << 22, 1 << 25


def _numbers(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    index: dict[str, int] = {}
    return tuple(np.fromiter((index.setdefault(t, len(index)) for t in x), np.uint32, len(x)) for x in (a, b))


def _trimmed(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers for the tokens without the common ends, and how many tokens these have."""
    ref, hyp = _numbers(reference, hypothesis)
    short = min(len(ref), len(hyp))
    differ = np.flatnonzero(ref[:short] != hyp[:short])
    front = int(differ[0]) if len(differ) else short
    ref, hyp, short = ref[front:], hyp[front:], short - front
    differ = np.flatnonzero(ref[::-1][:short] != hyp[::-1][:short])
    back = int(differ[0]) if len(differ) else short
    return ref[: len(ref) - back], hyp[: len(hyp) - back], front + back


def _banded(refs: list[np.ndarray], hyps: list[np.ndarray], half: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, insertions) of each pair in the band of diagonals from -half to half."""
    n, m = np.array([len(h) for h in hyps]), np.array([len(r) for r in refs])
    count, width, rows = len(refs), 2 * half + 1, int(n.max())
    # A reference token stands ``half`` places further right, so that row i looks at a slice from i on.
    ref = np.full((count, rows + width), -1, np.int64)
    hyp = np.full((count, rows), -2, np.int64)
    for k, (r, h) in enumerate(zip(refs, hyps)):
        r = r[: rows + half]
        ref[k, half + 1 : half + 1 + len(r)] = r
        hyp[k, : len(h)] = h
    across = np.arange(width, dtype=np.int32)
    cost = np.full((count, width + 1), _FAR, np.int32)
    cost[:, half:width] = np.arange(half + 1)
    extra = np.zeros((count, width + 1), np.int32)
    out_cost, out_extra = np.empty(count, np.int64), np.empty(count, np.int64)
    ends = {int(x): np.flatnonzero(n == x) for x in np.unique(n)}
    for i in range(1, rows + 1):
        diagonal = cost[:, :-1] + (ref[:, i : i + width] != hyp[:, i - 1 : i])
        down = cost[:, 1:] + 1
        best = np.minimum(diagonal, down)
        best -= across
        np.minimum.accumulate(best, axis=1, out=best)
        best += across
        step = diagonal == best
        own = np.where(step, extra[:, :-1], extra[:, 1:] + 1)
        step |= down == best
        cost[:, :-1] = best
        if step.all():
            extra[:, :-1] = own
        else:
            extra[:, :-1] = np.take_along_axis(own, np.maximum.accumulate(np.where(step, across, 0), axis=1), 1)
        if (done := ends.get(i)) is not None:
            at = m[done] - i + half
            out_cost[done], out_extra[done] = cost[done, at], extra[done, at]
    return out_cost, out_extra


def _bits(ref: list[int], hyp: list[int]) -> tuple[list[int], list[int], int]:
    """For each hypothesis token the reference tokens (as bits) at which no match or substitution is cheapest, and those at which an insertion is; and the cost."""
    at: dict[int, int] = {}
    for k, x in enumerate(ref):
        at[x] = at.get(x, 0) | 1 << k
    whole = (1 << len(ref)) - 1
    full = whole << 1 | 1  # with the bit that a sum may carry into
    down, up = whole, 0  # where a cell costs one more than the one of the reference token before, and one less
    away, more = [], []
    for x in hyp:
        same = at.get(x, 0)
        flat = (((same & down) + down) ^ down) | same | up  # where a cell costs no more than its diagonal neighbour
        extra = up | (full ^ (flat | down))
        away.append(flat ^ same)
        more.append(extra)
        across = (extra << 1 | 1) & whole
        down, up = ((flat & down) << 1 | (full ^ (flat | across))) & whole, flat & across
    return away, more, len(hyp) + down.bit_count() - up.bit_count()


def _counted(ref: list[int], hyp: list[int]) -> tuple[int, int, int]:
    """(cost, insertions, deletions)."""
    away, more, cost = _bits(ref, hyp)
    i, j, extra = len(hyp) - 1, len(ref) - 1, 0
    while i >= 0 and j >= 0:
        if away[i] >> j & 1:
            if more[i] >> j & 1:
                i -= 1
                extra += 1
            else:
                j -= 1
        else:
            i -= 1
            j -= 1
    extra += i + 1
    return cost, extra, extra + len(ref) - len(hyp)


def counts_of(pairs: list[tuple[Sequence[str], Sequence[str]]]) -> list[tuple[int, int, int, int]]:
    """(hits, substitutions, deletions, insertions) of each pair of texts, by characters, or of lists, by items."""
    out: list = [None] * len(pairs)
    todo, same = {}, [0] * len(pairs)
    for k, (a, b) in enumerate(pairs):
        ref, hyp, same[k] = _trimmed(a, b)
        if not len(ref) or not len(hyp):
            out[k] = (same[k], 0, len(ref), len(hyp))
        elif len(ref) * len(hyp) <= _STEPS:
            cost, extra, gone = _counted(ref.tolist(), hyp.tolist())
            sub = cost - extra - gone
            out[k] = (same[k] + len(ref) - sub - gone, sub, gone, extra)
        else:
            todo[k] = (ref, hyp)
    half = _HALF
    while todo:
        fit = sorted((k for k, (r, h) in todo.items() if _first_half(len(r), len(h)) <= half), key=lambda k: len(todo[k][1]))
        at_once = max(1, _CELLS // (2 * half + 1))
        for lo in range(0, len(fit), at_once):
            some = fit[lo : lo + at_once]
            costs, extras = _banded([todo[k][0] for k in some], [todo[k][1] for k in some], half)
            for k, cost, extra in zip(some, costs.tolist(), extras.tolist()):
                ref, hyp = todo[k]
                if cost <= half or half >= max(len(ref), len(hyp)):
                    gone = extra + len(ref) - len(hyp)
                    sub = cost - extra - gone
                    out[k] = (same[k] + len(ref) - sub - gone, sub, gone, extra)
                    del todo[k]
        half *= 3
    return out


def counts(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of two texts by characters or of two lists by items."""
    return counts_of([(reference, hypothesis)])[0]


def _first_half(n: int, m: int) -> int:
    """A band in which most pairs of such lengths fit: an eighth of the length, within bounds, and all of the difference."""
    return max(_HALF, abs(n - m), min(max(n, m) // 8, _ASKED))


class _Rows:
    """The rows of one pair in a band; steps come by blocks, last rows first."""

    def __init__(self, ref: np.ndarray, hyp: np.ndarray, half: int):
        self.hyp, self.half, self.width = hyp, half, 2 * half + 1
        self.ref = np.full(len(hyp) + self.width, -1, np.int64)
        part = ref[: len(hyp) + half]
        self.ref[half + 1 : half + 1 + len(part)] = part
        self.across = np.arange(self.width, dtype=np.int32)
        n = len(hyp)
        self.block = n if n * self.width <= _STEPS else max(1, int(n**0.5))
        start = np.full(self.width + 1, _FAR, np.int32)
        start[half : self.width] = np.arange(half + 1)
        self.kept, self.steps = {0: start}, None
        row = start
        for lo in range(0, n, self.block):
            row = self._fill(lo, row, lo + self.block >= n)
            self.kept[lo + self.block] = row
        self.base = lo
        self.cost = int(row[len(ref) - n + half])

    def _fill(self, lo: int, row: np.ndarray, keep: bool) -> np.ndarray:
        rows = min(self.block, len(self.hyp) - lo)
        if keep:
            self.steps, self.base = np.empty((rows, self.width), np.uint8), lo
        now = row.copy()
        for x in range(rows):
            i = lo + x + 1
            diagonal = now[:-1] + (self.ref[i : i + self.width] != self.hyp[i - 1])
            down = now[1:] + 1
            best = np.minimum.accumulate(np.minimum(diagonal, down) - self.across) + self.across
            now[:-1] = best
            if keep:
                self.steps[x] = np.where(diagonal == best, _STEP, np.where(down == best, _EXTRA, _MISSING))
        return now

    def step(self, i: int, j: int) -> int:
        """The preferred step into a cell; rows must be asked for from the last on."""
        if i - 1 < self.base:
            lo = (i - 1) // self.block * self.block
            self._fill(lo, self.kept[lo], True)
        return self.steps[i - 1 - self.base, j - i + self.half]


def _filled(ref: np.ndarray, hyp: np.ndarray) -> _Rows:
    half, most = _first_half(len(ref), len(hyp)), max(len(ref), len(hyp))
    while True:
        rows = _Rows(ref, hyp, half)
        if rows.cost <= half or half >= most:
            return rows
        half = min(half * 3, most)


def places(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[list[int], list[int]]:
    """How many tokens of the hypothesis lie before and up to the step of each reference token; a deleted one has the same numbers."""
    ref, hyp = _numbers(reference, hypothesis)
    i, j = len(hyp), len(ref)
    before, after = [0] * j, [0] * j
    if short := min(i, j):
        differ = np.flatnonzero(ref[::-1][:short] != hyp[::-1][:short])
        back = int(differ[0]) if len(differ) else short
        before[j - back :], after[j - back :] = range(i - back, i), range(i - back + 1, i + 1)
        i, j = i - back, j - back
    if i and j and i * j <= _STEPS:
        away, more, _ = _bits(ref[:j].tolist(), hyp[:i].tolist())
        i, j = i - 1, j - 1
        while i >= 0 and j >= 0:
            if not away[i] >> j & 1:
                before[j], after[j] = i, i + 1
                i -= 1
                j -= 1
            elif more[i] >> j & 1:
                i -= 1
            else:
                before[j] = after[j] = i + 1
                j -= 1
    elif i and j:
        rows = _filled(ref[:j], hyp[:i])
        while i and j:
            step = rows.step(i, j)
            if step == _STEP:
                i, j = i - 1, j - 1
                before[j], after[j] = i, i + 1
            elif step == _EXTRA:
                i -= 1
            else:
                j -= 1
                before[j] = after[j] = i
    return before, after


def alignment(reference: Sequence[str], hypothesis: Sequence[str]) -> list[tuple[str, str, str, int | None, int]]:
    """(type, reference, hypothesis, reference_index, reference_position) for each edit, in order."""
    out, i = [], 0
    for j, (a, lo, hi) in enumerate(zip(reference, *places(reference, hypothesis))):
        out += [("insert", "", b, None, j) for b in hypothesis[i:lo]]
        if lo == hi:
            out.append(("delete", a, "", j, j))
        else:
            out.append(("equal" if a == hypothesis[lo] else "substitute", a, hypothesis[lo], j, j))
        i = hi
    return out + [("insert", "", b, None, len(reference)) for b in hypothesis[i:]]


def counts_by_batch(pairs: list[tuple[Sequence[str], Sequence[str]] | None]) -> list[tuple]:
    """:func:`counts_of`, some pairs at a time so that long texts don't pile up; NULLs for None."""
    out, some, held = [(None,) * 4] * len(pairs), [], 0
    for k, pair in enumerate([*pairs, None]):
        if pair is not None:
            some.append(k)
            held += len(pair[0]) + len(pair[1])
        if some and (held > _TOKENS or k == len(pairs)):
            for at, found in zip(some, counts_of([pairs[x] for x in some])):
                out[at] = found
            some, held = [], 0
    return out


def edit_counts(reference: Column, hypothesis: Column, words: bool = False) -> Column:
    """``struct<hits, substitutions, deletions, insertions>`` of processed texts, by characters or by words; NULL if a side is."""

    @F.pandas_udf(COUNTS)
    def run(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = counts_by_batch([None if a is None or b is None else (a.split(), b.split()) if words else (a, b) for a, b in zip(r, h)])
        return pd.DataFrame(out, columns=["hits", "substitutions", "deletions", "insertions"]).astype("Int64")

    return run(reference, hypothesis)


def edit_alignment(reference: Column, hypothesis: Column, words: bool = False) -> Column:
    """The edits as an array of structs."""
    names = ("type", "reference", "hypothesis", "reference_index", "reference_position")

    @F.pandas_udf(ALIGNED)
    def run(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([
            None if a is None or b is None else [dict(zip(names, x)) for x in (alignment(a.split(), b.split()) if words else alignment(a, b))]
            for a, b in zip(r, h)
        ])

    return run(reference, hypothesis)
