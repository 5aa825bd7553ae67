"""Interval algebra on the driver: half-open (start, end) pairs of epoch millis, as the load ledger keeps them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from sparkmodel.plans.times import Cron, IntervalUnit, TimeLike, exclusive_end, from_millis, millis, to_datetime

Interval = tuple[int, int]


def merged(intervals: Iterable[Interval]) -> list[Interval]:
    """Sorted, with touching and overlapping ones joined."""
    out: list[Interval] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def removed(intervals: Iterable[Interval], gone: Interval) -> list[Interval]:
    """Without what lies in `gone`; an interval may be split."""
    lo, hi = gone
    out = []
    for start, end in intervals:
        out += [p for p in ((start, min(end, lo)), (max(start, hi), end)) if p[0] < p[1]]
    return out


def steps(start: int, end: int, unit: IntervalUnit) -> list[Interval]:
    """The unit's whole steps inside [start, end)."""
    out = []
    t = unit.ceil(from_millis(start))
    while (following := unit.add(t)) <= from_millis(end):
        out.append((millis(t), millis(following)))
        t = following
    return out


def bounds(start: TimeLike, end: TimeLike, unit: IntervalUnit, partials: bool = False, outward: bool = True, now: datetime | None = None) -> Interval:
    """A range in whole steps: an end that names a day lies inside, partial steps grow outward or are dropped."""
    low, high = to_datetime(start, now), exclusive_end(end, now)
    if low > high:
        raise ValueError("the start lies after the end")
    if outward:
        low, high = unit.floor(low), high if partials else unit.ceil(high)
    else:
        low, high = unit.ceil(low), high if partials else unit.floor(high)
    return millis(low), millis(max(low, high))


def missing(loaded: Iterable[Interval], start: int, end: int, unit: IntervalUnit, lookback: int = 0, until: int | None = None, partials: bool = False) -> list[Interval]:
    """Steps of the range that are not loaded. With lookback, also loaded ones up to so many steps before a missing one."""
    if until is not None:
        end = min(end, until)
    grid = steps(start, end, unit)
    last = grid[-1][1] if grid else millis(unit.floor(from_millis(start)))
    if partials and last < end:
        grid.append((last, end))
    have = merged(loaded)
    gone = [not any(a <= s and e <= b for a, b in have) for s, e in grid]
    again = [any(gone[i : i + lookback + 1]) for i in range(len(grid))]
    return [g for g, a in zip(grid, again, strict=True) if a]


def contiguous(intervals: Iterable[Interval]) -> list[Interval]:
    return merged(intervals)


def difference(a: Sequence[Interval], b: Iterable[Interval], uninterrupted: bool = False) -> list[Interval]:
    """Intervals of a that are not in b; uninterrupted: only those before the first that is."""
    taken, out = set(b), []
    for interval in a:
        if interval in taken:
            if uninterrupted:
                break
            continue
        out.append(interval)
    return out


def batches(intervals: Sequence[Interval], size: int | None) -> list[Interval]:
    """Contiguous runs of steps of at most `size` steps each, as ranges."""
    out: list[list[Interval]] = []
    for interval in sorted(intervals):
        if out and out[-1][-1][1] == interval[0] and (not size or len(out[-1]) < size):
            out[-1].append(interval)
        else:
            out.append([interval])
    return [(run[0][0], run[-1][1]) for run in out]


def ready(intervals: Sequence[Interval], signal: Callable[[list[Interval]], bool | list[Interval]]) -> list[Interval]:
    """The intervals that a signal lets through: it sees each contiguous run and answers yes, no, or which."""
    runs: list[list[Interval]] = []
    for interval in sorted(intervals):
        if runs and runs[-1][-1][1] == interval[0]:
            runs[-1].append(interval)
        else:
            runs.append([interval])
    out: list[Interval] = []
    for run in runs:
        answer = signal(run)
        out += run if answer is True else [] if answer is False else [i for i in run if i in set(answer)]
    return out


def first_start(explicit: TimeLike | None, parents: Iterable[int], cron: Cron, now: datetime) -> int:
    """Where a model's history starts: as declared, else its earliest parent's start, else the last scheduled time."""
    if explicit is not None:
        return millis(to_datetime(explicit, now))
    starts = list(parents)
    return min(starts) if starts else millis(cron.previous(cron.floor(now)))


def restated(own: Interval, unit: IntervalUnit, self_referencing: bool, now: datetime) -> Interval:
    """A restatement in a model's own steps; a model that reads its past is restated up to now."""
    low, high = unit.floor(from_millis(own[0])), unit.ceil(from_millis(own[1]))
    return millis(low), millis(unit.floor(now) if self_referencing else high)


def due_restatement(last: datetime | None, cron: Cron, now: datetime, loaded: Sequence[Interval], count: int | None, unit: IntervalUnit) -> Interval | None:
    """What a scheduled restatement takes out of the ledger: the last `count` steps (all without one), if it is due."""
    if not loaded or last is not None and cron.next(last) > now:
        return None
    end = max(e for _, e in loaded)
    if count is None:
        return min(s for s, _ in loaded), end
    return millis(unit.add(from_millis(end), -count)), end


def gaps(before: Iterable[Interval], after: Iterable[Interval]) -> list[Interval]:
    """What was loaded before and is not any more: an environment must not lose it."""
    left = merged(before)
    for interval in merged(after):
        left = removed(left, interval)
    return left
