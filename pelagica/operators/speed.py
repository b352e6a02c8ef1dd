"""Speed filter on tracks (McConnell, Chambers and Fedak 1992)."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import EARTH_RADIUS_M, distance_m
from ..functions.time import seconds_between
from ..session import checkpointed
from .clean import union_by_name
from .slices import (
    DAY_S,
    SLICE,
    fill_from_neighbours,
    with_neighbours,
    with_slice,
)

# Fixed value: highest plausible speed of a bird, in metres per second.
VMAX_MS = 25.0
ORDER = ("datetime", "foid")
AROUND = ("before", "after", "before2", "after2")


def _rated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the root-mean-square speed and the place in the track.

    The speed is over the steps to the two fixes before and the two after, and
    NULL where a track has fewer on either side or a step takes no time.
    """
    near = with_neighbours(
        rows, ["lat", "lon"], keys, ORDER, reach=2, counts={"place": lambda prior, row: F.lit(True)}
    )

    def speed(other: Column) -> Column:
        metres = distance_m(F.col("lat"), F.col("lon"), other["lat"], other["lon"])
        seconds = F.abs(seconds_between(F.col("datetime"), other["datetime"]))
        return metres / F.nullif(seconds, F.lit(0.0))

    speeds = [speed(F.col(c)) for c in AROUND]
    squares = [v * v for v in speeds]
    total = squares[0] + squares[1] + squares[2] + squares[3]
    return near.withColumn("rms_speed", F.sqrt(total / 4.0)).drop(*AROUND)


def rms_speed(fixes: DataFrame, key: str = "uni_id", slice_s: int = DAY_S) -> DataFrame:
    """Add ``rms_speed`` (m/s) to every fix; the two at each end have none."""
    return _rated(with_slice(fixes, slice_s), [key]).drop(SLICE, "place")


def _near_peaks(rated: DataFrame, key: str, vmax: float, margin: int) -> DataFrame:
    """The stretches of track within ``margin`` fixes of one above the limit, numbered.

    Two more fixes on each side serve as neighbours; ``fixed`` marks them.
    """
    marked = rated.withColumn(
        "_over", F.when(F.col("rms_speed") > vmax, F.struct(*ORDER, "place"))
    )
    filled = fill_from_neighbours(marked, "_over", [key], ORDER, last="_last", following="_next")
    away = F.least(
        F.col("place") - F.col("_last")["place"], F.col("_next")["place"] - F.col("place")
    )
    kept = (
        filled.withColumn("_away", away)
        .filter(F.col("_away") <= margin + 2)
        .withColumn("fixed", F.col("_away") > margin)
        .drop("_over", "_last", "_next", "_away")
    )

    def starts(prior: Column, row: Column) -> Column:
        return prior.isNull() | (row["place"] - prior["place"] > 1)

    return with_neighbours(kept, ["place"], [key], ORDER, counts={"stretch": starts}).drop(
        "before", "after"
    )


class _Peaks:
    """A value per place, and the first greatest one between two places, as a tree of maxima."""

    def __init__(self, values: list[float]) -> None:
        self.size = 1 << max(1, len(values) - 1).bit_length()
        self.tree = [-1.0] * self.size + values + [-1.0] * (self.size - len(values))
        for at in range(self.size - 1, 0, -1):
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])

    def put(self, place: int, value: float) -> None:
        tree, at = self.tree, place + self.size
        tree[at] = value
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            best = left if left >= right else right
            if tree[at] == best:
                break
            tree[at] = best

    def first_greatest(self, lo: int, hi: int) -> int:
        """Place of the greatest value in ``[lo, hi)``, the first of equal ones."""
        tree, left, right = self.tree, [], []
        lo, hi = lo + self.size, hi + self.size
        while lo < hi:
            if lo & 1:
                left.append(lo)
                lo += 1
            if hi & 1:
                hi -= 1
                right.append(hi)
            lo, hi = lo >> 1, hi >> 1
        at = max(left + right[::-1], key=tree.__getitem__)  # the first of equal nodes
        while at < self.size:
            at = 2 * at if tree[2 * at] == tree[at] else 2 * at + 1
        return at - self.size


class _Stretch:
    """Fixes of one stretch as a linked list, with the squared speeds to the next and the one after.

    A removal unlinks a fix, measures the three steps across the gap and rates the four fixes around it.  Runs lie between
    neighbouring places of ``slow``, the sorted fixes not above the limit, so a run is found by
    bisection and its peak in the tree: no removal looks at the rest of the stretch.
    """

    def __init__(self, seconds: Sequence[float], lat: Sequence[float], lon: Sequence[float], fixed: Sequence[bool], vmax: float) -> None:
        n = len(seconds)
        self.seconds, self.fixed, self.vmax = seconds, fixed, vmax
        self.lat, self.lon = [math.radians(x) for x in lat], [math.radians(x) for x in lon]
        # a place of its own before the first and behind the last fix, which lead to themselves
        self.before, self.after = [*range(-1, n - 1), n - 1, -1], [*range(1, n + 1), n, 0]
        self.one, self.two = [math.nan] * (n + 2), [math.nan] * (n + 2)
        for i in range(n - 1):
            self.one[i] = self._square(i, i + 1)
        for i in range(n - 2):
            self.two[i] = self._square(i, i + 2)
        rated = [self._rate(i) for i in range(n)]
        self.slow = [-1, *(i for i, v in enumerate(rated) if not v > vmax), n]
        self.peaks = _Peaks([v if v > vmax else -1.0 for v in rated])

    def _square(self, a: int, b: int) -> float:
        n = len(self.seconds)
        if not (0 <= a < n and 0 <= b < n):
            return math.nan
        step = abs(self.seconds[b] - self.seconds[a])
        if not step:
            return math.nan
        h = math.sin((self.lat[b] - self.lat[a]) / 2) ** 2
        h += math.cos(self.lat[a]) * math.cos(self.lat[b]) * math.sin((self.lon[b] - self.lon[a]) / 2) ** 2
        return (2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h))) / step) ** 2

    def _rate(self, at: int) -> float:
        """Root-mean-square speed over the two steps to either side, NaN for fixed fixes and near an end."""
        if self.fixed[at]:
            return math.nan
        one, two, b1 = self.one, self.two, self.before[at]
        return math.sqrt((one[b1] + one[at] + two[self.before[b1]] + two[at]) / 4)

    def _update(self, at: int) -> None:
        speed, place = self._rate(at), bisect_left(self.slow, at)
        was_slow = self.slow[place] == at
        if speed > self.vmax:
            if was_slow:
                del self.slow[place]
            self.peaks.put(at, speed)
        elif not was_slow:
            self.slow.insert(place, at)
            self.peaks.put(at, -1.0)

    def first_peaks(self) -> list[int]:
        """The peak of every run."""
        return [self.peaks.first_greatest(a + 1, b) for a, b in zip(self.slow, self.slow[1:]) if b - a > 1]

    def touches(self, at: int) -> bool:
        """Whether one of the two fixes to either side is fixed."""
        b, a, n = self.before[at], self.after[at], len(self.seconds)
        return any(0 <= x < n and self.fixed[x] for x in (self.before[b], b, a, self.after[a]))

    def remove(self, gone: list[int]) -> list[int]:
        """Take out one fix of each run at once; the peaks of the runs that are left."""
        n, before, after = len(self.seconds), self.before, self.after
        for at in gone:
            after[before[at]], before[after[at]] = after[at], before[at]
            self.peaks.put(at, -1.0)
        near: set[int] = set()
        for at in gone:
            b1, a1 = before[at], after[at]
            b2, a2 = before[b1], after[a1]
            self.one[b1], self.two[b2], self.two[b1] = self._square(b1, a1), self._square(b2, a1), self._square(b1, a2)
            near.update((b2, b1, a1, a2))
        near = {at for at in near if 0 <= at < n}
        for at in near:
            self._update(at)
        # what is left of a run, or has newly become one, lies next to a gap
        beside = near.union(*((before[at], after[at]) for at in near))
        out, end = [], -1
        for at in sorted(x for x in beside if 0 <= x < n):
            place = bisect_left(self.slow, at)
            if at >= end and self.slow[place] != at:
                end = self.slow[place]
                out.append(self.peaks.first_greatest(self.slow[place - 1] + 1, end))
        return out


def settle(
    group: np.ndarray, seconds: np.ndarray, lat: np.ndarray, lon: np.ndarray, fixed: np.ndarray, vmax: float
) -> tuple[np.ndarray, np.ndarray]:
    """Rows removed from whole stretches (rows of a group follow one another), and the groups whose effects reach a fixed fix.

    In every round the fastest fix of each run above the limit goes, the first on a tie.  A round costs as many steps as it
    removes fixes, times the logarithm of the stretch, so a day of fixes a second above the limit takes seconds.
    """
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, dtype=int)
    removed: list[int] = []
    opened = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        stretch = _Stretch(*(x[lo:hi].tolist() for x in (seconds, lat, lon, fixed)), vmax)
        gone: list[int] = []
        peaks = stretch.first_peaks()
        while peaks:
            if any(map(stretch.touches, peaks)):
                opened.append(group[lo])
                gone = []
                break
            gone += peaks
            peaks = stretch.remove(peaks)
        removed += [lo + at for at in gone]
    return np.array(removed, dtype=np.int64), np.array(opened, dtype=group.dtype)


def _settle_stretches(stretches: DataFrame, key: str, vmax: float) -> DataFrame:
    """``key, ORDER, place, removed``: removed fixes, and (``removed`` false) those of stretches still open."""
    types = {f.name: f.dataType.simpleString() for f in stretches.schema}
    slim = stretches.select(
        key, "stretch", *ORDER, "place", "lat", "lon", "fixed", (F.unix_micros(ORDER[0]) / 1e6).alias("_s")
    )
    out = [key, *ORDER, "place", "removed"]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame.groupby([key, "stretch"], sort=False).ngroup().to_numpy()
        columns = [frame[c].to_numpy(dtype=float) for c in ("_s", "lat", "lon")]
        gone, opened = settle(group, *columns, frame["fixed"].to_numpy(dtype=bool), vmax)
        still = np.flatnonzero(np.isin(group, opened) & ~frame["fixed"].to_numpy(dtype=bool))
        return pd.concat([frame.iloc[gone].assign(removed=True), frame.iloc[still].assign(removed=False)])[out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch.iloc[-1]
            inside = (batch[key] == last[key]) & (batch["stretch"] == last["stretch"])
            ended = batch[~inside]
            if len(ended) or rest and (rest[-1].iloc[-1][[key, "stretch"]] != last[[key, "stretch"]]).any():
                yield work(pd.concat([*rest, ended]))
                rest = []
            rest.append(batch[inside])
        if rest:
            yield work(pd.concat(rest))

    grouped = slim.repartition(key, "stretch").sortWithinPartitions(key, "stretch", *ORDER)
    shape = ", ".join(f"{c} {types[c]}" for c in out[:-1]) + ", removed boolean"
    return grouped.mapInPandas(run, shape)


def speed_filter(
    fixes: DataFrame,
    vmax: float = VMAX_MS,
    key: str = "uni_id",
    slice_s: int = DAY_S,
    keep_removed: bool = False,
    rounds: int = 32,
) -> DataFrame:
    """Remove the peak of every run above ``vmax`` until no fix is above it.

    All fixes are rated once.  The stretches around fixes above the limit, a small part of the data, are then
    settled as a whole, many in one pass over numpy arrays, however many rounds that takes; a stretch is the unit of
    work, since its peaks go one after another.  ``2 * rounds`` fixes on each side belong to it.  A stretch whose
    removals reach that border is started anew with eight times as many, and so on; settled stretches are not touched again,
    so there are as many passes as the farthest effect needs powers of eight.  What passes from pass to pass is
    written to the shared checkpoint folder.

    With ``keep_removed`` all fixes come back with a ``mfilter`` label
    (``removed``, ``end_location`` for the two fixes at each end, else ``not``).
    """
    columns = fixes.columns
    rated = checkpointed(_rated(with_slice(fixes.select(key, *ORDER, "lat", "lon"), slice_s), [key]))
    margin, removed, opened = 2 * rounds, None, None
    while True:
        todo = rated if opened is None else rated.join(opened.select(key).distinct(), key, "left_semi")
        stretches = _near_peaks(todo, key, vmax, margin)
        if opened is not None:
            wanted = stretches.join(opened.select(key, "place"), [key, "place"], "left_semi").select(key, "stretch")
            stretches = checkpointed(stretches.join(wanted.distinct(), [key, "stretch"], "left_semi"))
            # a wider stretch starts from all its fixes, so it takes the place of settled ones inside it
            removed = removed.join(stretches.select(key, "place"), [key, "place"], "left_anti")
        outcome = checkpointed(_settle_stretches(stretches, key, vmax))
        now = outcome.filter("removed").drop("removed")
        removed = now if removed is None else checkpointed(union_by_name([removed, now]))
        opened = outcome.filter("not removed")
        if opened.isEmpty():
            break
        margin *= 8
    out = removed.select(key, *ORDER)
    if keep_removed:
        return _labelled(fixes, out, key, slice_s).select(*columns, "mfilter")
    return fixes.join(out, [key, *ORDER], "left_anti").select(*columns)


def _labelled(fixes: DataFrame, removed: DataFrame, key: str, slice_s: int) -> DataFrame:
    near = with_neighbours(with_slice(fixes, slice_s), [], [key], ORDER, reach=2)
    at_end = F.col("before2").isNull() | F.col("after2").isNull()
    marked = near.join(
        removed.withColumn("_gone", F.lit(True)), [key, "datetime", "foid"], "left"
    )
    label = F.when(F.col("_gone"), "removed").when(at_end, "end_location").otherwise("not")
    return marked.withColumn("mfilter", label)
