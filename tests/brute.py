"""Plain-Python answers for small inputs, found by following the definitions."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def chunk_numbers(times, max_gap):
    numbers, current = [], 0
    for i, t in enumerate(times):
        if i and t - times[i - 1] > max_gap:
            current += 1
        numbers.append(current)
    return numbers


def dive_labels(times, depths, cutoff, dive_depth, max_gap, min_points):
    """(chunk, dive chunk, dive number) per row, by painting spans onto rows."""
    chunks = chunk_numbers(times, max_gap)
    labels = [None] * len(times)
    for chunk in sorted(set(chunks)):
        rows = [i for i, c in enumerate(chunks) if c == chunk]
        known = [depths[i] for i in rows if depths[i] is not None]
        keep = bool(known) and max(known) >= dive_depth and len(rows) >= min_points
        painted = [None] * len(rows)
        if keep:
            under = [depths[i] is not None and depths[i] >= cutoff for i in rows]
            last = len(rows) - 1
            leaves = [0] if under[0] else []
            leaves += [i for i in range(last) if not under[i] and under[i + 1]]
            returns = [i + 1 for i in range(last) if under[i] and not under[i + 1]]
            returns += [last] if under[last] else []
            spans = [(a, b) for a, b in zip(leaves, returns) if b - a > min_points]
            for number, (a, b) in enumerate(spans, 1):
                for i in range(a, b + 1):
                    painted[i] = number
        for i, number in zip(rows, painted):
            labels[i] = (chunk, chunk if keep else None, number)
    return labels


def drift_flags(rows, max_step, min_steps):
    """0/1 per ``(time, lat)`` row in order."""
    flags = [0] * len(rows)
    fixes = [i for i, (_, lat) in enumerate(rows) if lat is not None]
    begin = 0
    while begin < len(fixes):
        end = begin
        while end + 1 < len(fixes) and abs(rows[fixes[end + 1]][0] - rows[fixes[end]][0]) <= max_step:
            end += 1
        if end - begin >= min_steps:
            for i in range(fixes[begin], fixes[end] + 1):
                flags[i] = 1
        begin = end + 1
    return flags


def metres(a, b):
    (_, lat1, lon1), (_, lat2, lon2) = a, b
    p, q = math.radians(lat1), math.radians(lat2)
    h = (
        math.sin((q - p) / 2) ** 2
        + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def rms_speeds(track):
    """RMS speed per ``(time, lat, lon)`` fix, None near the ends."""
    out = []
    for i in range(len(track)):
        if i < 2 or i + 2 >= len(track):
            out.append(None)
            continue
        if any(track[i][0] == track[i + j][0] for j in (-2, -1, 1, 2)):
            out.append(None)
            continue
        v = [metres(track[i], track[i + j]) / abs(track[i][0] - track[i + j][0]) for j in (-2, -1, 1, 2)]
        out.append(math.sqrt(sum(x * x for x in v) / 4))
    return out


def speed_filtered(track, vmax):
    """Positions of the fixes that stay."""
    alive = list(range(len(track)))
    while True:
        v = rms_speeds([track[i] for i in alive])
        drop, run = [], []
        for k in range(len(alive) + 1):
            if k < len(alive) and v[k] is not None and v[k] > vmax:
                run.append(k)
            elif run:
                drop.append(max(run, key=lambda j: (v[j], -j)))
                run = []
        if not drop:
            return alive
        alive = [a for k, a in enumerate(alive) if k not in drop]


def nearest(end, fixes):
    """Index of the fix closest to ``end``; the earlier one wins a tie."""
    if not fixes:
        return None
    return min(range(len(fixes)), key=lambda i: (abs(fixes[i] - end), fixes[i], i))
