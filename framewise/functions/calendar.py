"""The step of a series of times, and the times that follow it.

A rule is a number and a unit: ``us`` (microseconds), ``B`` (business days, Monday to Friday) or a kind of month step - ``MS``
(first day), ``ME`` (last day), ``BMS`` and ``BME`` (first and last business day), ``MD`` (the same day of the month). Quarters
are 3 months, years 12. Facts about neighbouring times can be put together from parts of a series.
"""

from __future__ import annotations

import re

import numpy as np

DAY_US = 86_400_000_000
FACTS = ("pairs", "gap_low", "gap_high", "months_low", "months_high", "day_low", "day_high", "time_low", "time_high",
         "all_MS", "all_ME", "all_BMS", "all_BME", "business")


def facts(t: np.ndarray, before: int | None = None) -> list[int]:
    """``FACTS`` of ascending times in microseconds; ``before`` is the time before the first."""
    if before is not None:
        t = np.append(before, t)
    if len(t) < 2:
        at = t.astype("M8[us]")
        gap, months, business = np.zeros(0, np.int64), np.zeros(0, np.int64), True
        days = at.astype("M8[D]")
    else:
        at = t.astype("M8[us]")
        days = at.astype("M8[D]")
        gap = np.diff(t)
        months = np.diff(at.astype("M8[M]").astype(np.int64))
        business = bool((np.busday_count(days[:-1], days[1:]) == 1).all() and np.is_busday(days).all())
    month = at.astype("M8[M]")
    begin, after = month.astype("M8[D]"), (month + 1).astype("M8[D]")
    dom, time = (days - begin).astype(np.int64), (at - days).astype(np.int64)
    low = lambda a: int(a.min()) if len(a) else 1 << 62
    high = lambda a: int(a.max()) if len(a) else -(1 << 62)
    every = [bool((days == d).all()) for d in (begin, after - 1, np.busday_offset(begin, 0, roll="forward"),
                                               np.busday_offset(after, -1, roll="forward"))]
    return [len(gap), low(gap), high(gap), low(months), high(months), low(dom), high(dom), low(time), high(time), *map(int, every), int(business)]


def merged(parts: list[list[int]]) -> list[int]:
    """The facts of a series from those of its parts."""
    how = {"pairs": sum} | {f: min for f in FACTS if f.endswith("_low") or f.startswith("all_") or f == "business"} | {
        f: max for f in FACTS if f.endswith("_high")}
    return [how[f]([int(p[i]) for p in parts]) for i, f in enumerate(FACTS)]


def rule(found: list[int]) -> str:
    """The step: months if every gap is the same number of months between like days, else the constant gap, else business
    days, else one day."""
    f = dict(zip(FACTS, found))
    like_time = f["time_low"] == f["time_high"]
    if f["pairs"] and like_time and f["months_low"] == f["months_high"] >= 1:
        kind = next((k for k in ("MS", "ME", "BMS", "BME") if f[f"all_{k}"]), "MD" if f["day_low"] == f["day_high"] else None)
        if kind:
            return f"{f['months_low']}{kind}"
    if f["pairs"] and f["gap_low"] == f["gap_high"] > 0:
        return f"{f['gap_low']}us"
    return "1B" if f["pairs"] and like_time and f["business"] else f"{DAY_US}us"


def following(step: str, last: int, n: int) -> np.ndarray:
    """The ``n`` times (microseconds) after ``last``."""
    k, unit = re.fullmatch(r"(\d+)(\w+)", step).groups()
    i = int(k) * np.arange(1, n + 1, dtype=np.int64)
    if unit == "us":
        return last + i
    at = np.array(last, np.int64).astype("M8[us]")
    day = at.astype("M8[D]")
    time = (at - day).astype(np.int64)
    if unit == "B":
        days = np.busday_offset(day, i, roll="backward")
    else:
        month = day.astype("M8[M]") + i
        begin, after = month.astype("M8[D]"), (month + 1).astype("M8[D]")
        days = {"MS": begin, "ME": after - 1, "BMS": np.busday_offset(begin, 0, roll="forward"),
                "BME": np.busday_offset(after, -1, roll="forward"),
                "MD": np.minimum(begin + (day - day.astype("M8[M]").astype("M8[D]")), after - 1)}[unit]
    return days.astype("M8[us]").astype(np.int64) + time
