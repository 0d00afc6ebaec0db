"""Text at the edges: file labels, unique names, escapes, assignments, ranges, checked numbers, distance ticks."""

from __future__ import annotations

import math
import os
import re

ESCAPES = {"n": "\n", "t": "\t", "\\": "\\"}
INT32, UINT32, FLOAT32 = (1 << 31) - 1, (1 << 32) - 1, 3.4028234663852886e38


def file_label(path: str) -> str:
    """A file's name without folder and last extension."""
    name = os.path.basename(path)
    stem, dot, _ = name.rpartition(".")
    return stem if dot and stem else name


def unique_labels(labels: list[str]) -> list[str]:
    """A label that has occurred gets _r1, _r2, ..."""
    seen: dict[str, int] = {}
    out = []
    for label in labels:
        n = seen.get(label, 0)
        seen[label] = n + 1
        out.append(f"{label}_r{n}" if n else label)
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\([nt\\])", lambda m: ESCAPES[m[1]], text)


def escape(text: str) -> str:
    """For one field of a tab-separated line."""
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def assignments(items: list[str], count: int) -> dict[int, str]:
    """'2=red' or '1-3=red' by place from 0; plain values are recycled over all places."""
    if items and not any("=" in i for i in items):
        return {i: items[i % len(items)] for i in range(count)}
    out = {}
    for item in items:
        places, sep, value = item.partition("=")
        if not sep:
            raise ValueError(f"{item!r}: give all values by place, or none")
        for i in places_of(places, count):
            out[i] = value
    return out


def places_of(text: str, count: int) -> list[int]:
    """Places from 0 of '1,3-5' counted from 1."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m:
            raise ValueError(f"{text!r} is no list of places")
        a, b = int(m[1]), int(m[2] or m[1])
        if not 1 <= a <= b <= count:
            raise ValueError(f"{part!r} is outside 1 to {count}")
        out += range(a - 1, b)
    return out


def recycled(values: list, count: int) -> list:
    if not values:
        raise ValueError("no values to repeat")
    return [values[i % len(values)] for i in range(count)]


def whole_number(text: str, low: int = 0, high: int = UINT32) -> int:
    if not re.fullmatch(r"\s*[-+]?\d+\s*", text) or not low <= int(text) <= high:
        raise ValueError(f"{text!r} must be a whole number from {low} to {high}")
    return int(text)


def real_number(text: str, low: float = -FLOAT32, high: float = FLOAT32, open_low: bool = False, open_high: bool = False) -> float:
    """A finite number within bounds; one too small to be told from 0 is refused."""
    try:
        value = float(text)
    except ValueError:
        raise ValueError(f"{text!r} is no number") from None
    if not math.isfinite(value) or value < low or value > high or open_low and value == low or open_high and value == high:
        raise ValueError(f"{text!r} is out of range")
    if value == 0 and re.search(r"[1-9]", text.lower().split("e")[0]):
        raise ValueError(f"{text!r} is too small")
    return value


def distance_unit(span: float) -> tuple[str, float]:
    """Unit for distances of a plot of so many bases."""
    return ("Mb", 1e6) if span >= 2e6 else ("kb", 1e3) if span >= 2e3 else ("bp", 1.0)


def distance_ticks(upstream: int, body: int, downstream: int, bin_size: int, names: tuple[str, str] = ("start", "end"), anchor: str = "anchor") -> list[tuple[float, str]]:
    """(bin, label) of the edges and the anchor, or both ends of a scaled body."""
    unit, by = distance_unit(max(upstream, downstream, 1))
    show = lambda n: f"{n / by:g} {unit}" if n else f"0 {unit}"
    out = [(0.0, "-" + show(upstream))] if upstream else []
    if body:
        out += [(upstream / bin_size, names[0]), ((upstream + body) / bin_size, names[1])]
    else:
        out.append((upstream / bin_size, anchor))
    if downstream:
        out.append(((upstream + body + downstream) / bin_size, show(downstream)))
    return out


def pseudo_log(value: float, scale: float) -> float:
    return math.asinh(value / (2 * scale))
