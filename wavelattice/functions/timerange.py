"""Time ranges ``a..b``: nanoseconds, ``now``, or ``marker.start`` / ``marker.end``, each with an offset."""

from __future__ import annotations

import re
from collections.abc import Mapping

#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_END = re.compile(r"(?:(\d+)|(now)|([A-Za-z_]\w*)\.(start|end))(?:([+-])(\d+(?:\.\d+)?)(ns|us|ms|s|m|h))?")


def parse_range(text: str, now_ns: int, markers: Mapping[str, tuple[int, int]] | None = None) -> tuple[int, int]:
    ends = [x.strip() for x in text.split("..")]
    if len(ends) != 2:
        raise ValueError(f"not a range: {text!r}")
    out = []
    for end in ends:
        m = _END.fullmatch(end)
        if not m:
            raise ValueError(f"not a point in time: {end!r}")
        number, now, marker, side, sign, amount, unit = m.groups()
        if marker and marker not in (markers or {}):
            raise ValueError(f"unknown marker {marker!r}")
        base = int(number) if number else now_ns if now else markers[marker][side == "end"]
        out.append(base + (-1 if sign == "-" else 1) * (round(float(amount) * UNITS[unit]) if amount else 0))
    if out[0] < 0 or out[0] >= out[1]:
        raise ValueError("a range must begin before it ends")
    return out[0], out[1]
