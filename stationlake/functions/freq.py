"""Fixed durations such as "15min", "1h" or "1D" in seconds."""

from __future__ import annotations

import re

_UNITS = {"s": 1, "sec": 1, "t": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800}


def seconds(freq: str) -> int:
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+?)s?\s*", freq) or re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"{freq!r} is no fixed duration")
    return int(m[1] or 1) * _UNITS[m[2].lower()]
