"""Numbers as text, on the driver."""

from __future__ import annotations


def bytes_text(n: float) -> str:
    """1.5 KB, 2.0 MB, ... up to TB; below 1024 whole bytes."""
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        if n >= 1024**power:
            return f"{n / 1024**power:.1f} {unit}"
    return f"{int(n)} B"


def bytes_short(n: float) -> str:
    """GB, MB or B only."""
    for power, unit in ((3, "GB"), (2, "MB")):
        if n >= 1024**power:
            return f"{n / 1024**power:.1f} {unit}"
    return f"{int(n)} B"


def number_text(n: float) -> str:
    for power, unit in ((9, "B"), (6, "M"), (3, "K")):
        if n >= 10**power:
            return f"{n / 10**power:.1f}{unit}"
    return str(int(n))
