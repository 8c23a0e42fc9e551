"""Times a call: some unmeasured rounds, then the middle one of the measured ones."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any


def median_of(call: Callable[[], Any], warmups: int = 1, samples: int = 1) -> tuple[float, Any]:
    """(milliseconds, result) of the middle sample (the upper of two)."""
    for _ in range(warmups):
        call()
    timed = []
    for _ in range(max(1, samples)):
        began = time.perf_counter()
        result = call()
        timed.append(((time.perf_counter() - began) * 1000, result))
    return sorted(timed, key=lambda x: x[0])[len(timed) // 2]
