"""One BLAS thread in a task: several would only spin beside the other tasks of an executor."""

from __future__ import annotations

import ctypes
from functools import cache

import numpy as np  # noqa: F401  its library must be loaded to be found

_NAMES = ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_", "MKL_Set_Num_Threads")


@cache
def one_thread() -> bool:
    """Sets it for this process; false where no known library is loaded (then all stays as it is)."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "blas" in line or "mkl_rt" in line}
    except OSError:
        return False
    done = False
    for path in paths:
        try:
            lib = ctypes.CDLL(path)
        except OSError:
            continue
        for name in _NAMES:
            if hasattr(lib, name):
                getattr(lib, name)(1)
                done = True
    return done
