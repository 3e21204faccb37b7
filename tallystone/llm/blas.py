"""Matrix products in the calling thread alone.

Numpy's library of linear algebra starts threads of its own, which spin while they wait for work. A task has one
core, so they only take time from other tasks: for the products of this package, two thirds more for no gain.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

#: What builds of the library add to the names of its C functions ("_64_" and "_" would be those of Fortran).
_SUFFIXES = ("64_", "")


@lru_cache(maxsize=1)
def _controls() -> tuple[tuple[object, object], ...]:
    """(get, set) functions of the number of threads of each such library that is loaded; none where unknown."""
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return ()
    out = []
    for path in sorted(paths):
        library = ctypes.CDLL(path)
        for prefix in ("scipy_openblas", "openblas"):
            for suffix in _SUFFIXES:
                get, put = getattr(library, f"{prefix}_get_num_threads{suffix}", None), getattr(library, f"{prefix}_set_num_threads{suffix}", None)
                if get and put:
                    out.append((get, put))
    return tuple(out)


@contextmanager
def one_thread() -> Iterator[None]:
    """Within it, products run in the calling thread."""
    import numpy  # noqa: F401  loads the library

    before = [get() for get, _ in _controls()]
    for _, put in _controls():
        put(1)
    try:
        yield
    finally:
        for (_, put), n in zip(_controls(), before, strict=True):
            put(n)
