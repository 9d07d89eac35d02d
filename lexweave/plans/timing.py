"""Loggers below the package's own, and the time that an action takes."""

from __future__ import annotations

import functools
import inspect
import logging
import time
from contextlib import contextmanager


def logger(name: str = "") -> logging.Logger:
    return logging.getLogger("lexweave" + (f".{name}" if name else ""))


@contextmanager
def timed(name: str):
    """Logs the seconds that the block takes. Plans are lazy: only actions inside count."""
    began = time.perf_counter()
    try:
        yield
    finally:
        logger("time").info("%s took %.3f s", name, time.perf_counter() - began)


def timeit(fn):
    """:func:`timed` for each call of a function; a coroutine counts until it ends."""
    if inspect.iscoroutinefunction(fn):

        @functools.wraps(fn)
        async def wrapped(*args, **kw):
            with timed(fn.__qualname__):
                return await fn(*args, **kw)
    else:

        @functools.wraps(fn)
        def wrapped(*args, **kw):
            with timed(fn.__qualname__):
                return fn(*args, **kw)

    return wrapped
