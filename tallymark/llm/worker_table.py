"""What a worker process keeps from task to task: the table of one operator at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: dict[tuple, Any] = {}


def worker_table(make: Callable, *args):
    """What ``make`` gave for these arguments in this process; what another call has left goes first.

    Spark reuses its Python processes for all stages of an application. Tables that each operator
    keeps for itself would add up in them.
    """
    key = (make, *args)
    if key not in _held:
        drop_table()
        _held[key] = make(*args)
    return _held[key]


def drop_table() -> None:
    """Nothing is kept any longer; called where an operator begins a task with tables of its own."""
    _held.clear()
