"""What a Python worker keeps between the tasks it runs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_kept: dict[Any, Any] = {}


def once_per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, made once in this process for ``key``; one object a kind stays."""
    kind = key[0]
    if kind not in _kept or _kept[kind][0] != key:
        _kept[kind] = (key, make())
    return _kept[kind][1]


def forget() -> None:
    """Lets go what other operators keep in this process: a worker goes on to the next stage with it."""
    _kept.clear()


class Recent:
    """A bounded store of two generations: what is in use moves to the young one.

    When the young generation has ``entries`` entries it becomes the old one and
    the old one goes, so at most ``2 * entries`` are held and frequent entries stay.
    """

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def missing(self, wanted: set, turn: bool = True) -> set:
        """Those not held; the others are in ``young`` afterwards. ``turn`` lets generations change first."""
        absent = wanted.difference(self.young)
        if turn and len(self.young) + len(absent) > self.entries:
            self.old, self.young = self.young, {}
            absent = set(wanted)
        old = self.old
        found = {x for x in absent if x in old}  # set.intersection() would walk the whole dict
        for x in found:
            self.young[x] = old[x]
        return absent - found
