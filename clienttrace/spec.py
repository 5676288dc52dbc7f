"""Column roles of an event table."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EventSpec:
    """Which source column plays which role.

    ``tie_break`` must, together with ``customer_id`` and ``time``, order the
    events of a client totally; without it, results that depend on order
    (trend, last events, sequences) would differ between runs.
    """

    customer_id: str
    time: str
    amount: str
    category: str | None = None
    code: str | None = None
    tie_break: tuple[str, ...] = ()
    extra: tuple[str, ...] = field(default=())

    def columns(self) -> list[str]:
        named = [self.customer_id, self.time, self.amount, self.category, self.code]
        return list(dict.fromkeys([c for c in named if c] + list(self.tie_break) + list(self.extra)))
