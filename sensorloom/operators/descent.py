"""Full-batch gradient descent on the driver over sums that come from distributed passes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

CURVE_POINTS = 10


@dataclass(frozen=True)
class Step:
    """What one pass says of a parameter vector: its gradient, the loss it is judged by, and a row for the curve."""

    gradient: np.ndarray
    judged_loss: float
    shown: tuple[float, ...]


@dataclass
class Trace:
    """The way of one parameter vector. ``best`` is the earliest with the lowest judged loss; a NaN never is."""

    parameters: np.ndarray
    best: np.ndarray = field(init=False)
    best_epoch: int = 0
    best_loss: float = float("inf")
    curve: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.best = self.parameters

    def take(self, epoch: int, step: Step, rate: float, show: bool) -> None:
        if step.judged_loss < self.best_loss:
            self.best, self.best_epoch, self.best_loss = self.parameters, epoch, float(step.judged_loss)
        if show:
            self.curve.append((epoch, *map(float, step.shown)))
        self.parameters = self.parameters - rate * step.gradient


def descend(
    starts: Sequence[np.ndarray],
    measure: Callable[[list[np.ndarray]], Sequence[Step]],
    *,
    rate: float,
    epochs: int,
) -> list[Trace]:
    """Moves all vectors together, one pass of ``measure`` for each epoch and one for the last state.

    Curves show every tenth of the epochs and the last.
    """
    traces = [Trace(np.asarray(start, dtype=float)) for start in starts]
    shown = {*range(0, epochs + 1, max(1, epochs // CURVE_POINTS)), epochs}
    for epoch in range(epochs + 1):
        steps = measure([trace.parameters for trace in traces])
        for trace, step in zip(traces, steps, strict=True):
            trace.take(epoch, step, rate, epoch in shown)
    return traces
