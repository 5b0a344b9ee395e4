"""The operator tree: immutable descriptions of windowed signals over one ordered series.

A view reads the output of its source view (Echo is the input itself) and has one value per input row, null until it
is ready. A view's clock ticks on rows where its source is ready; on other rows it keeps its last output. Windows count
ticks. Equal subtrees are evaluated once.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class View:
    """Base of all views."""

    def sources(self) -> tuple[View, ...]:
        """The views whose outputs on the same row this one reads."""
        return tuple(v for f in fields(self) if isinstance(v := getattr(self, f.name), View) and f.name != "smoother")

    def nodes(self) -> list[View]:
        """The distinct views of the tree, sources before their readers."""
        seen: dict[View, None] = {}

        def visit(view: View) -> None:
            if view not in seen:
                for s in view.sources():
                    visit(s)
                seen[view] = None

        visit(self)
        return list(seen)


def _window(view: View, least: int = 1) -> None:
    if isinstance(view.window, bool) or not isinstance(view.window, int) or view.window < least:
        raise ValueError(f"{type(view).__name__} needs a window of at least {least}, not {view.window!r}")


@dataclass(frozen=True)
class Echo(View):
    """The input value."""


@dataclass(frozen=True)
class Constant(View):
    """The same value on every row, ready before any input."""

    value: float


@dataclass(frozen=True)
class Binary(View):
    """Arithmetic of two views on the same row; ready when both are."""

    left: View
    right: View


@dataclass(frozen=True)
class Add(Binary):
    """left + right."""


@dataclass(frozen=True)
class Subtract(Binary):
    """left - right."""


@dataclass(frozen=True)
class Multiply(Binary):
    """left * right."""


@dataclass(frozen=True)
class Divide(Binary):
    """left / right; null where right is 0, an error in strict mode."""


@dataclass(frozen=True)
class Tanh(View):
    """Hyperbolic tangent."""

    source: View = Echo()


@dataclass(frozen=True)
class GTE(View):
    """Clamp from below: the source, but no less than clip."""

    clip: float
    source: View = Echo()


@dataclass(frozen=True)
class LTE(View):
    """Clamp from above: the source, but no more than clip."""

    clip: float
    source: View = Echo()


@dataclass(frozen=True)
class Drawdown(View):
    """The largest fall from a running peak so far, as a share of the peak; 0 before any input."""

    source: View = Echo()


@dataclass(frozen=True)
class LnReturn(View):
    """ln(x / previous x); null where the previous value is 0."""

    source: View = Echo()


@dataclass(frozen=True)
class WelfordRolling(View):
    """Population standard deviation (or mean, variance) of all values so far."""

    source: View = Echo()
    stat: str = "std"


@dataclass(frozen=True)
class Windowed(View):
    """A view with a window length."""

    window: int
    source: View = Echo()

    def __post_init__(self) -> None:
        _window(self)


@dataclass(frozen=True)
class Sma(Windowed):
    """Mean: of the window when it fills, then of one value more (window + 1)."""


@dataclass(frozen=True)
class Ema(Windowed):
    """Exponential mean of weight alpha / (1 + window), seeded anew whenever it is 0; ready after window ticks."""

    alpha: float = 2.0


@dataclass(frozen=True)
class Alma(Windowed):
    """Gaussian-weighted mean; each value keeps the weight of the place at which it came in."""

    sigma: float = 6.0
    offset: float = 0.85


@dataclass(frozen=True)
class Lag(Windowed):
    """The oldest value of the window: window - 1 ticks back."""


@dataclass(frozen=True)
class Min(Windowed):
    """Least of the window."""


@dataclass(frozen=True)
class Max(Windowed):
    """Greatest of the window."""


@dataclass(frozen=True)
class HLNormalizer(Windowed):
    """-1 to 1 between the lowest and highest; an extreme stays until the value that leaves reaches one."""


@dataclass(frozen=True)
class Cumulative(Windowed):
    """Sum of the window plus, for good, the first value."""


@dataclass(frozen=True)
class Roc(Windowed):
    """Change in percent since window ticks before (or the first); kept where that value is 0."""


@dataclass(frozen=True)
class WelfordOnline(Windowed):
    """Standard deviation (or mean, variance) by incremental steps whose removal divides by the full count."""

    stat: str = "std"


@dataclass(frozen=True)
class Vst(Windowed):
    """Value over WelfordOnline's deviation; the value itself where that is 0."""


@dataclass(frozen=True)
class Vsct(Windowed):
    """Value less WelfordOnline's mean, over its deviation; 0 where that is 0."""


@dataclass(frozen=True)
class BinaryEntropy(Windowed):
    """Entropy in bits of the share of values at or above 0."""


@dataclass(frozen=True)
class Rsi(Windowed):
    """Relative strength from plain sums of gains and losses; 100 without losses."""


@dataclass(frozen=True)
class MyRSI(Windowed):
    """(gains - losses) / (gains + losses); kept where both are 0."""


@dataclass(frozen=True)
class NoiseElimination(Windowed):
    """Rank correlation with time over pairs at least two apart, without the oldest value; ties count as falling."""


@dataclass(frozen=True)
class CorrelationTrend(Windowed):
    """Correlation of value and place, with the full window as count from the start; 0 where undefined."""


@dataclass(frozen=True)
class CenterOfGravity(Windowed):
    """Balance point of the window around its middle; 0 where the values sum to 0."""


@dataclass(frozen=True)
class CyberCycle(Windowed):
    """Two-pole high-pass cycle of a smoothed second difference; 0 until the window fills."""

    def __post_init__(self) -> None:
        _window(self, 3)


@dataclass(frozen=True)
class Smoothed(Windowed):
    """A view that hands a derived value to a view tree of its own (smoother, over Echo)."""

    smoother: View = Echo()


@dataclass(frozen=True)
class PolarizedFractalEfficiency(Smoothed):
    """Straight distance over path length, signed by the last change, smoothed."""

    def __post_init__(self) -> None:
        _window(self, 3)


@dataclass(frozen=True)
class EhlersFisher(Smoothed):
    """Fisher transform of the smoothed place between window low and high; 0 on a flat window."""

    def __post_init__(self) -> None:
        _window(self, 2)


@dataclass(frozen=True)
class LaguerreRSI(Windowed):
    """Relative strength between the stages of a four-stage Laguerre filter fed back from two ticks before."""


@dataclass(frozen=True)
class LaguerreFilter(View):
    """Weighted mean of a four-stage Laguerre filter."""

    gamma: float
    source: View = Echo()


@dataclass(frozen=True)
class SuperSmoother(Windowed):
    """Two-pole low-pass filter started from zero."""


@dataclass(frozen=True)
class RoofingFilter(Windowed):
    """Two-pole high-pass filter, then a SuperSmoother of length smooth."""

    smooth: int = 10

    def __post_init__(self) -> None:
        _window(self)
        if self.smooth < 1:
            raise ValueError("RoofingFilter needs a smooth of at least 1")


@dataclass(frozen=True)
class ReFlex(Windowed):
    """Sum of a filtered series' differences from a slope line, over their running deviation (unstable for windows 2 to 8:
    the filter grows without bound, and once it overflows outputs are NaN or stay as they were)."""

    def __post_init__(self) -> None:
        super().__post_init__()
        if 2 <= self.window <= 8:
            warnings.warn(f"ReFlex is unstable with a window of {self.window}", stacklevel=3)


@dataclass(frozen=True)
class TrendFlex(Windowed):
    """Sum of a filtered series' differences from its current value, over their running deviation."""


@dataclass(frozen=True)
class Custom(View):
    """A kernel of one's own: factory() returns an object with out and step(x), see operators.kernels.Kernel."""

    factory: Callable[[], Any]
    source: View = Echo()


@dataclass(frozen=True)
class Expression(View):
    """A column expression of one's own, same row only: function takes and returns a Column."""

    function: Callable[[Any], Any]
    source: View = Echo()
