"""Step-by-step evaluation of views: one small state per view and series, a value in, a value (or None) out.

The states are what a recursive view carries from row to row; those of windowed views hold at most a window. They
serve series of any length in one pass, and streams, whose state is the pickled kernel.
"""

from __future__ import annotations

import math
from collections import deque
from functools import reduce
from operator import add

from rillwave.operators import views as v


class Kernel:
    """out is the current output, None until ready; step() is called with each ready value of the source."""

    out: float | None = None

    def step(self, x: float) -> float | None:
        raise NotImplementedError

    def scan(self, values: list[float | None]) -> list[float | None]:
        result, step, out = [], self.step, self.out
        for x in values:
            if x is not None:
                out = step(x)
            result.append(out)
        self.out = out
        return result


def exact_sum(values) -> float:
    """The correctly rounded sum; where there is none (infinities of both signs, overflow), what plain addition gives."""
    try:
        return math.fsum(values)
    except (ValueError, OverflowError):
        return sum(values)


class Buffered(Kernel):
    def __init__(self, window: int):
        self.window = window
        self.values: deque[float] = deque()


#: A sum kept up by differences is renewed if it falls below this share of the value that leaves: what is left would be
#: little more than its rounding error.
CANCELLED = 1e-6


class Sliding:
    """The last values of a window and their sum: kept up by differences, renewed exactly once a window and after cancellation."""

    def __init__(self, window: int):
        self.window, self.values, self.total, self.others, self.age = window, deque(), 0.0, 0, 0

    def add(self, x: float) -> float:
        """Takes a value in and returns the sum, exactly 0 if all values are."""
        q, old = self.values, 0.0
        if len(q) >= self.window:
            old = q.popleft()
            self.total -= old
            self.others -= old != 0
        q.append(x)
        self.others += x != 0
        self.age += 1
        self.total += x
        if self.age >= self.window:
            self.total, self.age = exact_sum(q), 0
        elif not math.isfinite(self.total) or abs(self.total) < CANCELLED * abs(old):
            self.total = exact_sum(q)
        if not self.others:
            self.total = 0.0
        return self.total


#: Longest window whose mean is summed anew on each tick; DuckDB adds longer frames in an order of its own.
ANEW = 16


class Anew:
    """The last values of a window and their sum, added anew from the oldest on as SQL does: equal windows have equal sums."""

    def __init__(self, window: int):
        self.values: deque[float] = deque(maxlen=window)

    def add(self, x: float) -> float:
        self.values.append(x)
        return reduce(add, self.values, 0.0)


def two_sum(a, b):
    """a + b and its rounding error."""
    s = a + b
    c = s - a
    return s, (a - (s - c)) + (b - c)


def exact_parts(values) -> tuple[float, float]:
    """The correctly rounded sum and what it leaves out."""
    total = exact_sum(values)
    rest = exact_sum([*values, -total])
    return total, rest if math.isfinite(rest) else 0.0


class Carried:
    """As Sliding, with the rounding errors carried along: equal windows have equal sums, long ones too."""

    def __init__(self, window: int):
        self.window, self.values, self.total, self.rest, self.age = window, deque(), 0.0, 0.0, 0

    def add(self, x: float) -> float:
        q, old, total, rest = self.values, 0.0, self.total, self.rest
        if len(q) >= self.window:
            old = q.popleft()
            total, e = two_sum(total, -old)
            rest += e
        q.append(x)
        total, e = two_sum(total, x)
        rest += e
        out = total + rest
        self.age += 1
        if self.age >= self.window or not math.isfinite(out) or abs(out) < CANCELLED * abs(old):
            total, rest = exact_parts(q)
            out = total
            self.age %= self.window
        self.total, self.rest = total, rest
        return out


class GteKernel(Kernel):
    def __init__(self, clip):
        self.clip = clip

    def step(self, x):
        return x if x >= self.clip else self.clip


class LteKernel(Kernel):
    def __init__(self, clip):
        self.clip = clip

    def step(self, x):
        return x if x <= self.clip else self.clip


class DrawdownKernel(Kernel):
    out = 0.0

    def __init__(self):
        self.peak, self.worst = None, 0.0

    def step(self, x):
        if self.peak is None or x > self.peak:
            self.peak = x
        if self.peak:
            self.worst = max(self.worst, (self.peak - x) / self.peak)
        return self.worst


class LnReturnKernel(Kernel):
    def __init__(self):
        self.before = 0.0

    def step(self, x):
        before, self.before = self.before, x
        if before == 0:
            return None
        ratio = x / before
        return math.log(ratio) if ratio > 0 or math.isnan(ratio) else None


def _spread(stat: str, mean: float, variance: float) -> float:
    return mean if stat == "mean" else variance if stat == "variance" else math.sqrt(max(0.0, variance))


class WelfordRollingKernel(Kernel):
    def __init__(self, stat):
        self.stat, self.n, self.mean, self.m2 = stat, 0, 0.0, 0.0

    def step(self, x):
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)
        return _spread(self.stat, self.mean, self.m2 / self.n)


class SmaKernel(Kernel):
    def __init__(self, window):
        self.window, self.sum = window, (Anew if window <= ANEW else Carried)(window + 1)

    def step(self, x):
        total, n = self.sum.add(x), len(self.sum.values)
        return total / n if n >= self.window else None


class EmaKernel(Kernel):
    def __init__(self, window, alpha):
        self.window, self.weight, self.n, self.y = window, alpha / (1 + window), 0, 0.0

    def step(self, x):
        self.n += 1
        self.y = x if self.y == 0 else self.weight * x + (1 - self.weight) * self.y
        return self.y if self.n >= self.window else None


class AlmaKernel(Kernel):
    def __init__(self, window, sigma, offset):
        m, s = offset * (window + 1), window / sigma
        self.table = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(window)]
        self.weighted, self.weights = Sliding(window), Sliding(window)

    def step(self, x):
        weight = self.table[min(len(self.weights.values), len(self.table) - 1)]
        return self.weighted.add(x * weight) / self.weights.add(weight)


class LagKernel(Buffered):
    def step(self, x):
        q = self.values
        q.append(x)
        if len(q) > self.window:
            q.popleft()
        return q[0] if len(q) == self.window else None


class ExtremeKernel(Kernel):
    """The extreme of a sliding window, from a queue of candidates in falling (rising) order."""

    def __init__(self, window, sign):
        self.window, self.sign, self.t = window, sign, 0
        self.queue: deque[tuple[int, float]] = deque()

    def step(self, x):
        q, s = self.queue, self.sign
        self.t += 1
        while q and s * q[-1][1] <= s * x:
            q.pop()
        q.append((self.t, x))
        if q[0][0] <= self.t - self.window:
            q.popleft()
        return q[0][1]


class HLNormalizerKernel(Buffered):
    out = 0.0

    def __init__(self, window):
        super().__init__(window)
        self.low = self.high = None

    def step(self, x):
        q = self.values
        if self.low is None:
            self.low = self.high = x
        if len(q) >= self.window:
            oldest = q[0]
            if oldest <= self.low or oldest >= self.high:
                self.low, self.high = min(q), max(q)
            q.popleft()
        q.append(x)
        self.low, self.high = min(self.low, x), max(self.high, x)
        return 0.0 if self.low == self.high else 2 * (x - self.low) / (self.high - self.low) - 1


class CumulativeKernel(Kernel):
    first = None

    def __init__(self, window):
        self.sum = Sliding(window)

    def step(self, x):
        if self.first is None:
            self.first = x
        return self.sum.add(x) + self.first


class RocKernel(Buffered):
    def step(self, x):
        q = self.values
        q.append(x)
        if len(q) > self.window + 1:
            q.popleft()
        base = q[0]
        return self._keep(100 * ((x - base) / base) if base else None)

    held = None

    def _keep(self, value):
        if value is not None:
            self.held = value
        return self.held


class Welford:
    """The state shared by WelfordOnline, Vst and Vsct."""

    def __init__(self, window):
        self.window, self.n, self.mean, self.m2 = window, 0, 0.0, 0.0
        self.values: deque[float] = deque()

    def add(self, x):
        q = self.values
        if len(q) >= self.window:
            d = q.popleft() - self.mean
            mean = self.mean - d / self.n
            self.m2 -= d * (d + self.mean - mean)
            self.mean, self.n = mean, self.n - 1
        q.append(x)
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)

    @property
    def ready(self):
        return self.n >= self.window - 1

    @property
    def variance(self):
        return self.m2 / (self.n - 1) if self.n > 1 else 0.0

    @property
    def std(self):
        return math.sqrt(max(0.0, self.variance))


class WelfordOnlineKernel(Kernel):
    def __init__(self, window, stat):
        self.state, self.stat = Welford(window), stat
        self.out = 0.0 if window == 1 else None

    def step(self, x):
        s = self.state
        s.add(x)
        return _spread(self.stat, s.mean, s.variance) if s.ready else None


class VstKernel(Kernel):
    def __init__(self, window, centred):
        self.state, self.centred = Welford(window), centred
        self.out = 0.0 if window == 1 else None

    def step(self, x):
        s = self.state
        s.add(x)
        if not s.ready:
            return None
        std = s.std
        if self.centred:
            return (x - s.mean) / std if std else 0.0
        return x / std if std else x


class BinaryEntropyKernel(Kernel):
    def __init__(self, window):
        self.sum = Sliding(window)

    def step(self, x):
        p = self.sum.add(1.0 if x >= 0 else 0.0) / len(self.sum.values)
        return 0.0 if p in (0.0, 1.0) else -(p * math.log2(p) + (1 - p) * math.log2(1 - p))


class ChangesKernel(Kernel):
    """Sums of the gains and the losses of the window, of which the first change is 0."""

    before = None
    held = 0.0

    def __init__(self, window, percent):
        self.window, self.percent, self.n = window, percent, 0
        self.gains, self.losses = Sliding(window), Sliding(window)

    def step(self, x):
        change = 0.0 if self.before is None else x - self.before
        self.before = x
        self.n += 1
        up, down = self.gains.add(max(change, 0.0)), self.losses.add(max(-change, 0.0))
        if self.percent:
            value = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        else:
            if up + down:
                self.held = (up - down) / (up + down)
            value = self.held
        return value if self.n >= self.window else None


class NoiseEliminationKernel(Buffered):
    """Keeps the sum over pairs: a new value brings its pairs, a value that becomes the oldest takes its own."""

    total = 0

    def step(self, x):
        q = self.values
        if len(q) >= self.window:
            q.popleft()
            if len(q) > 2:
                oldest = q[0]
                self.total -= sum(1 if q[j] > oldest else -1 for j in range(2, len(q)))
        q.append(x)
        n = len(q)
        if n < 2:
            return None
        self.total += sum(1 if x > q[i] else -1 for i in range(1, n - 2))
        return self.total / (n * (n - 1) / 2)


class PlacesKernel(Buffered):
    """Trend correlation or centre of gravity, from sums over the window of values, squares and values by place.

    When the oldest leaves, every other place falls by one. The sums are renewed exactly once a window.
    """

    def __init__(self, window, trend):
        super().__init__(window)
        self.trend, self.age = trend, 0
        self.total = self.placed = self.squared = 0.0
        self.out = 0.0 if trend else None

    def step(self, x):
        q, w, oldest = self.values, self.window, 0.0
        if len(q) >= w:
            oldest = q.popleft()
            self.total -= oldest
            self.placed -= self.total
            self.squared -= oldest * oldest
        self.placed += len(q) * x
        self.total += x
        self.squared += x * x
        q.append(x)
        self.age += 1
        lost = not math.isfinite(self.total + self.placed + self.squared) or abs(self.total) < CANCELLED * abs(oldest) or self.squared < CANCELLED * oldest * oldest
        if self.age >= w or lost:
            self.age = 0
            self.total, self.squared = exact_sum(q), exact_sum([a * a for a in q])
            self.placed = exact_sum([i * a for i, a in enumerate(q)])
        n, total, placed = len(q), self.total, self.placed
        if not self.trend:
            return -(n * total - placed) / total + (n + 1) / 2 if total else 0.0
        places, squares = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        sx, sy = w * self.squared - total * total, w * squares - places * places
        return (w * placed - total * places) / math.sqrt(sx * sy) if sx > 0 and sy > 0 else 0.0


class CyberCycleKernel(Buffered):
    def __init__(self, window):
        super().__init__(window)
        self.alpha, self.n, self.y1, self.y2 = 2 / (window + 1), 0, 0.0, 0.0

    def step(self, x):
        q = self.values
        q.append(x)
        if len(q) > max(self.window, 6):
            q.popleft()
        self.n += 1
        y = 0.0
        if self.n >= self.window:

            def smooth(k):  # the current value takes the first tap at every place
                return (x + 2 * q[-2 - k] + 2 * q[-3 - k] + q[-4 - k]) / 6

            if self.window == 3:
                d = 0.0
            elif self.window == 4:
                d = smooth(0)
            elif self.window == 5:
                d = smooth(0) - 2 * smooth(1)
            else:
                d = (2 * q[-2] - 2 * q[-3] - q[-4] + q[-6]) / 6
            a = self.alpha
            y = (1 - a / 2) ** 2 * d + 2 * (1 - a) * self.y1 - (1 - a) ** 2 * self.y2
        self.y1, self.y2 = y, self.y1
        return y


class EfficiencyKernel(Buffered):
    def __init__(self, window, smoother):
        super().__init__(window)
        self.smoother, self.path = smoother, Sliding(window - 2)

    def step(self, x):
        q, w = self.values, self.window
        path = self.path.add(math.sqrt((x - q[-1]) * (x - q[-1]) + 1)) if q else None
        if len(q) >= w:
            q.popleft()
        q.append(x)
        if len(q) < w:
            return None
        p = math.sqrt((x - q[0]) * (x - q[0]) + w * w) / path
        return self.smoother.step(-p if x < q[-2] else p)


class FisherKernel(Kernel):
    def __init__(self, window, smoother):
        self.low, self.high, self.smoother = ExtremeKernel(window, -1), ExtremeKernel(window, 1), smoother

    f = None

    def step(self, x):
        low, high = self.low.step(x), self.high.step(x)
        if low == high:
            self.f = 0.0
        else:
            s = self.smoother.step(2 * ((x - low) / (high - low) - 0.5))
            if s is not None:
                s = max(-0.99, min(0.99, s))
                self.f = 0.5 * math.log((1 + s) / (1 - s)) + 0.5 * self.f
        return self.f


class LaguerreRsiKernel(Kernel):
    held = None

    def __init__(self, window):
        self.gamma, self.n = 2 / (window + 1), 0
        self.older = self.newer = (0.0, 0.0, 0.0, 0.0)

    def step(self, x):
        self.n += 1
        if self.n <= 2:
            return None
        g, p, q = self.gamma, self.older, self.newer
        stages = ((1 - g) * x + g * p[0], *(-g * q[k - 1] + p[k - 1] + g * p[k] for k in (1, 2, 3)))
        self.older, self.newer = q, stages
        gaps = [stages[k] - stages[k + 1] for k in range(3)]
        up, down = sum(d for d in gaps if d >= 0), -sum(d for d in gaps if d < 0)
        if up + down:
            self.held = up / (up + down)
        return self.held


class LaguerreFilterKernel(Kernel):
    stages = None

    def __init__(self, gamma):
        self.gamma = gamma

    def step(self, x):
        g, old = self.gamma, self.stages
        if old is None:
            new = [x] * 4
        else:
            new = [(1 - g) * x + g * old[0]]
            for k in (1, 2, 3):
                new.append(-g * new[k - 1] + old[k - 1] + g * old[k])
        self.stages = new
        return (new[0] + 2 * new[1] + 2 * new[2] + new[3]) / 6


def smoother_coefficients(window: int) -> tuple[float, float, float]:
    a = math.exp(-1.414 * math.pi / window)
    c2, c3 = 2 * a * math.cos(4.4422 / window), -a * a
    return 1 - c2 - c3, c2, c3


class SuperSmootherKernel(Kernel):
    def __init__(self, window):
        self.window, self.n = window, 0
        self.c1, self.c2, self.c3 = smoother_coefficients(window)
        self.x1 = self.y1 = self.y2 = 0.0

    def step(self, x):
        y = self.c1 * (x + self.x1) / 2 + self.c2 * self.y1 + self.c3 * self.y2
        self.x1, self.y1, self.y2 = x, y, self.y1
        self.n += 1
        return y if self.n >= self.window else None


def roofing_alpha(window: int) -> float:
    angle = 4.4422 / window
    return (math.cos(angle) + math.sin(angle) - 1) / math.cos(angle)


class RoofingKernel(Kernel):
    def __init__(self, window, smooth):
        self.window, self.alpha, self.n = window, roofing_alpha(window), 0
        self.smoother = SuperSmootherKernel(smooth)
        self.x1 = self.x2 = self.h1 = self.h2 = 0.0
        self.value = None

    def step(self, x):
        b = 1 - self.alpha
        h = (1 - self.alpha / 2) ** 2 * (x - 2 * self.x1 + self.x2) + 2 * b * self.h1 - b * b * self.h2
        self.x1, self.x2, self.h1, self.h2 = x, self.x1, h, self.h1
        if self.n > self.window:
            self.value = self.smoother.step(h)
        self.n += 1
        return self.value


# The angle constants of the two flex filters.
FLEX_EXPONENT, FLEX_ANGLE = 8.88442402435, 4.44221201218


def flex_coefficients(window: int, slope: bool) -> tuple[float, float, float]:
    a = FLEX_EXPONENT / window if slope else math.exp(-FLEX_EXPONENT / window)
    b, c3 = 2 * a * math.cos(FLEX_ANGLE / window), -a * a
    return 1 - b - c3, b, c3


class FlexKernel(Buffered):
    """ReFlex (slope) and TrendFlex; the sum of the filtered window is renewed once a window against drift."""

    def __init__(self, window, slope):
        super().__init__(window)
        self.slope, self.c = slope, flex_coefficients(window, slope)
        self.x1, self.ms, self.total, self.n = None, 0.0, 0.0, 0
        self.held = None

    def step(self, x):
        q, w = self.values, self.window
        if self.x1 is None:
            self.x1 = x
        if len(q) >= w:
            self.total -= q.popleft()
        c1, b, c3 = self.c
        y = c1 * (x + self.x1) / 2
        if q:
            y += b * q[-1]
            if len(q) > 1:
                y += c3 * q[-2]
        self.x1 = x
        q.append(y)
        self.n += 1
        self.total = exact_sum(q) if self.n % w == 0 else self.total + y
        k = len(q)
        d = k * y - self.total
        if self.slope:
            d += (q[0] - y) / w * (k * (k - 1) / 2)
        d /= w
        self.ms = 0.04 * d * d + 0.96 * self.ms
        if self.ms > 0:
            self.held = d / math.sqrt(self.ms)
        elif not self.slope:
            self.held = 0.0
        return self.held


class TreeKernel(Kernel):
    """A whole tree as one kernel."""

    def __init__(self, root: v.View):
        self.program = Program([root])

    def step(self, x):
        return self.program.scan([x])[0][0]


def kernel(view: v.View) -> Kernel:
    """The kernel of a view with one source."""
    match view:
        case v.GTE():
            return GteKernel(view.clip)
        case v.LTE():
            return LteKernel(view.clip)
        case v.Drawdown():
            return DrawdownKernel()
        case v.LnReturn():
            return LnReturnKernel()
        case v.WelfordRolling():
            return WelfordRollingKernel(view.stat)
        case v.Sma():
            return SmaKernel(view.window)
        case v.Ema():
            return EmaKernel(view.window, view.alpha)
        case v.Alma():
            return AlmaKernel(view.window, view.sigma, view.offset)
        case v.Lag():
            return LagKernel(view.window)
        case v.Min():
            return ExtremeKernel(view.window, -1)
        case v.Max():
            return ExtremeKernel(view.window, 1)
        case v.HLNormalizer():
            return HLNormalizerKernel(view.window)
        case v.Cumulative():
            return CumulativeKernel(view.window)
        case v.Roc():
            return RocKernel(view.window)
        case v.WelfordOnline():
            return WelfordOnlineKernel(view.window, view.stat)
        case v.Vst():
            return VstKernel(view.window, False)
        case v.Vsct():
            return VstKernel(view.window, True)
        case v.BinaryEntropy():
            return BinaryEntropyKernel(view.window)
        case v.Rsi():
            return ChangesKernel(view.window, True)
        case v.MyRSI():
            return ChangesKernel(view.window, False)
        case v.NoiseElimination():
            return NoiseEliminationKernel(view.window)
        case v.CorrelationTrend():
            return PlacesKernel(view.window, True)
        case v.CenterOfGravity():
            return PlacesKernel(view.window, False)
        case v.CyberCycle():
            return CyberCycleKernel(view.window)
        case v.PolarizedFractalEfficiency():
            return EfficiencyKernel(view.window, TreeKernel(view.smoother))
        case v.EhlersFisher():
            return FisherKernel(view.window, TreeKernel(view.smoother))
        case v.LaguerreRSI():
            return LaguerreRsiKernel(view.window)
        case v.LaguerreFilter():
            return LaguerreFilterKernel(view.gamma)
        case v.SuperSmoother():
            return SuperSmootherKernel(view.window)
        case v.RoofingFilter():
            return RoofingKernel(view.window, view.smooth)
        case v.ReFlex():
            return FlexKernel(view.window, True)
        case v.TrendFlex():
            return FlexKernel(view.window, False)
        case v.Custom():
            return view.factory()
    raise TypeError(f"no kernel for {type(view).__name__}")


def _divide(a, b):
    return a / b if b else None


_BINARY = {v.Add: lambda a, b: a + b, v.Subtract: lambda a, b: a - b, v.Multiply: lambda a, b: a * b, v.Divide: _divide}


class Program:
    """The distinct views under some roots with their states, for one series. strict stops at a division by 0 and at any
    output that is not finite, of inner views too."""

    def __init__(self, roots: list[v.View], strict: bool = False):
        order: dict[v.View, int] = {}
        for root in roots:
            for view in root.nodes():
                order.setdefault(view, len(order))
        self.strict = strict
        self.roots = [order[r] for r in roots]
        self.views = list(order)
        self.sources = [[order[s] for s in view.sources()] for view in order]
        self.plain = [isinstance(view, (v.Echo, v.Constant, v.Binary, v.Tanh)) for view in order]
        self.steps = [(view if plain else None, at, None if plain else kernel(view)) for view, at, plain in zip(order, self.sources, self.plain, strict=True)]

    def scan(self, values: list[float]) -> list[list[float | None]]:
        """The outputs of the roots for the next values of the series."""
        done: list[list[float | None]] = []
        for i, (view, at, state) in enumerate(self.steps):
            if state is not None:
                done.append(state.scan(done[at[0]]))
            elif isinstance(view, v.Echo):
                done.append(values)
            elif isinstance(view, v.Constant):
                done.append([float(view.value)] * len(values))
            elif isinstance(view, v.Tanh):
                done.append([None if x is None else math.tanh(x) for x in done[at[0]]])
            else:
                f = _BINARY[type(view)]
                pairs = list(zip(done[at[0]], done[at[1]], strict=True))
                if self.strict and isinstance(view, v.Divide) and any(a is not None and b == 0 for a, b in pairs):
                    raise ZeroDivisionError("division by zero")
                done.append([None if a is None or b is None else f(a, b) for a, b in pairs])
            if self.strict and any(x is not None and not math.isfinite(x) for x in done[-1]):
                raise ValueError("value must be finite" if isinstance(self.views[i], v.Echo) else f"{type(self.views[i]).__name__} must be finite")
        return [done[r] for r in self.roots]

    def before(self) -> list[float | None]:
        """The outputs of the roots while there is no input."""
        outs: list[float | None] = []
        for view, at, state in self.steps:
            if state is not None:
                outs.append(state.out)
            elif isinstance(view, v.Constant):
                outs.append(float(view.value))
            elif isinstance(view, v.Binary):
                a, b = outs[at[0]], outs[at[1]]
                outs.append(None if a is None or b is None else _BINARY[type(view)](a, b))
            elif isinstance(view, v.Tanh):
                outs.append(None if outs[at[0]] is None else math.tanh(outs[at[0]]))
            else:
                outs.append(None)
        return [outs[r] for r in self.roots]
