"""Many series side by side: the scan's programs in numpy, one step for a row of all series at once.

A block is a matrix of values, a column per series and a row per tick, longest series first, so that those still going
are a prefix of the columns. A view gives a matrix of outputs and one of whether they are ready. What a view reads is
packed to the ticks of its source, and its outputs are spread over the rows again, held where the source had no tick.
Views without a form of their own here run their kernel column by column.
"""

from __future__ import annotations

import numpy as np

from rillwave.operators import kernels
from rillwave.operators import views as v

#: Series of similar length from which on they are stepped together.
LEAST = 24


class Block:
    """Ticks of series: values (ticks x series) and how many each has, falling."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.x, self.counts = values, counts
        self.ticks, self.series = values.shape
        self.going = self.series - np.searchsorted(counts[::-1], np.arange(self.ticks), side="right")

    def steps(self):
        """Each tick with the number of series that have it and their values."""
        for t, a in enumerate(self.going.tolist()):
            yield t, a, self.x[t, :a]

    def from_tick(self, k: int) -> np.ndarray:
        return np.broadcast_to((np.arange(self.ticks) >= k)[:, None], self.x.shape)

    def back(self, n: int) -> np.ndarray:
        """The values n ticks before, 0 before the first."""
        out = np.zeros_like(self.x)
        if n < self.ticks:
            out[n:] = self.x[: self.ticks - n] if n else self.x
        return out


def run(program: kernels.Program, values: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Outputs and readiness of the roots for series that begin with these values; counts must fall."""
    whole = np.arange(len(values))[:, None] < counts[None, :]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    with np.errstate(all="ignore"):
        for view, plain, at in zip(program.views, program.plain, program.sources, strict=True):
            if isinstance(view, v.Echo):
                done.append((values, whole))
            elif isinstance(view, v.Constant):
                done.append((np.full(values.shape, float(view.value)), np.ones_like(whole)))
            elif isinstance(view, v.Tanh):
                y, ready = done[at[0]]
                done.append((np.tanh(y), ready))
            elif plain:
                (a, ra), (b, rb) = done[at[0]], done[at[1]]
                both = ra & rb
                if isinstance(view, v.Divide):
                    both = both & (b != 0)
                    done.append((np.divide(a, b, out=np.zeros_like(a), where=both), both))
                else:
                    done.append(((a + b if isinstance(view, v.Add) else a - b if isinstance(view, v.Subtract) else a * b), both))
            else:
                y, ready = done[at[0]]
                done.append(_on_ticks(y, ready & whole, lambda block, view=view: _step(view, block), kernels.kernel(view).out))
    return [done[r] for r in program.roots]


def _on_ticks(y: np.ndarray, ready: np.ndarray, step, before: float | None) -> tuple[np.ndarray, np.ndarray]:
    """step() on the ready values of each series; its outputs on all rows, held, and before where nothing came yet."""
    upto = np.cumsum(ready, axis=0)
    counts = upto[-1]
    order = np.argsort(-counts, kind="stable")
    packed = np.zeros((max(1, int(counts.max(initial=0))), y.shape[1]))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    rows, columns = np.nonzero(ready)
    packed[upto[rows, columns] - 1, place[columns]] = y[rows, columns]
    out, is_out = step(Block(packed, counts[order]))
    at = np.maximum(upto - 1, 0)
    none = upto == 0
    got, got_ready = out[at, place[None, :]], is_out[at, place[None, :]]
    return np.where(none, 0.0 if before is None else before, got), np.where(none, before is not None, got_ready)


def _exact(x: np.ndarray) -> np.ndarray:
    """Sums of columns, rounded once, as the kernels round them."""
    return np.array([kernels.exact_sum(column) for column in x.T.tolist()])


def _sums(x: np.ndarray, window: int) -> np.ndarray:
    """Sums over the last values, kept up and renewed as kernels.Sliding does."""
    out, total, some = np.empty_like(x), np.zeros(x.shape[1]), np.zeros(x.shape[1], dtype=np.int64)
    for t in range(len(x)):
        old = x[t - window] if t >= window else np.zeros(x.shape[1])
        total = total - old + x[t]
        some += (x[t] != 0).astype(np.int64) - (old != 0)
        if (t + 1) % window == 0:
            total = _exact(x[t - window + 1 : t + 1])
        elif len(lost := np.flatnonzero(~np.isfinite(total) | (np.abs(total) < kernels.CANCELLED * np.abs(old)))):
            total[lost] = _exact(x[max(0, t - window + 1) : t + 1, lost])
        total[some == 0] = 0.0
        out[t] = total
    return out


def _equal_sums(x: np.ndarray, window: int) -> np.ndarray:
    """Sums over the last values that are equal for equal windows, as kernels.Anew and kernels.Carried make them."""
    out = np.zeros_like(x)
    if window <= kernels.ANEW + 1:
        for k in range(min(window, len(x)) - 1, -1, -1):
            out[k:] += x[: len(x) - k]
        return out
    total, rest = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(len(x)):
        old = x[t - window] if t >= window else np.zeros(x.shape[1])
        total, less = kernels.two_sum(total, -old)
        rest = rest + less
        total, more = kernels.two_sum(total, x[t])
        rest = rest + more
        out[t] = total + rest
        lost = np.flatnonzero(((t + 1) % window == 0) | ~np.isfinite(out[t]) | (np.abs(out[t]) < kernels.CANCELLED * np.abs(old)))
        if len(lost):
            parts = [kernels.exact_parts(column) for column in x[max(0, t - window + 1) : t + 1, lost].T.tolist()]
            total[lost], rest[lost] = np.array(parts).T
            out[t, lost] = total[lost]
    return out


def _extremes(x: np.ndarray, window: int, pick) -> np.ndarray:
    """The least or greatest of the last values, by doubling."""
    out, size = x.copy(), 1
    while size < min(window, len(x)):
        by = min(size, window - size)
        nxt = out.copy()
        nxt[by:] = pick(out[by:], out[:-by])
        out, size = nxt, size + by
    return out


def _step(view: v.View, b: Block) -> tuple[np.ndarray, np.ndarray]:
    x, w, y, every = b.x, getattr(view, "window", 1), np.zeros_like(b.x), np.ones(b.x.shape, dtype=bool)
    number = np.arange(1, b.ticks + 1)[:, None]
    match view:
        case v.GTE():
            return np.maximum(x, view.clip), every
        case v.LTE():
            return np.minimum(x, view.clip), every
        case v.Sma():
            return _equal_sums(x, w + 1) / np.minimum(number, w + 1), b.from_tick(w - 1)
        case v.Lag():
            return b.back(w - 1), b.from_tick(w - 1)
        case v.Min() | v.Max():
            return _extremes(x, w, np.minimum if isinstance(view, v.Min) else np.maximum), every
        case v.Cumulative():
            return _sums(x, w) + x[:1], every
        case v.Rsi() | v.MyRSI():
            change = np.diff(x, axis=0, prepend=x[:1])
            up, down = _sums(np.maximum(change, 0.0), w), _sums(np.maximum(-change, 0.0), w)
            if isinstance(view, v.Rsi):
                return np.where(down == 0, 100.0, 100 - 100 / (1 + up / np.where(down == 0, 1.0, down))), b.from_tick(w - 1)
            both = up + down
            return _held((up - down) / np.where(both == 0, 1.0, both), both != 0)[0], b.from_tick(w - 1)
        case v.Roc():
            base = b.back(w)
            base[:w] = x[:1]
            return _held(100 * ((x - base) / np.where(base == 0, 1.0, base)), base != 0)
        case v.Ema():
            weight, last = view.alpha / (1 + w), np.zeros(b.series)
            for t, a, now in b.steps():
                old = last[:a]
                y[t, :a] = last[:a] = np.where(old == 0, now, weight * now + (1 - weight) * old)
            return y, b.from_tick(w - 1)
        case v.HLNormalizer():
            return _high_low(b, w), every
        case v.WelfordOnline() | v.Vst() | v.Vsct():
            return _welford(view, b)
        case v.CyberCycle():
            return _cycle(b, w), every
        case v.PolarizedFractalEfficiency():
            return _efficiency(view, b)
        case v.EhlersFisher():
            return _fisher(view, b)
        case v.LaguerreRSI():
            return _laguerre_rsi(b, 2 / (w + 1))
        case v.LaguerreFilter():
            g, old = view.gamma, np.repeat(x[:1], 4, axis=0)
            for t, a, now in b.steps():
                if t:
                    new = np.empty((4, a))
                    new[0] = (1 - g) * now + g * old[0, :a]
                    for k in (1, 2, 3):
                        new[k] = -g * new[k - 1] + old[k - 1, :a] + g * old[k, :a]
                    old[:, :a] = new
                y[t, :a] = (old[0, :a] + 2 * old[1, :a] + 2 * old[2, :a] + old[3, :a]) / 6
            return y, every
        case v.SuperSmoother():
            return _smooth(b, w), b.from_tick(w - 1)
        case v.RoofingFilter():
            return _roofing(b, w, view.smooth)
        case v.ReFlex() | v.TrendFlex():
            return _flex(b, w, isinstance(view, v.ReFlex))
    ready = np.zeros(b.x.shape, dtype=bool)
    for k, n in enumerate(b.counts.tolist()):
        outs = kernels.kernel(view).scan(x[:n, k].tolist())
        ready[:n, k] = [o is not None for o in outs]
        y[:n, k] = [0.0 if o is None else o for o in outs]
    return y, ready


def _held(y: np.ndarray, defined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last defined value so far (0 before any), and whether there is one."""
    at = np.maximum.accumulate(np.where(defined, np.arange(len(y))[:, None], -1), axis=0)
    return np.where(at < 0, 0.0, np.take_along_axis(y, np.maximum(at, 0), axis=0)), at >= 0


def _high_low(b: Block, w: int) -> np.ndarray:
    x, y = b.x, np.zeros_like(b.x)
    low, high = x[0].copy(), x[0].copy()
    for t, a, now in b.steps():
        if t >= w:
            oldest = x[t - w, :a]
            gone = np.flatnonzero((oldest <= low[:a]) | (oldest >= high[:a]))
            if len(gone):
                held = x[t - w : t, gone]
                low[gone], high[gone] = held.min(axis=0), held.max(axis=0)
        np.minimum(low[:a], now, out=low[:a])
        np.maximum(high[:a], now, out=high[:a])
        span = high[:a] - low[:a]
        y[t, :a] = np.where(low[:a] == high[:a], 0.0, 2 * (now - low[:a]) / np.where(span == 0, 1.0, span) - 1)
    return y


def _welford(view: v.View, b: Block) -> tuple[np.ndarray, np.ndarray]:
    x, w, y = b.x, view.window, np.zeros_like(b.x)
    mean, m2 = np.zeros(b.series), np.zeros(b.series)
    for t, a, now in b.steps():
        m, s = mean[:a], m2[:a]
        if t >= w:
            d = x[t - w, :a] - m
            less = m - d / w
            s = s - d * (d + m - less)
            m = less
        n = min(t + 1, w)
        d = now - m
        m = m + d / n
        s = s + d * (now - m)
        mean[:a], m2[:a] = m, s
        variance = s / (n - 1) if n > 1 else np.zeros(a)
        std = np.sqrt(np.maximum(variance, 0.0))
        if isinstance(view, v.WelfordOnline):
            y[t, :a] = {"mean": m, "variance": variance, "std": std}[view.stat]
        else:
            some = np.where(std == 0, 1.0, std)
            y[t, :a] = np.where(std == 0, 0.0, (now - m) / some) if isinstance(view, v.Vsct) else now / some
    return y, b.from_tick(w - 2)


def _cycle(b: Block, w: int) -> np.ndarray:
    x, y, a = b.x, np.zeros_like(b.x), 2 / (w + 1)
    back = [b.back(k) for k in range(6)]
    if w == 3:
        d = np.zeros_like(x)
    elif w in (4, 5):
        taps = [(x + 2 * back[1 + k] + 2 * back[2 + k] + back[3 + k]) / 6 for k in range(w - 3)]
        d = taps[0] if w == 4 else taps[0] - 2 * taps[1]
    else:
        d = (2 * back[1] - 2 * back[2] - back[3] + back[5]) / 6
    for t in range(w - 1, b.ticks):
        y[t] = (1 - a / 2) ** 2 * d[t] + 2 * (1 - a) * y[t - 1] - (1 - a) ** 2 * y[t - 2]
    return y


def _efficiency(view: v.View, b: Block) -> tuple[np.ndarray, np.ndarray]:
    x, w = b.x, view.window
    y, ready = np.zeros_like(x), np.zeros(x.shape, dtype=bool)
    if b.ticks < w:
        return y, ready
    change = np.diff(x, axis=0)
    path = _sums(np.sqrt(change * change + 1), w - 2)[w - 2 :]
    far = x[w - 1 :] - x[: b.ticks - w + 1]
    p = np.sqrt(far * far + w * w) / path
    p = np.where(change[w - 2 :] < 0, -p, p)
    (made, is_made), = run(kernels.Program([view.smoother]), p, np.maximum(b.counts - w + 1, 0))
    y[w - 1 :], ready[w - 1 :] = made, is_made
    return y, ready


def _fisher(view: v.View, b: Block) -> tuple[np.ndarray, np.ndarray]:
    x, y = b.x, np.zeros_like(b.x)
    low, high = _extremes(x, view.window, np.minimum), _extremes(x, view.window, np.maximum)
    flat = low == high
    u = 2 * ((x - low) / np.where(flat, 1.0, high - low) - 0.5)
    valid = np.arange(b.ticks)[:, None] < b.counts[None, :]
    program = kernels.Program([view.smoother])
    s, has = _on_ticks(u, ~flat & valid, lambda ticks: run(program, ticks.x, ticks.counts)[0], None)
    s = np.clip(s, -0.99, 0.99)
    turn = 0.5 * np.log((1 + s) / (1 - s))
    f = np.zeros(b.series)
    for t in range(b.ticks):
        f = np.where(flat[t], 0.0, np.where(has[t], turn[t] + 0.5 * f, f))
        y[t] = f
    return y, np.ones(x.shape, dtype=bool)


def _laguerre_rsi(b: Block, g: float) -> tuple[np.ndarray, np.ndarray]:
    y, ready = np.zeros_like(b.x), np.zeros(b.x.shape, dtype=bool)
    p, q = np.zeros((4, b.series)), np.zeros((4, b.series))
    held, has = np.zeros(b.series), np.zeros(b.series, dtype=bool)
    for t, _, _ in b.steps():
        if t < 2:
            continue
        new = np.empty_like(p)
        new[0] = (1 - g) * b.x[t] + g * p[0]
        new[1:] = -g * q[:3] + p[:3] + g * p[1:]
        p, q = q, new
        gaps = new[:3] - new[1:]
        up, down = np.where(gaps >= 0, gaps, 0.0).sum(axis=0), -np.where(gaps < 0, gaps, 0.0).sum(axis=0)
        both = up + down
        held = np.where(both == 0, held, up / np.where(both == 0, 1.0, both))
        has = has | (both != 0)
        y[t], ready[t] = held, has
    return y, ready


def _smooth(b: Block, w: int) -> np.ndarray:
    c1, c2, c3 = kernels.smoother_coefficients(w)
    y = np.zeros((b.ticks + 2, b.series))
    middle = c1 * (b.x + b.back(1)) / 2
    for t in range(b.ticks):
        y[t + 2] = middle[t] + c2 * y[t + 1] + c3 * y[t]
    return y[2:]


def _roofing(b: Block, w: int, smooth: int) -> tuple[np.ndarray, np.ndarray]:
    y, ready = np.zeros_like(b.x), np.zeros(b.x.shape, dtype=bool)
    alpha = kernels.roofing_alpha(w)
    c = 1 - alpha
    h = np.zeros((b.ticks + 2, b.series))
    second = (1 - alpha / 2) ** 2 * (b.x - 2 * b.back(1) + b.back(2))
    for t in range(b.ticks):
        h[t + 2] = second[t] + 2 * c * h[t + 1] - c * c * h[t]
    if b.ticks > w + 1:
        y[w + 1 :] = _smooth(Block(h[w + 3 :], np.maximum(b.counts - w - 1, 0)), smooth)
        ready[w + smooth :] = True
    return y, ready


def _flex(b: Block, w: int, slope: bool) -> tuple[np.ndarray, np.ndarray]:
    c1, c2, c3 = kernels.flex_coefficients(w, slope)
    y, out, ready = np.zeros_like(b.x), np.zeros_like(b.x), np.zeros(b.x.shape, dtype=bool)
    total, ms, held, has = np.zeros(b.series), np.zeros(b.series), np.zeros(b.series), np.full(b.series, not slope)
    for t in range(b.ticks):
        before = min(t, w - 1)
        now = c1 * (b.x[t] + b.x[max(t - 1, 0)]) / 2
        if before:
            now = now + c2 * y[t - 1]
        if before > 1:
            now = now + c3 * y[t - 2]
        y[t] = now
        total = total - y[t - w] + now if t >= w else total + now
        k = before + 1
        if (t + 1) % w == 0:
            total = _exact(y[t - w + 1 : t + 1])
        d = k * now - total
        if slope:
            d = d + (y[t - k + 1] - now) / w * (k * (k - 1) / 2)
        d = d / w
        ms = 0.04 * d * d + 0.96 * ms
        some = ms > 0
        held = np.where(some, d / np.sqrt(np.where(some, ms, 1.0)), held if slope else 0.0)
        has = has | some
        out[t], ready[t] = held, has
    return out, ready


def spread(program: kernels.Program, values: np.ndarray, nulls: np.ndarray, starts: np.ndarray, ends: np.ndarray, outs: np.ndarray, ready: np.ndarray) -> np.ndarray:
    """Runs whole series, rows starts[k] to ends[k] of values, and fills outs and ready (roots x rows).

    Series are stepped together with those of at least half their length, so a block holds at most twice its rows.
    Returns the series that are left to run one by one: those of lengths too rare, and those with values that are not finite.
    """
    good = ~nulls
    upto = np.append(0, np.cumsum(good))
    lengths = upto[ends] - upto[starts]
    odd = np.append(0, np.cumsum(good & ~np.isfinite(values)))
    fit = odd[ends] == odd[starts]
    left = [np.flatnonzero(~fit)]
    before = program.before()
    order = np.flatnonzero(fit)
    order = order[np.argsort(-lengths[order], kind="stable")]
    level = np.floor(np.log2(np.maximum(lengths[order], 1))).astype(int)
    for at in np.split(order, np.flatnonzero(np.diff(level)) + 1):
        if len(at) < LEAST or not lengths[at[0]]:
            left.append(at)
            continue
        rows = np.concatenate([np.arange(starts[k], ends[k]) for k in at])
        column = np.repeat(np.arange(len(at)), ends[at] - starts[at])
        tick = upto[rows + 1] - upto[starts[at]][column] - 1  # of the last value at or before a row
        taken = good[rows]
        x = np.zeros((int(lengths[at[0]]), len(at)))
        x[tick[taken], column[taken]] = values[rows[taken]]
        for r, (y, is_ready) in enumerate(run(program, x, lengths[at])):
            first = np.maximum(tick, 0)
            outs[r, rows] = np.where(tick < 0, before[r] or 0.0, y[first, column])
            ready[r, rows] = np.where(tick < 0, before[r] is not None, is_ready[first, column])
    return np.concatenate(left)

