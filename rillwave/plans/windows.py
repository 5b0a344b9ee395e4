"""Views as window expressions, for trees without a recursive view.

Each tick-counting frame runs within partitions of (key, ready): the rows on which the source is ready, in order. The
frames of one readiness share their window specification, so Spark evaluates them together, and all of them need but
the one exchange by key. Columns a frame reads are made first; every view becomes one column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.operators import views as v

WINDOW_VIEWS = (
    v.Echo, v.Constant, v.Binary, v.Tanh, v.GTE, v.LTE, v.Drawdown, v.LnReturn, v.WelfordRolling, v.Sma, v.Alma, v.Lag, v.Min, v.Max, v.Cumulative,
    v.Roc, v.BinaryEntropy, v.Rsi, v.MyRSI, v.NoiseElimination, v.CorrelationTrend, v.CenterOfGravity, v.Expression,
)


def expressible(view: v.View) -> bool:
    return all(isinstance(n, WINDOW_VIEWS) for n in view.nodes())


class WindowPlan:
    """Adds the columns of views to a frame, sources first."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], value: str, strict: bool = False):
        # Dealt by key at first, so that every frame by (key, ready) finds its rows together.
        self.df, self.key, self.order, self.strict = df.repartition(*key), key, order, strict
        self.columns: dict[v.View, str] = {}
        self.classes: dict[object, str] = {}
        self.flags: dict[str, str] = {}
        self.n = 0
        self.value = self._add(F.col(value).cast("double"))
        self.input_ready = self._add(F.col(self.value).isNotNull())

    def _add(self, column: Column) -> str:
        name = f"__v{self.n}"
        self.n += 1
        self.df = self.df.withColumn(name, column)
        return name

    # Readiness: rows of equal class become ready together, so they share one flag column.

    def _class(self, view: v.View) -> object:
        """("t", n): ready from the nth input on, n = 0 before any. Anything else is ready on rows of its own."""
        if isinstance(view, (v.Echo, v.Expression)):
            return ("t", 1) if isinstance(view, v.Echo) else ("own", view)
        if isinstance(view, v.Constant):
            return ("t", 0)
        if isinstance(view, (v.LnReturn, v.Divide)):
            return ("own", view)
        classes = [self._class(s) for s in view.sources()]
        if any(c[0] == "own" for c in classes):
            return ("own", view)
        t = max(c[1] for c in classes)
        if isinstance(view, (v.Drawdown, v.CorrelationTrend)):
            return ("t", 0)
        first = {v.Sma: "window", v.Lag: "window", v.Rsi: "window", v.MyRSI: "window"}.get(type(view))
        if isinstance(view, v.NoiseElimination):
            return ("t", max(t, 1) + 1) if view.window > 1 else ("own", view)
        if isinstance(view, v.Roc):
            return ("own", view)
        return ("t", max(t, 1) - 1 + view.window) if first else ("t", max(t, 1) if not isinstance(view, (v.Binary, v.Tanh)) else t)

    def _flag(self, view: v.View) -> str:
        cls = self._class(view)
        if cls in (("t", 0), ("t", 1)):
            return self.input_ready
        if cls not in self.flags:
            self.flags[cls] = self._add(F.col(self.input_ready) & F.col(self.columns[view]).isNotNull())
        return self.flags[cls]

    @staticmethod
    def _falls_back(view: v.View) -> bool:
        """Whether a view may be ready and later not."""
        return any(isinstance(n, (v.LnReturn, v.Divide, v.Expression)) for n in view.nodes())

    def column(self, view: v.View) -> str:
        """The name of the view's column."""
        for node in view.nodes():
            if node not in self.columns:
                self.columns[node] = self._checked(node, self._compile(node))
        return self.columns[view]

    def _checked(self, view: v.View, name: str) -> str:
        """In strict mode an output that is not finite stops the query, an inner view's too."""
        if not self.strict:
            return name
        x, what = F.col(name), "value" if isinstance(view, v.Echo) else type(view).__name__
        bad = F.isnan(x) | (F.abs(x) == F.lit(math.inf))
        return self._add(F.when(bad, F.raise_error(F.lit(f"{what} must be finite")).cast("double")).otherwise(x))

    def _compile(self, view: v.View) -> str:
        if isinstance(view, v.Echo):
            return self.value
        if isinstance(view, v.Constant):
            return self._add(F.lit(float(view.value)))
        if isinstance(view, v.Expression):
            return self._add(view.function(F.col(self.columns[view.source])).cast("double"))
        if isinstance(view, v.Binary):
            a, b = F.col(self.columns[view.left]), F.col(self.columns[view.right])
            if isinstance(view, v.Divide):
                return self._add(a / b if self.strict else F.try_divide(a, b))
            return self._add(a + b if isinstance(view, v.Add) else a - b if isinstance(view, v.Subtract) else a * b)
        source = self.columns[view.source]
        x = F.col(source)
        if isinstance(view, v.Tanh):
            return self._add(F.tanh(x))
        if isinstance(view, (v.GTE, v.LTE)):
            pick = F.greatest if isinstance(view, v.GTE) else F.least
            out = F.when(x.isNotNull(), pick(x, F.lit(float(view.clip))))
            return self._settle(view, out, x.isNotNull())
        flag = self._flag(view.source)
        ticks = Window.partitionBy(*self.key, flag).orderBy(*self.order)
        out = self._frames(view, x, ticks)
        return self._settle(view, out, F.col(flag))

    def _settle(self, view: v.View, out: Column, ready: Column) -> str:
        """On rows without a tick: the output before, where there can be one, else null or the view's default."""
        if self._falls_back(view.source):
            made, on = self._add(out), self._add(ready)
            series = Window.partitionBy(*self.key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
            out = F.last(F.when(F.col(on), F.struct(F.col(made).alias("out"))), ignorenulls=True).over(series)["out"]
        else:
            out = F.when(ready, out)
        if isinstance(view, (v.Drawdown, v.CorrelationTrend)):
            out = F.coalesce(out, F.lit(0.0))
        return self._add(out)

    def _frames(self, view: v.View, x: Column, ticks) -> Column:
        so_far = ticks.rowsBetween(Window.unboundedPreceding, 0)
        last = lambda n: ticks.rowsBetween(-(n - 1), 0)
        rn = F.row_number().over(ticks)
        w = getattr(view, "window", 1)
        match view:
            case v.Sma():
                return F.when(rn >= w, F.avg(x).over(last(w + 1)))
            case v.Lag():
                return F.lag(x, w - 1).over(ticks) if w > 1 else x
            case v.Min():
                return F.min(x).over(last(w))
            case v.Max():
                return F.max(x).over(last(w))
            case v.Cumulative():
                return F.sum(x).over(last(w)) + F.first(x).over(so_far)
            case v.WelfordRolling():
                return {"std": F.stddev_pop, "variance": F.var_pop, "mean": F.avg}[view.stat](x).over(so_far)
            case v.LnReturn():
                before = F.lag(x, 1).over(ticks)
                return F.when((before != 0) & (F.try_divide(x, before) > 0), F.log(F.try_divide(x, before)))
            case v.BinaryEntropy():
                p = F.col(self._add(F.avg((x >= 0).cast("double")).over(last(w))))
                return F.when(p.isin(0.0, 1.0), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
            case v.Drawdown():
                peak = F.col(self._add(F.max(x).over(so_far)))
                fall = F.col(self._add(F.try_divide(peak - x, peak)))
                return F.greatest(F.lit(0.0), F.max(fall).over(so_far))
            case v.Alma():
                m, s = view.offset * (w + 1), w / view.sigma
                place = F.least(F.col(self._add(rn)) - 1, F.lit(w - 1))
                weight = F.col(self._add(F.exp(-F.pow(place - F.lit(m), F.lit(2.0)) / F.lit(2 * s * s))))
                return F.sum(weight * x).over(last(w)) / F.sum(weight).over(last(w))
            case v.Roc():
                base = F.col(self._add(F.coalesce(F.lag(x, w).over(ticks), F.first(x).over(so_far))))
                change = F.col(self._add(100 * F.try_divide(x - base, base)))
                return F.last(change, ignorenulls=True).over(so_far)
            case v.Rsi() | v.MyRSI():
                change = F.col(self._add(F.coalesce(x - F.lag(x, 1).over(ticks), F.lit(0.0))))
                up = F.col(self._add(F.sum(F.greatest(change, F.lit(0.0))).over(last(w))))
                down = F.col(self._add(F.sum(F.greatest(-change, F.lit(0.0))).over(last(w))))
                if isinstance(view, v.Rsi):
                    return F.when(rn >= w, F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(up, down))))
                share = F.col(self._add(F.try_divide(up - down, up + down)))
                return F.when(rn >= w, F.coalesce(F.last(share, ignorenulls=True).over(so_far), F.lit(0.0)))
            case v.NoiseElimination():
                return self._noise(F.col(self._add(F.collect_list(x).over(last(w)))))
            case v.CorrelationTrend() | v.CenterOfGravity():
                return self._places(view, x, ticks, last(w), rn)
        raise TypeError(f"{type(view).__name__} has no window form")

    @staticmethod
    def _noise(q: Column) -> Column:
        n = F.size(q)

        def falls(j):
            pairs = F.filter(F.sequence(F.lit(1), j - 2), lambda i: F.get(q, j) > F.get(q, i))
            return 2 * F.size(pairs) - (j - 2)

        total = F.aggregate(F.sequence(F.lit(3), n - 1), F.lit(0), lambda acc, j: acc + falls(j))
        return F.when(n < 2, F.lit(None)).when(n < 4, F.lit(0.0)).otherwise(total / (n * (n - 1) / 2))

    def _places(self, view: v.View, x: Column, ticks, frame, rn: Column) -> Column:
        """Sums over values and their places in the frame: no list per row.

        Rows are numbered within blocks of a window. A frame lies in two of them, told apart by their parity, so places
        stay below twice the window however long the series is, and sums do not cancel.
        """
        w = F.lit(float(view.window))
        at = F.col(self._add(rn - 1))
        inner, odd = F.col(self._add((at % view.window).cast("double"))), F.col(self._add(F.floor(at / view.window) % 2 == 1))
        even_sum = F.col(self._add(F.sum(F.when(odd, 0.0).otherwise(x)).over(frame)))
        odd_sum = F.col(self._add(F.sum(F.when(odd, x).otherwise(0.0)).over(frame)))
        s = F.col(self._add(even_sum + odd_sum))
        n = F.least((at + 1).cast("double"), w)
        placed = F.sum(inner * x).over(frame) + w * F.when(odd, odd_sum).otherwise(even_sum)
        p = F.col(self._add(F.col(self._add(placed)) - (inner + w - n + 1) * s))
        if isinstance(view, v.CenterOfGravity):
            return F.when(s == 0, F.lit(0.0)).otherwise(F.try_divide(-(n * s - p), s) + (n + 1) / 2)
        places, squares = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        sx = F.col(self._add(w * F.sum(x * x).over(frame) - s * s))
        sy = w * squares - places * places
        return F.when((sx > 0) & ~F.isnan(sx) & (sy > 0), (w * p - s * places) / F.sqrt(sx * sy)).otherwise(F.lit(0.0))

    def results(self, views: dict[str, v.View], nulls: str) -> dict[str, Column]:
        """The outputs by name; on rows with a null input the outputs before, if nulls is hold."""
        outs = {name: F.col(self.column(view)) for name, view in views.items()}
        if nulls == "absent":
            return outs
        series = Window.partitionBy(*self.key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        both = F.struct(*[out.alias(f"o{i}") for i, out in enumerate(outs.values())])
        held = F.col(self._add(F.last(F.when(F.col(self.input_ready), both), ignorenulls=True).over(series)))
        return {name: F.when(held.isNull(), out).otherwise(held[f"o{i}"]) for i, (name, out) in enumerate(outs.items())}
