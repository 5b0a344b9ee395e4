"""View trees as DuckDB SQL over all rows of a table: a second, set-based reading of every operator for comparison.

Each view becomes a common table (k, id, n, y): series key, row id, row number in the series and output. A view reads
the ticks of its source, its rows with an output, numbered by t. Recursive views are recursive tables, a turn a tick.
"""

from __future__ import annotations


from rillwave.operators import kernels
from rillwave.operators import views as v


class OracleSql:
    def __init__(self, table: str, key: str, row_id: str, order: str, value: str):
        self.parts: list[str] = []
        self.done: dict[tuple[v.View, str], str] = {}
        self.key, self.row_id = key, row_id
        self._add("base", f"SELECT {key} AS k, {row_id} AS id, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n, {value}::DOUBLE AS y FROM {table}")

    def _add(self, name: str, body: str) -> str:
        self.parts.append(f"{name} AS ({body})")
        return name

    def _new(self, body: str) -> str:
        return self._add(f"q{len(self.parts)}", body)

    def sql(self, view: v.View, name: str = "out") -> str:
        last = self.compile(view, "base")
        return "WITH RECURSIVE " + ",\n".join(self.parts) + f"\nSELECT id AS {self.row_id}, k AS {self.key}, round(y + 1.7e-8, 6) + 0.0 AS {name} FROM {last}"

    def compile(self, view: v.View, echo: str) -> str:
        """The table of a view whose Echo is the table echo."""
        if (view, echo) not in self.done:
            self.done[view, echo] = self._compile(view, echo)
        return self.done[view, echo]

    def _compile(self, view: v.View, echo: str) -> str:
        if isinstance(view, v.Echo):
            return echo
        if isinstance(view, v.Constant):
            return self._new(f"SELECT k, id, n, {float(view.value)!r}::DOUBLE AS y FROM {echo}")
        if isinstance(view, v.Binary):
            a, b = self.compile(view.left, echo), self.compile(view.right, echo)
            sign = {v.Add: "a.y + b.y", v.Subtract: "a.y - b.y", v.Multiply: "a.y * b.y", v.Divide: "a.y / nullif(b.y, 0)"}[type(view)]
            return self._new(f"SELECT a.k, a.id, a.n, {sign} AS y FROM {a} a JOIN {b} b ON a.id = b.id")
        source = self.compile(view.source, echo)
        if isinstance(view, v.Tanh):
            return self._new(f"SELECT k, id, n, (exp(2 * y) - 1) / (exp(2 * y) + 1) AS y FROM {source}")
        ticks = self._new(f"SELECT k, id, n, y AS x, row_number() OVER (PARTITION BY k ORDER BY n) AS t FROM {source} WHERE y IS NOT NULL")
        made = self._view(view, ticks)
        default = "0.0" if isinstance(view, (v.Drawdown, v.CorrelationTrend, v.HLNormalizer)) or isinstance(view, (v.WelfordOnline, v.Vst, v.Vsct)) and view.window == 1 else "NULL"
        return self._new(f"SELECT a.k, a.id, a.n, CASE WHEN b.id IS NULL THEN {default} ELSE b.y END AS y FROM {source} a LEFT JOIN {made} b ON a.id = b.id")

    def _view(self, view: v.View, p: str) -> str:
        over = "OVER (PARTITION BY k ORDER BY t{})"
        w = getattr(view, "window", 1)
        last = lambda n: over.format(f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
        so_far = over.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        plain = over.format("")
        select = lambda y, of=p: self._new(f"SELECT k, id, n, t, {y} AS y FROM {of}")
        match view:
            case v.GTE():
                return select(f"greatest(x, {float(view.clip)!r})")
            case v.LTE():
                return select(f"least(x, {float(view.clip)!r})")
            case v.Drawdown():
                a = self._new(f"SELECT *, max(x) {so_far} AS peak FROM {p}")
                return select(f"greatest(0.0, max((peak - x) / nullif(peak, 0)) {so_far})", a)
            case v.LnReturn():
                a = self._new(f"SELECT *, x / nullif(lag(x) {plain}, 0) AS r FROM {p}")
                return select("CASE WHEN r > 0 THEN ln(r) END", a)
            case v.WelfordRolling():
                return select({"std": f"stddev_pop(x) {so_far}", "variance": f"var_pop(x) {so_far}", "mean": f"avg(x) {so_far}"}[view.stat])
            case v.Sma():
                return select(f"CASE WHEN t >= {w} THEN avg(x) {last(w + 1)} END")
            case v.Alma():
                m, s = view.offset * (w + 1), w / view.sigma
                a = self._new(f"SELECT *, exp(-pow(least(t - 1, {w - 1}) - {m!r}, 2) / {2 * s * s!r}) AS g FROM {p}")
                return select(f"sum(g * x) {last(w)} / sum(g) {last(w)}", a)
            case v.Lag():
                return select(f"lag(x, {w - 1}) {plain}")
            case v.Min():
                return select(f"min(x) {last(w)}")
            case v.Max():
                return select(f"max(x) {last(w)}")
            case v.Cumulative():
                return select(f"sum(x) {last(w)} + first_value(x) {so_far}")
            case v.Roc():
                a = self._new(f"SELECT *, coalesce(lag(x, {w}) {plain}, first_value(x) {so_far}) AS o FROM {p}")
                a = self._new(f"SELECT *, 100 * (x - o) / nullif(o, 0) AS c FROM {a}")
                return select(f"last_value(c IGNORE NULLS) {so_far}", a)
            case v.BinaryEntropy():
                a = self._new(f"SELECT *, avg((x >= 0)::INT) {last(w)} AS s FROM {p}")
                return select("CASE WHEN s IN (0, 1) THEN 0 ELSE -(s * log2(s) + (1 - s) * log2(1 - s)) END", a)
            case v.Rsi() | v.MyRSI():
                a = self._new(f"SELECT *, coalesce(x - lag(x) {plain}, 0) AS c FROM {p}")
                a = self._new(f"SELECT *, sum(greatest(c, 0)) {last(w)} AS up, sum(greatest(-c, 0)) {last(w)} AS down FROM {a}")
                if isinstance(view, v.Rsi):
                    return select(f"CASE WHEN t >= {w} THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END", a)
                a = self._new(f"SELECT *, (up - down) / nullif(up + down, 0) AS h FROM {a}")
                return select(f"CASE WHEN t >= {w} THEN coalesce(last_value(h IGNORE NULLS) {so_far}, 0) END", a)
            case v.NoiseElimination():
                pairs = self._new(
                    f"SELECT c.id AS cid, sum(CASE WHEN b.x > a.x THEN 1 ELSE -1 END) AS s FROM {p} c JOIN {p} a ON a.k = c.k AND a.t > greatest(c.t - {w}, 0) + 1 AND a.t <= c.t"
                    f" JOIN {p} b ON b.k = c.k AND b.t >= a.t + 2 AND b.t <= c.t GROUP BY c.id"
                )
                n = f"least(t, {w})"
                return self._new(f"SELECT k, id, n, t, CASE WHEN {n} < 2 THEN NULL ELSE coalesce(s, 0) / ({n} * ({n} - 1) / 2.0) END AS y FROM {p} LEFT JOIN {pairs} ON id = cid")
            case v.CorrelationTrend() | v.CenterOfGravity():
                a = self._new(
                    f"SELECT c.id AS cid, count(*) AS m, sum(a.x) AS sx, sum(a.x * a.x) AS sxx, sum(a.i) AS si, sum(a.i * a.i) AS sii, sum(a.i * a.x) AS six"
                    f" FROM {p} c JOIN LATERAL (SELECT x, t - greatest(c.t - {w}, 0) - 1 AS i FROM {p} b WHERE b.k = c.k AND b.t > c.t - {w} AND b.t <= c.t) a ON true GROUP BY c.id"
                )
                if isinstance(view, v.CenterOfGravity):
                    y = "CASE WHEN sx = 0 THEN 0 ELSE -(m * sx - six) / sx + (m + 1) / 2.0 END"
                else:
                    y = f"CASE WHEN {w} * sxx - sx * sx > 0 AND {w} * sii - si * si > 0 THEN ({w} * six - sx * si) / sqrt(({w} * sxx - sx * sx) * ({w} * sii - si * si)) ELSE 0 END"
                return self._new(f"SELECT k, id, n, t, {y} AS y FROM {p} JOIN {a} ON id = cid")
        return self._recursive(view, p, w, plain, last, select)

    def _recursive(self, view: v.View, p: str, w: int, plain: str, last, select) -> str:
        match view:
            case v.Ema():
                g = view.alpha / (1 + w)
                return self._turns(p, {"e": "0.0"}, [{"e_": f"CASE WHEN e = 0 THEN x ELSE {g!r} * x + {1 - g!r} * e END"}], f"CASE WHEN t >= {w} THEN e_ END", {"e": "e_"})
            case v.WelfordOnline() | v.Vst() | v.Vsct():
                a = self._new(f"SELECT *, lag(x, {w}) {plain} AS xo FROM {p}")
                lets = [
                    {"m1": "CASE WHEN xo IS NULL THEN m ELSE m - (xo - m) / c END", "c1": "CASE WHEN xo IS NULL THEN c ELSE c - 1 END"},
                    {"q1": "CASE WHEN xo IS NULL THEN q ELSE q - (xo - m) * (xo - m1) END", "m_": "m1 + (x - m1) / (c1 + 1)", "c_": "c1 + 1"},
                    {"q_": "q1 + (x - m1) * (x - m_)"},
                    {"v_": "CASE WHEN c_ > 1 THEN q_ / (c_ - 1) ELSE 0 END"},
                    {"s_": "sqrt(greatest(0.0, v_))"},
                ]
                y = {"std": "s_", "mean": "m_", "variance": "v_"}[getattr(view, "stat", "std")]
                if isinstance(view, v.Vst):
                    y = "CASE WHEN s_ = 0 THEN x ELSE x / s_ END"
                if isinstance(view, v.Vsct):
                    y = "CASE WHEN s_ = 0 THEN 0 ELSE (x - m_) / s_ END"
                return self._turns(a, {"m": "0.0", "q": "0.0", "c": "0.0"}, lets, f"CASE WHEN c_ >= {w - 1} THEN {y} END", {"m": "m_", "q": "q_", "c": "c_"})
            case v.HLNormalizer():
                lets = [
                    {"full_": f"len(b) >= {w}"},
                    {"again": "full_ AND (b[1] <= lo OR b[1] >= hi)"},
                    {"lo1": "CASE WHEN lo IS NULL THEN x WHEN again THEN list_min(b) ELSE lo END", "hi1": "CASE WHEN hi IS NULL THEN x WHEN again THEN list_max(b) ELSE hi END"},
                    {"lo_": "least(lo1, x)", "hi_": "greatest(hi1, x)", "b_": "list_append(CASE WHEN full_ THEN b[2:] ELSE b END, x)"},
                ]
                y = "CASE WHEN lo_ = hi_ THEN 0 ELSE -1 + 2 * (x - lo_) / (hi_ - lo_) END"
                return self._turns(p, {"b": "[]::DOUBLE[]", "lo": "NULL::DOUBLE", "hi": "NULL::DOUBLE"}, lets, y, {"b": "b_", "lo": "lo_", "hi": "hi_"})
            case v.CyberCycle():
                lag = lambda i: f"lag(x, {i}) {plain}" if i else "x"
                smooth = lambda j: f"(x + 2 * {lag(j + 1)} + 2 * {lag(j + 2)} + {lag(j + 3)}) / 6"
                d = {3: "0.0", 4: smooth(0), 5: f"{smooth(0)} - 2 * {smooth(1)}"}.get(w, f"{smooth(0)} - 2 * {smooth(1)} + {smooth(2)}")
                a = self._new(f"SELECT *, {d} AS d FROM {p}")
                g = 2 / (w + 1)
                y = f"CASE WHEN t < {w} THEN 0 ELSE {(1 - g / 2) ** 2!r} * d + {2 * (1 - g)!r} * y1 - {(1 - g) ** 2!r} * y2 END"
                return self._turns(a, {"y1": "0.0", "y2": "0.0"}, [{"y_": y}], "y_", {"y1": "y_", "y2": "y1"})
            case v.SuperSmoother():
                return self._turns(*self._smoother(p, w))
            case v.RoofingFilter():
                g = kernels.roofing_alpha(w)
                h = f"{(1 - g / 2) ** 2!r} * (x - 2 * x1 + x2) + {2 * (1 - g)!r} * h1 - {(1 - g) ** 2!r} * h2"
                hp = self._turns(p, dict.fromkeys(("x1", "x2", "h1", "h2"), "0.0"), [{"h_": h}], "h_", {"x1": "x", "x2": "x1", "h1": "h_", "h2": "h1"})
                late = self._new(f"SELECT k, id, n, y AS x, row_number() OVER (PARTITION BY k ORDER BY n) AS t FROM {hp} WHERE t > {w + 1}")
                return self._turns(*self._smoother(late, view.smooth))
            case v.LaguerreFilter():
                g = float(view.gamma)
                step = [{"a_": f"CASE WHEN t = 1 THEN x ELSE {1 - g!r} * x + {g!r} * a END"}]
                for new, low, old_low, old in (("b_", "a_", "a", "b"), ("c_", "b_", "b", "c"), ("d_", "c_", "c", "d")):
                    step.append({new: f"CASE WHEN t = 1 THEN x ELSE -{g!r} * {low} + {old_low} + {g!r} * {old} END"})
                return self._turns(p, dict.fromkeys("abcd", "0.0"), step, "(a_ + 2 * b_ + 2 * c_ + d_) / 6", {c: f"{c}_" for c in "abcd"})
            case v.LaguerreRSI():
                g = 2 / (w + 1)
                new = {"n0": f"{1 - g!r} * x + {g!r} * p0"} | {f"n{i}": f"-{g!r} * q{i - 1} + p{i - 1} + {g!r} * p{i}" for i in (1, 2, 3)}
                new = {c: f"CASE WHEN t <= 2 THEN 0.0 ELSE {e} END" for c, e in new.items()}
                gaps = {"up": " + ".join(f"greatest(n{i} - n{i + 1}, 0)" for i in range(3)), "down": " + ".join(f"greatest(n{i + 1} - n{i}, 0)" for i in range(3))}
                y = "CASE WHEN t <= 2 THEN NULL WHEN up + down = 0 THEN o ELSE up / (up + down) END"
                state = {f"{s}{i}": "0.0" for s in "pq" for i in range(4)} | {"o": "NULL::DOUBLE"}
                return self._turns(p, state, [new, gaps, {"o_": y}], "o_", {f"p{i}": f"q{i}" for i in range(4)} | {f"q{i}": f"n{i}" for i in range(4)} | {"o": "o_"})
            case v.ReFlex() | v.TrendFlex():
                slope = isinstance(view, v.ReFlex)
                c1, b1, c3 = kernels.flex_coefficients(w, slope)
                lets = [
                    {"b0": f"CASE WHEN len(b) >= {w} THEN b[2:] ELSE b END", "p1": "coalesce(x1, x)"},
                    {"y_": f"{c1!r} * (x + p1) / 2 + {b1!r} * coalesce(b0[-1], 0) + {c3!r} * coalesce(b0[-2], 0)"},
                    {"b_": "list_append(b0, y_)"},
                    {"sl": f"(b_[1] - y_) / {w}" if slope else "0.0"},
                    {"d": f"list_sum(list_transform(range(len(b_)), lambda i: y_ + i * sl - b_[len(b_) - i])) / {w}"},
                    {"s_": "0.04 * d * d + 0.96 * s"},
                    {"o_": f"CASE WHEN s_ > 0 THEN d / sqrt(s_) ELSE {'o' if slope else '0'} END"},
                ]
                return self._turns(p, {"b": "[]::DOUBLE[]", "x1": "NULL::DOUBLE", "s": "0.0", "o": "NULL::DOUBLE"}, lets, "o_", {"b": "b_", "x1": "x", "s": "s_", "o": "o_"})
            case v.PolarizedFractalEfficiency():
                a = self._new(f"SELECT *, sqrt(pow(x - lag(x) {plain}, 2) + 1) AS e, lag(x) {plain} AS x1, lag(x, {w - 1}) {plain} AS xw FROM {p}")
                b = self._new(f"SELECT k, id, n, sqrt(pow(x - xw, 2) + {w * w}) / sum(e) {last(w - 2)} * CASE WHEN x < x1 THEN -1 ELSE 1 END AS y, t FROM {a}")
                given = self._new(f"SELECT k, id, n, y FROM {b} WHERE t >= {w}")
                m = self.compile(view.smoother, given)
                return self._new(f"SELECT p.k, p.id, p.n, p.t, m.y FROM {p} p LEFT JOIN {m} m ON p.id = m.id")
            case v.EhlersFisher():
                a = self._new(f"SELECT *, min(x) {last(w)} AS lo, max(x) {last(w)} AS hi FROM {p}")
                given = self._new(f"SELECT k, id, n, 2 * ((x - lo) / (hi - lo) - 0.5) AS y FROM {a} WHERE hi > lo")
                m = self.compile(view.smoother, given)
                b = self._new(f"SELECT a.k, a.id, a.n, a.t, a.x, hi = lo AS flat, least(0.99, greatest(-0.99, m.y)) AS s, m.y IS NOT NULL AS has FROM {a} a LEFT JOIN {m} m ON a.id = m.id")
                f = "CASE WHEN flat THEN 0 WHEN NOT has THEN f ELSE 0.5 * ln((1 + s) / (1 - s)) + 0.5 * f END"
                return self._turns(b, {"f": "NULL::DOUBLE"}, [{"f_": f}], "f_", {"f": "f_"})
        raise TypeError(f"{type(view).__name__} has no SQL form")

    @staticmethod
    def _smoother(p: str, w: int):
        c1, c2, c3 = kernels.smoother_coefficients(w)
        return p, dict.fromkeys(("x1", "y1", "y2"), "0.0"), [{"y_": f"{c1!r} * (x + x1) / 2 + {c2!r} * y1 + {c3!r} * y2"}], f"CASE WHEN t >= {w} THEN y_ END", {"x1": "x", "y1": "y_", "y2": "y1"}

    def _turns(self, p: str, state: dict[str, str], lets: list[dict[str, str]], y: str, then: dict[str, str]) -> str:
        """A recursive table over the ticks p: layers of named values, the output and the next state."""
        kind = {s: "DOUBLE" for s in state} | {s: "DOUBLE[]" for s in state if e_list(state[s])}
        start = ", ".join(f"({e})::{kind[s]} AS z{s}" for s, e in state.items())
        inner = f"SELECT p.*, {', '.join(f'r.z{s} AS {s}' for s in state)} FROM r{len(self.parts)} r JOIN {p} p ON p.k = r.k AND p.t = r.t + 1"
        for layer in lets:
            inner = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM ({inner})"
        step = ", ".join(f"({then[s]})::{kind[s]}" for s in state)
        name = f"r{len(self.parts)}"
        self._add(
            name,
            f"SELECT DISTINCT k, NULL::BIGINT AS id, NULL::BIGINT AS n, 0::BIGINT AS t, NULL::DOUBLE AS y, {start} FROM {p} UNION ALL SELECT k, id, n, t, ({y})::DOUBLE, {step} FROM ({inner})",
        )
        return self._new(f"SELECT k, id, n, t, y FROM {name} WHERE t > 0")


def e_list(start: str) -> bool:
    return start.startswith("[")


