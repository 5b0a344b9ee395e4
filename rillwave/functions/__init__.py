"""Views by short names, for pipelines of calls: hl_normalizer(20, roc(15, ema(10)))."""

from rillwave.operators import views as _v

echo, constant, add, subtract, multiply, divide = _v.Echo, _v.Constant, _v.Add, _v.Subtract, _v.Multiply, _v.Divide
tanh, gte, lte, drawdown, ln_return, welford_rolling = _v.Tanh, _v.GTE, _v.LTE, _v.Drawdown, _v.LnReturn, _v.WelfordRolling
sma, ema, alma, lag, min_, max_, hl_normalizer = _v.Sma, _v.Ema, _v.Alma, _v.Lag, _v.Min, _v.Max, _v.HLNormalizer
cumulative, roc, welford_online, vst, vsct, binary_entropy = _v.Cumulative, _v.Roc, _v.WelfordOnline, _v.Vst, _v.Vsct, _v.BinaryEntropy
rsi, my_rsi, net, cti, center_of_gravity = _v.Rsi, _v.MyRSI, _v.NoiseElimination, _v.CorrelationTrend, _v.CenterOfGravity
cyber_cycle, pfe, fisher, laguerre_rsi, laguerre_filter = _v.CyberCycle, _v.PolarizedFractalEfficiency, _v.EhlersFisher, _v.LaguerreRSI, _v.LaguerreFilter
super_smoother, roofing, reflex, trendflex = _v.SuperSmoother, _v.RoofingFilter, _v.ReFlex, _v.TrendFlex
custom, expression = _v.Custom, _v.Expression
