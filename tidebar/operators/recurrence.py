"""Indicators with a recurrence: one pass over each symbol's bars in time order.

Bars are shuffled and sorted by symbol once; Python reads them as a stream of Arrow batches and keeps, per symbol, only
the state its indicators need. So memory is bounded by a batch however long a symbol's history is, and any number of
indicators share the shuffle (`compute_all`).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import series
from .indicators import SOURCES, add_hma, add_wma, indicator, settings
from .indicators import source as price_column


class Smooth:
    """y = a * x + (1 - a) * y, started by the mean of the first n values; null in, null out, state kept."""

    def __init__(self, n: int, a: float):
        self.n, self.a, self.seen, self.sum, self.y = n, a, 0, 0.0, None

    def __call__(self, x):
        if x is None:
            return None
        if self.y is not None:
            self.y = self.a * x + (1 - self.a) * self.y
            return self.y
        self.seen, self.sum = self.seen + 1, self.sum + x
        if self.seen == self.n:
            self.y = self.sum / self.n
        return self.y


def ema(n: int) -> Smooth:
    return Smooth(n, 2 / (n + 1))


def rma(n: int) -> Smooth:
    return Smooth(n, 1 / n)


class Recent:
    """The last n values, nulls included; a function of them once none is null."""

    def __init__(self, n: int, f: Callable):
        self.values, self.n, self.f = deque(maxlen=n), n, f

    def __call__(self, x):
        self.values.append(x)
        if len(self.values) < self.n or None in self.values:
            return None
        return self.f(self.values)


def mean(n: int) -> Recent:
    return Recent(n, lambda v: sum(v) / n)


def deviation(n: int) -> Recent:
    def f(v):
        m = sum(v) / n
        return math.sqrt(sum((x - m) ** 2 for x in v) / n)

    return Recent(n, f)


def line_end(n: int) -> Recent:
    """The last point of a least-squares line."""
    mid = (n - 1) / 2
    spread = sum((i - mid) ** 2 for i in range(n)) or 1.0

    def f(v):
        m = sum(v) / n
        return m + sum((i - mid) * (x - m) for i, x in enumerate(v)) / spread * mid

    return Recent(n, f)


class TrueRange:
    def __init__(self):
        self.close = None

    def __call__(self, bar):
        _, h, low, c, _ = bar
        out = h - low if self.close is None else max(h - low, abs(h - self.close), abs(low - self.close))
        self.close = c
        return out


class Lag:
    def __init__(self):
        self.last = None

    def __call__(self, x):
        out, self.last = self.last, x
        return out


def minus(a, b):
    return None if a is None or b is None else a - b


def over(a, b):
    return None if a is None or b is None or b == 0 else a / b


def price(name: str) -> Callable:
    return {"open": lambda b: b[0], "high": lambda b: b[1], "low": lambda b: b[2], "close": lambda b: b[3], "hl2": lambda b: (b[1] + b[2]) / 2, "hlc3": lambda b: (b[1] + b[2] + b[3]) / 3, "ohlc4": lambda b: (b[0] + b[1] + b[2] + b[3]) / 4}[name]


BAR = ("open", "high", "low", "close", "volume")


def streamed(df: DataFrame, parts: list[tuple[Callable, tuple[str, ...]]], columns: tuple[str, ...] = BAR) -> DataFrame:
    """df with the outputs of each (make, outputs): make() gives a fresh function of a row's columns for every symbol."""
    base = [c for c in df.columns if not any(c in outs for _, outs in parts)]
    outs = [o for _, names in parts for o in names]
    at = [base.index(c) for c in columns]
    key = base.index("symbol")

    def run(batches):
        symbol, fns = object(), []
        for b in batches:
            values = [b.column(i).to_pylist() for i in at]
            got = [[] for _ in outs]
            for name, *bar in zip(b.column(key).to_pylist(), *values):
                if name != symbol:
                    symbol, fns = name, [make() for make, _ in parts]
                i = 0
                for f in fns:
                    for v in f(bar):
                        got[i].append(v)
                        i += 1
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(g, pa.float64()) for g in got)], [*base, *outs])

    schema = T.StructType([df.schema[c] for c in base] + [T.StructField(o, T.DoubleType()) for o in outs])
    return df.select(*base).repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(run, schema)


MAKERS: dict[str, Callable] = {}


def recurrent(key: str, category: str, outputs: str, choices: dict | None = None, **defaults):
    def add(make):
        MAKERS[key] = make
        names = tuple(outputs.split())
        indicator(key, category, outputs, choices=choices, **defaults)(lambda df, **p: streamed(df, [(lambda: make(**p), names)]))
        return make

    return add


def compute_all(df: DataFrame, wanted: list[tuple[str, dict]], named: Callable[[str, str], str]) -> DataFrame:
    """df with the outputs of several recurrent indicators in one pass, called named(key, output)."""
    from .indicators import REGISTRY

    parts = []
    for key, given in wanted:
        p = settings(key, given)
        parts.append((lambda key=key, p=p: MAKERS[key](**p), tuple(named(key, o) for o in REGISTRY[key].outputs)))
    return streamed(df, parts)


def _ma(length, kind="ema", source="close"):
    f, x = (ema if kind == "ema" else rma)(length), price(source)
    return lambda bar: (f(x(bar)),)


MAKERS["ma"] = _ma


@indicator("ma", "trend", "value", choices={"source": SOURCES, "kind": ("sma", "ema", "wma", "hma", "rma")}, length=20, kind="ema", source="close")
def ma(df, length, kind, source):
    """Moving averages: sma, wma and hma as windows, ema and rma in the recurrence pass."""
    if kind in ("ema", "rma"):
        return streamed(df, [(lambda: _ma(length, kind, source), ("value",))])
    df = df.withColumn("_x", price_column(source))
    return df.withColumn("value", series.sma("_x", length)) if kind == "sma" else (add_wma if kind == "wma" else add_hma)(df, "_x", length, "value")


@recurrent("dema", "trend", "value", length=20)
def dema(length):
    a, b = ema(length), ema(length)

    def f(bar):
        y = a(bar[3])
        z = b(y)
        return (None if z is None else 2 * y - z,)

    return f


@recurrent("tema", "trend", "value", length=20)
def tema(length):
    a, b, c = ema(length), ema(length), ema(length)

    def f(bar):
        x = a(bar[3])
        y = b(x)
        z = c(y)
        return (None if z is None else 3 * x - 3 * y + z,)

    return f


@recurrent("macd", "trend", "macd signal hist", fast=12, slow=26, signal=9)
def macd(fast, slow, signal):
    a, b, c = ema(fast), ema(slow), ema(signal)

    def f(bar):
        m = minus(a(bar[3]), b(bar[3]))
        sig = c(m)
        return m, sig, minus(m, sig)

    return f


@recurrent("adx", "trend", "adx plus_di minus_di", length=14, smoothing=14)
def adx(length, smoothing):
    tr, a, p, m, d = TrueRange(), rma(length), rma(length), rma(length), rma(smoothing)
    last: list = []

    def f(bar):
        up, down = (bar[1] - last[0], last[1] - bar[2]) if last else (0.0, 0.0)
        last[:] = [bar[1], bar[2]]
        atr = a(tr(bar))
        plus, minus_ = over(p(up if up > down and up > 0 else 0.0), atr), over(m(down if down > up and down > 0 else 0.0), atr)
        both = None if plus is None or minus_ is None else plus + minus_
        times = lambda v: None if v is None else 100 * v
        return d(None if not both else 100 * abs(plus - minus_) / both), times(plus), times(minus_)

    return f


@recurrent("rsi", "momentum", "rsi", length=14)
def rsi(length):
    step = rsi_steps(length)
    return lambda bar: (step(bar[3]),)


def rsi_steps(length):
    last, up, down = Lag(), rma(length), rma(length)

    def f(close):
        d = minus(close, last(close))
        gain, loss = (up(max(d, 0.0)), down(max(-d, 0.0))) if d is not None else (None, None)
        if loss is None:
            return None
        return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)

    return f


@recurrent("stochrsi", "momentum", "k d", length=14, stoch=14, smooth_k=3, smooth_d=3)
def stochrsi(length, stoch, smooth_k, smooth_d):
    r, low, high, a, b = rsi_steps(length), Recent(stoch, min), Recent(stoch, max), mean(smooth_k), mean(smooth_d)

    def f(bar):
        x = r(bar[3])
        lo, hi = low(x), high(x)
        y = over(minus(x, lo), minus(hi, lo))
        k = a(None if y is None else 100 * y)
        return k, b(k)

    return f


@recurrent("tsi", "momentum", "tsi signal", slow=25, fast=13, signal=13)
def tsi(slow, fast, signal):
    last, a, b, c, d, s = Lag(), ema(slow), ema(fast), ema(slow), ema(fast), ema(signal)

    def f(bar):
        x = minus(bar[3], last(bar[3]))
        t = over(b(a(x)), d(c(None if x is None else abs(x))))
        t = None if t is None else 100 * t
        return t, s(t)

    return f


@recurrent("fisher", "momentum", "fisher trigger", {"source": SOURCES}, length=9, source="hl2")
def fisher(length, source):
    x, low, high, last = price(source), Recent(length, min), Recent(length, max), Lag()
    state = [0.0, 0.0]

    def f(bar):
        v = x(bar)
        lo, hi = low(v), high(v)
        raw, out = over(minus(v, lo), minus(hi, lo)), None
        if raw is not None:
            y = min(0.999, max(-0.999, 0.33 * 2 * (raw - 0.5) + 0.67 * state[0]))
            state[:] = [y, 0.5 * math.log((1 + y) / (1 - y)) + 0.5 * state[1]]
            out = state[1]
        return out, last(out)

    return f


@recurrent("atr", "volatility", "atr", length=14)
def atr(length):
    tr, a = TrueRange(), rma(length)
    return lambda bar: (a(tr(bar)),)


@recurrent("keltner", "volatility", "upper middle lower", length=20, atr_length=10, mult=2.0)
def keltner(length, atr_length, mult):
    e, tr, a = ema(length), TrueRange(), rma(atr_length)

    def f(bar):
        m, w = e(bar[3]), a(tr(bar))
        return (None, m, None) if m is None or w is None else (m + mult * w, m, m - mult * w)

    return f


@recurrent("squeeze", "volatility", "momentum squeeze_on", bb_length=20, bb_mult=2.0, kc_length=20, kc_mult=1.5)
def squeeze(bb_length, bb_mult, kc_length, kc_mult):
    sd, mid, e, tr, a = deviation(bb_length), mean(bb_length), ema(kc_length), TrueRange(), rma(kc_length)
    high, low, base, line = Recent(kc_length, max), Recent(kc_length, min), mean(kc_length), line_end(kc_length)

    def f(bar):
        c = bar[3]
        s, m, k, w = sd(c), mid(c), e(c), a(tr(bar))
        on = None
        if s is not None and w is not None:
            on = float(m + bb_mult * s < k + kc_mult * w and m - bb_mult * s > k - kc_mult * w)
        h, lo, b = high(bar[1]), low(bar[2]), base(c)
        return line(None if b is None else c - ((h + lo) / 2 + b) / 2), on

    return f


@recurrent("supertrend", "trend", "value direction", length=10, mult=3.0)
def supertrend(length, mult):
    tr, a, state = TrueRange(), rma(length), {}

    def f(bar):
        _, h, low, c, _ = bar
        w = a(tr(bar))
        if w is None:
            return None, None
        up, down = (h + low) / 2 + mult * w, (h + low) / 2 - mult * w
        if not state:
            state.update(up=up, down=down, way=1.0)
        else:
            pu, pd, pc = state["up"], state["down"], state["close"]
            way = 1.0 if c > pu else -1.0 if c < pd else state["way"]
            state.update(up=up if up < pu or pc > pu else pu, down=down if down > pd or pc < pd else pd, way=way)
        state["close"] = c
        return (state["down"] if state["way"] == 1.0 else state["up"]), state["way"]

    return f


@recurrent("psar", "trend", "value", step=0.02, max_step=0.2)
def psar(step, max_step):
    """The stop of a bar never passes the two bars before it; it flips when the bar does."""
    bars: deque = deque(maxlen=2)
    s: dict = {}

    def f(bar):
        h, low = bar[1], bar[2]
        if not bars:
            bars.append((h, low))
            return (None,)
        if not s:
            up = h >= bars[-1][0]
            s.update(up=up, sar=bars[-1][1] if up else bars[-1][0], far=h if up else low, af=step)
        sar = s["sar"] + s["af"] * (s["far"] - s["sar"])
        sar = min(sar, *(b[1] for b in bars)) if s["up"] else max(sar, *(b[0] for b in bars))
        broken = low < sar if s["up"] else h > sar
        if broken:
            s.update(up=not s["up"], sar=s["far"], far=low if s["up"] else h, af=step)
        else:
            further = h > s["far"] if s["up"] else low < s["far"]
            s.update(sar=sar, **({"far": h if s["up"] else low, "af": min(s["af"] + step, max_step)} if further else {}))
        bars.append((h, low))
        return (s["sar"],)

    return f
