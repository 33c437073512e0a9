"""Ordered folds: computation that is sequential within a key and parallel over keys.

``fold`` runs a step function over each key's rows in order. Rows are dealt by key and
sorted, and reach the step in Arrow batches with the state carried from batch to batch, so
no key is ever held whole; the same step runs on unbounded input in ``streaming.keyed``.
A step takes (state, row) and returns (outputs, state); ``start`` makes the state of a new
key. Steps work on plain floats in a fixed order of operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[Any, tuple], tuple[tuple, Any]]
NAN = float("nan")
KINDS = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def columns_of(outputs: str) -> list[tuple[str, pa.DataType]]:
    """(name, Arrow type) of ``name type, name type``."""
    return [(n, KINDS[k]) for n, k in (c.split() for c in outputs.split(", "))]


def inputs_of(columns: Sequence[pa.Array]):
    """Rows of plain values; a missing number is NaN."""
    lists = []
    for c in columns:
        values = c.to_pylist()
        lists.append([NAN if v is None else v for v in values] if c.null_count and not pa.types.is_string(c.type) else values)
    return zip(*lists)


def outputs_to(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> list[pa.Array]:
    """Arrow columns of the steps' outputs; NaN becomes NULL."""
    by_name = list(zip(*rows)) if rows else [()] * len(columns)
    return [pa.array(v, k, from_pandas=True) for v, (_, k) in zip(by_name, columns)]


def fold(
    df: DataFrame, key: list[str], order: list[str], inputs: list[str], step: Step, start: Callable[[], Any], outputs: str, keep: list[str] | None = None,
    skip_first: bool = False, stop: int | None = None, done: str | None = None,
) -> DataFrame:
    """One output row per input row: ``keep`` columns and the step's outputs.

    skip_first seeds the state with the first row and does not give it out; stop ends
    after so many rows of each key; ``done`` names a boolean output after whose first true
    row a key ends. Missing numbers reach the step as NaN, and NaN outputs become NULL.
    """
    keep = list(dict.fromkeys([*key, *order, *(keep or [])]))
    need = list(dict.fromkeys([*keep, *inputs]))
    # by a hash of the key: after a join on the key itself Spark would drop this exchange, and then split a key's rows or read them by mapper
    rows = df.select(*need).repartition(F.xxhash64(*key)).sortWithinPartitions(*key, *order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields] + [outputs])
    made = columns_of(outputs)
    ends = [n for n, _ in made].index(done) if done else None
    most = math.inf if stop is None else stop + skip_first

    def run(batches):
        now, state, seen, over = object(), None, 0, False
        for batch in batches:
            keys = zip(*(batch.column(need.index(c)).to_pylist() for c in key))
            out, at = [], []
            for j, (k, row) in enumerate(zip(keys, inputs_of([batch.column(need.index(c)) for c in inputs]))):
                if k != now:
                    now, state, seen, over = k, start(), 0, False
                if over or seen >= most:
                    continue
                y, state = step(state, row)
                seen += 1
                over = ends is not None and bool(y[ends])
                if not (skip_first and seen == 1):
                    out.append(y)
                    at.append(j)
            kept = batch.select(keep)
            kept = kept if len(at) == batch.num_rows else kept.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *outputs_to(out, made)], [*keep, *(n for n, _ in made)])

    return rows.mapInArrow(run, schema)


def final_state(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, pre-aggregated."""
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*key).agg(last.alias("_s")).select("_s.*")


def nested(step: Step, start: Callable[[], Any]) -> Step:
    """A step whose row is one array: it folds the inner step over the array from a new state and gives the inner outputs as arrays."""

    def outer(state, row):
        inner, out = start(), []
        for v in row[0]:
            y, inner = step(inner, (NAN if v is None else v,))
            out.append(y)
        return tuple(map(list, zip(*out))), state

    return outer


def piped(*steps: tuple[Step, Callable]) -> tuple[Step, Callable]:
    """Steps fed forward: each gets the outputs of the one before as its row; the last one's outputs are given."""

    def step(states, row):
        after = []
        for (inner, _), state in zip(steps, states):
            row, state = inner(state, row)
            after.append(state)
        return row, tuple(after)

    return step, lambda: tuple(start() for _, start in steps)


# ---- exponentially weighted mean as a step: warm starts, streams, and every option ---------------


def ewma_start(initial: float = NAN) -> Callable[[], tuple]:
    return lambda: (float(initial), 1.0, 0)


def ewma_step(*, alpha: float | None = None, com: float | None = None, adjust: bool | str = True, ignore_na: bool = False, min_periods: int = 0) -> Step:
    """State: (mean, weight, observations).

    An observation moves the mean towards it by new / (old weight + new); the old weight
    is what ``aged`` leaves of it. Before the first observation there is nothing to age.
    """
    com = 1 / alpha - 1 if com is None else com
    aged = _linear_age(com) if adjust == "linear" else _even_age(com / (1 + com))
    new = 1.0 if adjust else 1 / (1 + com)

    def step(state, row):
        mean, weight, n = state
        x = float(row[0])
        old = 0.0 if mean != mean else aged(weight, x == x, ignore_na)
        if x != x:
            return (mean if n >= min_periods else NAN,), (mean, old, n)
        mean = x if mean != mean else (old * mean + new * x) / (old + new)
        return (mean if n + 1 >= min_periods else NAN,), (mean, old + new if adjust else 1.0, n + 1)

    return step


def _even_age(decay: float):
    return lambda weight, seen, ignore_na: weight if ignore_na and not seen else weight * decay


def _linear_age(com: float):
    """Weights grow by one per observation up to com; a missing row takes one of them away."""

    def aged(weight: float, seen: bool, ignore_na: bool) -> float:
        within = min(weight, com)
        if seen or ignore_na or weight <= 0:
            return within if seen or ignore_na else 0.0
        return within * max(0.0, (weight - 1) / weight)

    return aged


# ---- recursive filters ---------------------------------------------------------------------------


def arma(alpha: list[float], beta: list[float]) -> tuple[Step, Callable]:
    """y = noise + beta . last noise + alpha . last y, added from left to right; both buffers oldest first, starting at zero."""
    a, b = [float(v) for v in alpha], [float(v) for v in beta]

    def step(state, row):
        ys, es = state
        e = y = float(row[0])
        for w, v in zip(b, es):
            y += w * v
        for w, v in zip(a, ys):
            y += w * v
        return (y,), (((*ys[1:], y if math.isfinite(y) else 0.0) if a else ()), (*es[1:], e) if b else ())

    return step, lambda: ((0.0,) * len(a), (0.0,) * len(b))


# ---- optimisers: (state of n parameters, update(state, gradient) -> (change, state)) --------------------


def sgd(rate: float):
    return (lambda n: None), (lambda s, g: ([-rate * v for v in g], s))


def adagrad(rate: float, eps: float = 1e-7, start: float = 0.1):
    def update(s, g):
        s = [a + v * v for a, v in zip(s, g)]
        return [-rate * v / math.sqrt(a + eps) for a, v in zip(s, g)], s

    return (lambda n: [start] * n), update


def rmsprop(rate: float, decay: float = 0.9, eps: float = 1e-8):
    def update(s, g):
        s = [decay * a + (1 - decay) * v * v for a, v in zip(s, g)]
        return [-rate * v / math.sqrt(a + eps) for a, v in zip(s, g)], s

    return (lambda n: [0.0] * n), update


def adam(rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
    def update(s, g):
        m, v, t = [b1 * a + (1 - b1) * x for a, x in zip(s[0], g)], [b2 * a + (1 - b2) * x * x for a, x in zip(s[1], g)], s[2] + 1
        p, q = 1 - b1**t, 1 - b2**t
        return [-rate * (a / p) / (math.sqrt(b / q) + eps) for a, b in zip(m, v)], (m, v, t)

    return (lambda n: ([0.0] * n, [0.0] * n, 0)), update


def newton(rate: float, eps: float = 1e-5):
    """The inverse Hessian starts at I / eps and gains each gradient's outer product by a rank-one update."""

    def update(h, g):
        n = range(len(g))
        hg = [_dot(h[i], g) for i in n]
        scale = 1 + _dot(g, hg)
        h = [[h[i][j] - hg[i] * hg[j] / scale for j in n] for i in n]
        return [-rate * _dot(h[i], g) for i in n], h

    return (lambda n: [[1 / eps if i == j else 0.0 for j in range(n)] for i in range(n)]), update


def _dot(a: Sequence[float], b: Sequence[float]) -> float:
    """From left to right, without a leading zero."""
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total += x * y
    return total


def finite(x: float) -> float:
    return x if math.isfinite(x) else 0.0


# ---- online learners ----------------------------------------------------------------------------------


def online_regression(n: int, optimiser, project: Callable | None = None, ridge: float = 0.0, frozen: tuple[int, ...] = ()) -> tuple[Step, Callable]:
    """Linear model of n inputs and a constant, squared loss; predicts before it learns. Weights start at zero.

    Outputs: prediction, loss, and the weights after the update. Rows: n inputs, then the
    target. ``frozen`` parameters are never changed; ``project`` maps the weights after each update.
    """
    begin, update = optimiser

    def step(state, row):
        w, s = state
        x = [finite(float(v)) for v in row[:n]] + [1.0]
        y = float(row[n])
        guess = _dot(w, x)
        miss = y - guess
        loss = miss * miss + ridge * _dot(w, w) if ridge else miss * miss
        g = [finite(-2 * miss * v + 2 * ridge * u if ridge else -2 * miss * v) for v, u in zip(x, w)]
        g = [0.0 if k in frozen else v for k, v in enumerate(g)]
        d, s = update(s, g)
        w = [u if k in frozen else u + v for k, (u, v) in enumerate(zip(w, d))]
        if project is not None:
            w = list(project(w))
        return (guess, loss, *w), (w, s)

    return step, lambda: ([0.0] * (n + 1), begin(n + 1))


class Dual:
    """A value with its derivatives by some parameters: forward differentiation of plain arithmetic."""

    __slots__ = ("x", "d")

    def __init__(self, x: float, d: Sequence[float]):
        self.x, self.d = x, tuple(d)

    def _of(self, other) -> Dual:
        return other if isinstance(other, Dual) else Dual(float(other), (0.0,) * len(self.d))

    def _by(self, x: float, slope: float) -> Dual:
        return Dual(x, (slope * a for a in self.d))

    def __neg__(self):
        return self._by(-self.x, -1.0)

    def __abs__(self):
        return -self if self.x < 0 else self

    def __add__(self, other):
        o = self._of(other)
        return Dual(self.x + o.x, (a + b for a, b in zip(self.d, o.d)))

    def __sub__(self, other):
        o = self._of(other)
        return Dual(self.x - o.x, (a - b for a, b in zip(self.d, o.d)))

    def __mul__(self, other):
        o = self._of(other)
        return Dual(self.x * o.x, (self.x * b + a * o.x for a, b in zip(self.d, o.d)))

    def __truediv__(self, other):
        o = self._of(other)
        q = self.x / o.x
        return Dual(q, ((a - q * b) / o.x for a, b in zip(self.d, o.d)))

    def __pow__(self, k: float):
        return self._by(self.x**k, k * self.x ** (k - 1))

    def __rsub__(self, other):
        return self._of(other) - self

    def __rtruediv__(self, other):
        return self._of(other) / self

    def __lt__(self, other):
        return self.x < self._of(other).x

    def __gt__(self, other):
        return self.x > self._of(other).x

    __radd__, __rmul__ = __add__, __mul__

    def exp(self):
        return self._by(math.exp(self.x), math.exp(self.x))

    def log(self):
        return self._by(math.log(self.x), 1 / self.x)

    def tanh(self):
        t = math.tanh(self.x)
        return self._by(t, 1 - t * t)


def value_and_gradient(func: Callable, params: Sequence[float], *args) -> tuple[float, tuple, list[float]]:
    """(loss, what ``func`` gives beside it, gradient); func(params, *args) gives a loss or (loss, *more)."""
    n = len(params)
    got = func([Dual(p, (float(i == k) for k in range(n))) for i, p in enumerate(params)], *args)
    loss, *more = got if isinstance(got, tuple) else (got,)
    plain = tuple(m.x if isinstance(m, Dual) else m for m in more)
    return (loss.x, plain, list(loss.d)) if isinstance(loss, Dual) else (float(loss), plain, [0.0] * n)


def func_optimiser(func: Callable, first: Sequence[float], optimiser, project: Callable | None = None, trainable: Callable[[int], bool] | None = None) -> tuple[Step, Callable]:
    """Minimise func(params, *row) online, whatever the function, by its exact gradient.

    Outputs: loss, what the function gives beside it, and the updated parameters.
    Gradients that are not finite count as zero; parameters for which ``trainable`` is
    false stay; ``project`` maps the parameters after each update.
    """
    begin, update = optimiser
    free = [trainable is None or trainable(k) for k in range(len(first))]

    def step(state, row):
        params, s = state
        loss, more, gradient = value_and_gradient(func, params, *row)
        change, s = update(s, [finite(g) if f else 0.0 for g, f in zip(gradient, free)])
        params = [p + c if f else p for p, c, f in zip(params, change, free)]
        if project is not None:
            params = list(project(params))
        return (loss, *more, *params), (params, s)

    return step, lambda: ([float(p) for p in first], begin(len(first)))


def with_params(model: Callable, params: Sequence[float]) -> Callable:
    """``model(params, *row)`` with its parameters injected: the model evaluated, not trained."""
    return lambda *row: model(list(params), *row)


def scale_optimiser(rate: float, optimiser=None) -> tuple[Step, Callable]:
    """Learns one factor on a model's output, from one; rows: output, target. Outputs: scaled output, factor after."""
    begin, update = optimiser or sgd(rate)

    def step(state, row):
        scale, s = state
        out, target = float(row[0]), float(row[1])
        y = scale * out
        (change,), s = update(s, [2 * (y - target) * out])
        return (y, scale + change), (scale + change, s)

    return step, lambda: (1.0, begin(1))


def predictor(parts: list[tuple[float, float]], rate: float, optimiser=None) -> tuple[Step, Callable]:
    """The mean of smoothed inputs, each by its (alpha, factor), scaled online towards the target.

    Rows: the inputs, then the target. Outputs: prediction, factor after, the parts.
    """
    smooth = [ewma_step(alpha=alpha) for alpha, _ in parts]
    learn, begin = scale_optimiser(rate, optimiser)

    def step(state, row):
        means, inner = state
        after, values = [], []
        for mean, each, (_, factor), x in zip(means, smooth, parts, row):
            (y,), mean = each(mean, (x,))
            after.append(mean)
            values.append(y * factor)
        total = values[0]
        for v in values[1:]:
            total += v
        (guess, scale), inner = learn(inner, (total / len(values), row[-1]))
        return (guess, scale, *values), (after, inner)

    return step, lambda: ([ewma_start()() for _ in parts], begin())


def snarimax_features(p: int, q: int, regressor: Callable, n_x: int = 0, d: int = 0, sp: int = 0, sd: int = 0, sq: int = 0) -> tuple[Step, Callable]:
    """Features [extra inputs, last q errors, last p values with the present one], missing ones zero; regressor(features) is the estimate.

    Rows: y, then the extra inputs. Outputs: estimate, error, then the features. Differencing and seasons are not part of it.
    """
    if d or sp or sd or sq:
        raise NotImplementedError("differencing and seasonal terms")

    def step(state, row):
        errors, values = state
        y = float(row[0])
        values = (*values, y)[-p:] if p else ()
        features = [finite(float(v)) for v in (*row[1 : 1 + n_x], *errors, *values)]
        guess = float(regressor(features))
        return (guess, y - guess, *features), ((*errors, y - guess)[-q:] if q else (), values)

    return step, lambda: ((0.0,) * q, (0.0,) * p)


def snarimax(p: int, q: int, n_x: int, optimiser, d: int = 0, sp: int = 0, sd: int = 0, sq: int = 0) -> tuple[Step, Callable]:
    """Forecasts y from extra inputs, the last q errors and the p values before it; a linear model that learns after predicting.

    Rows: y, then the extra inputs. Outputs: prediction, error.
    """
    if d or sp or sd or sq:
        raise NotImplementedError("differencing and seasonal terms")
    learn, begin = online_regression(n_x + q + p, optimiser)

    def step(state, row):
        inner, errors, values = state
        y = float(row[0])
        (guess, *_), inner = learn(inner, (*row[1 : 1 + n_x], *errors, *values, y))
        return (guess, y - guess), (inner, (*errors, y - guess)[-q:] if q else (), (*values, y)[-p:] if p else ())

    return step, lambda: (begin(), (0.0,) * q, (0.0,) * p)


# ---- feedback loops, state machines, triggers ------------------------------------------------------


def feedback(agent: Callable, env: Callable, first_action: float | None = None, callbacks: Sequence[Callable] = ()) -> tuple[Step, Callable]:
    """env(action before, raw) -> (reward, observation[, done]); agent(observation) -> action. Outputs: reward, observation, action[, done].

    The first action is ``first_action``, or the agent's answer to the first raw row. The
    first row only starts the loop where rows are folded with skip_first. Each callback is
    called with (reward, observation, action) after every step and may return a value,
    which becomes a further output.
    """

    def step(action, row):
        raw = float(row[0])
        if action is None:
            action = agent(raw) if first_action is None else first_action
            reward, obs, more = NAN, raw, [False] * ends
        else:
            reward, obs, *more = env(action, raw)
            action = agent(obs)
        said = [c(reward, obs, action) for c in callbacks]
        return (reward, obs, action, *more, *(v for v in said if v is not None)), action

    ends = 1 if getattr(env, "ends", False) else 0
    return step, lambda: None


class RegressionEnv:
    """An agent's guesses of y = sign * (slope * x + level) + noise; the sign turns after ``flip`` rows, rewards come one row late."""

    def __init__(self, slope: float, level: float, flip: int):
        self.slope, self.level, self.flip = slope, level, flip

    def __call__(self, state: tuple[int, float], guess: float, x: float, noise: float) -> tuple[float, float, tuple[int, float]]:
        """(reward of the guess before, target, state)"""
        n, late = state
        target = (1.0 if n < self.flip else -1.0) * (self.slope * x + self.level) + noise
        miss = target - guess
        return late, target, (n + 1, -(miss * miss))


def regression_game(env: RegressionEnv, optimiser) -> tuple[Step, Callable]:
    """An online learner in a ``RegressionEnv``. Rows: x, noise. Outputs: guess, target, reward, regret (squared misses beyond the noise's)."""
    learn, begin = online_regression(1, optimiser)

    def step(state, row):
        inner, world, regret = state
        x, noise = float(row[0]), float(row[1])
        guess = _dot(inner[0], [x, 1.0])
        reward, target, world = env(world, guess, x, noise)
        _, inner = learn(inner, (x, target))
        regret = regret + (-world[1] - noise * noise)
        return (guess, target, reward, regret), (inner, world, regret)

    return step, lambda: (begin(), (0, 0.0), 0.0)


def state_machine(states: dict[str, Callable[[float], float]], moves: list[tuple[str, str, Callable[[float], bool]]], first: str) -> tuple[Step, Callable]:
    """Run the present state's function, then the first move (from, to, test) that applies. Outputs: y, next state."""

    def step(state, row):
        x = float(row[0])
        y = states[state](x)
        after = next((to for start, to, test in moves if start == state and test(x)), state)
        return (y, after), after

    return step, lambda: first


def change_detector(tolerance: float) -> tuple[Step, Callable]:
    """True where the value has moved by more than the tolerance since it last was true; the first row is true."""

    def step(last, row):
        x = float(row[0])
        fired = last is None or abs(x - last) > tolerance
        return (fired,), x if fired else last

    return step, lambda: None
