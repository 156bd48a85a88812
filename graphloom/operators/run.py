"""Whole runs: schedules, monitors, timers, flat and layered embedding. The driver holds scalars only."""

from __future__ import annotations

import math
import time
from collections import deque
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.random import uniform
from graphloom.operators.coarsen import Layer, expand, hierarchy
from graphloom.operators.graph import Graph
from graphloom.operators.pairs import nest
from graphloom.operators.step import Forces, adam, degree_weights, displacement, forces, ordered_sums, recentred, rescaled, simple, unit_weights
from graphloom.session import cut


@dataclass(frozen=True)
class Options:
    dimension: int = 4
    unit_weights: bool = False
    dimension_hint: float = -1
    layered: bool = False
    attraction: float = 1.0
    repulsion: float = 1.0
    centre: float = 0.0
    edge_length: float = 1.0
    expansion_stretch: float = 1.0
    jitter: float = 0.0
    optimizer: str = "adam"
    max_iterations: int = 10_000
    simple_max_displacement: float = 1.0
    lr_schedule: str = "exponential"
    learning_rate: float = 10.0
    warmup_steps: int = 20
    lr_cooling: float = 0.995
    lr_decay_factor: float = 0.5
    lr_decay_threshold: float = 1e-2
    lr_adapt_patience: int = 20
    lr_growth_factor: float = 1.0
    lr_growth_threshold: float = 1e-1
    stop: str = "loss"
    stop_displacement_tol: float = 3e-4
    stop_displacement_patience: int = 5
    loss_smoothing: float = 0.3
    loss_rate_window: int = 30
    stop_loss_tol: float = 1e-3
    stop_loss_patience: int = 50
    negative_samples: int = -1
    index_size: float = 1.0
    additive_weights: bool = False
    seed: int = 0


class LossMonitor:
    """Smoothed loss, its rate over a window, and how long that has stayed below a tolerance."""

    def __init__(self, tol: float, patience: int, smoothing: float, window: int):
        self.tol, self.patience, self.smoothing = tol, patience, smoothing
        self.window = max(1, window)
        self.history: deque[float] = deque(maxlen=self.window + 1)
        self.smoothed: float | None = None
        self.rate, self.count = math.inf, 0

    def observe(self, loss: float) -> None:
        self.smoothed = loss if self.smoothed is None else self.smoothing * loss + (1 - self.smoothing) * self.smoothed
        self.history.append(self.smoothed)
        if len(self.history) > self.window:
            old = self.history[0]
            self.rate = (old - self.smoothed) / max(abs(old), 1e-12)
        self.count = self.count + 1 if self.rate < self.tol else 0

    @property
    def converged(self) -> bool:
        return self.count >= self.patience


class DisplacementMonitor:
    def __init__(self, tol: float, patience: int):
        self.tol, self.patience, self.count = tol, patience, 0

    def observe(self, ratio: float) -> None:
        self.count = self.count + 1 if ratio < self.tol else 0

    @property
    def converged(self) -> bool:
        return self.count >= self.patience


class Schedule:
    """Learning rate at step t from 1: warm-up times exponential cooling, or adapted to the loss rate."""

    def __init__(self, o: Options, monitor: LossMonitor):
        self.o, self.monitor = o, monitor
        self.rate, self.grow, self.decay = o.learning_rate, 0, 0

    def at(self, t: int) -> float:
        o = self.o
        if o.lr_schedule == "exponential":
            lr = o.learning_rate * o.lr_cooling**t
        else:
            self._adapt()
            lr = self.rate
        return lr * t / o.warmup_steps if t < o.warmup_steps else lr

    def _adapt(self) -> None:
        o, rate = self.o, self.monitor.rate  # the rate of the step before
        self.grow = self.grow + 1 if rate > o.lr_growth_threshold else 0
        self.decay = self.decay + 1 if rate < o.lr_decay_threshold else 0
        if self.grow >= o.lr_adapt_patience:
            self.rate, self.grow = self.rate * o.lr_growth_factor, 0
        if self.decay >= o.lr_adapt_patience:
            self.rate, self.decay = self.rate * o.lr_decay_factor, 0


class Timer:
    """A tree of named phases with their total seconds, keyed by path."""

    def __init__(self) -> None:
        self.seconds: dict[tuple[str, ...], float] = {}
        self.path: tuple[str, ...] = ()

    @contextmanager
    def phase(self, name: str):
        self.path = (*self.path, name)
        here, began = self.path, time.perf_counter()
        self.seconds.setdefault(here, 0.0)
        try:
            yield
        finally:
            self.seconds[here] += time.perf_counter() - began
            self.path = here[:-1]

    def rows(self) -> list[tuple[int, str, float]]:
        """(depth, name, seconds) in preorder."""
        out: list[tuple[int, str, float]] = []

        def walk(top: tuple[str, ...]) -> None:
            for path in list(self.seconds):
                if path[:-1] == top:
                    out.append((len(path) - 1, path[-1], self.seconds[path]))
                    walk(path)

        walk(())
        return out

    def text(self) -> str:
        return "\n".join(f"{'   ' * depth}+- {seconds:<15.4g}{name}" for depth, name, seconds in self.rows())


TRACE = "iteration int, elapsed_ms double, num_vertices int, loss_attract double, loss_repel double, loss_total double, learning_rate double, rel_displacement double, rel_loss_improvement double"


@dataclass
class Embedder:
    """Step by step over one graph; state is a checkpointed table (id, p*, m*, v*, w)."""

    graph: Graph
    options: Options = field(default_factory=Options)
    positions: DataFrame | None = None
    weights: DataFrame | None = None

    def __post_init__(self) -> None:
        o, d = self.options, self.options.dimension
        self.graph = Graph(cut(self.graph.nodes), cut(self.graph.edges))
        self.n = self.graph.n
        self.timer, self.trace, self.iteration, self.began = Timer(), [], 0, time.perf_counter()
        self.loss_monitor = LossMonitor(o.stop_loss_tol, o.stop_loss_patience, o.loss_smoothing, o.loss_rate_window)
        self.move_monitor = DisplacementMonitor(o.stop_displacement_tol, o.stop_displacement_patience)
        self.schedule = Schedule(o, self.loss_monitor)
        self.loss = (0.0, 0.0)
        if self.weights is None:
            self.weights = unit_weights(self.graph) if o.unit_weights else rescaled(degree_weights(self.graph), d, o.dimension_hint)
        p = random_positions(self.graph, d, o.seed, self.n) if self.positions is None else self.positions
        zero = [F.lit(0.0).alias(f"{c}{k}") for c in "mv" for k in range(d)]
        self.state = cut(self.graph.nodes.select("id").join(p, "id").join(self.weights, "id").select("id", *[f"p{k}" for k in range(d)], "w", *zero))

    def _points(self, state: DataFrame) -> DataFrame:
        return state.select("id", *[f"p{k}" for k in range(self.options.dimension)], "w")

    def step(self) -> None:
        if self.n <= 1:
            return
        o, d = self.options, self.options.dimension
        self.iteration += 1
        before = self.state
        f = Forces(o.attraction, o.repulsion, o.centre, o.edge_length, o.additive_weights, o.negative_samples, o.index_size, o.seed, self.iteration)
        lr = self.schedule.at(self.iteration)
        with self.timer.phase("forces"):
            acting = cut(forces(self.graph, self._points(before), f))
        with self.timer.phase("update"):
            joined = before.join(acting.drop("attract", "repel"), "id")
            moved = adam(joined, d, lr, self.iteration) if o.optimizer == "adam" else simple(joined, d, lr, o.simple_max_displacement)
            moved = cut(moved.select(before.columns))
            # literals for the centroid: the next plan stays narrow
            self.state = cut(recentred(moved))
        with self.timer.phase("observe"):
            _, total = ordered_sums(acting, ["attract", "repel"])
            ratio = displacement(self._points(before), self._points(self.state)).first().ratio
        self.loss = (total["attract"], total["repel"])
        self.move_monitor.observe(ratio)
        self.loss_monitor.observe(sum(self.loss))
        self.trace.append((self.iteration, (time.perf_counter() - self.began) * 1000, self.n, *self.loss, sum(self.loss), lr, ratio, self.loss_monitor.rate))

    @property
    def finished(self) -> bool:
        o = self.options
        stop = self.loss_monitor if o.stop == "loss" else self.move_monitor
        return self.n <= 1 or self.iteration >= o.max_iterations or stop.converged

    def run(self) -> DataFrame:
        with self.timer.phase("embedding"):
            while not self.finished:
                self.step()
        return self.coordinates()

    def coordinates(self) -> DataFrame:
        return nest(self._points(self.state))

    def reset(self) -> None:
        """Moments back to zero."""
        d = self.options.dimension
        keep = [c for c in self.state.columns if not (c[:1] in "mv" and c[1:].isdigit())]
        self.state = cut(self.state.select(*keep, *[F.lit(0.0).alias(f"{c}{k}") for c in "mv" for k in range(d)]))

    def trace_table(self) -> DataFrame:
        return self.graph.nodes.sparkSession.createDataFrame(self.trace, TRACE)


@dataclass
class LayeredEmbedder:
    """From the coarsest layer down; a fresh embedder on each."""

    graph: Graph
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        self.layers: list[Layer] = hierarchy(self.graph)
        self.level = len(self.layers) - 1
        self.embedder = Embedder(self.layers[-1].graph, self.options)
        self.trace: list[tuple] = []

    @property
    def finished(self) -> bool:
        return self.level == 0 and self.embedder.finished

    def step(self) -> None:
        if not self.embedder.finished:
            self.embedder.step()
            return
        self.trace += self.embedder.trace
        fine, o = self.layers[self.level - 1], self.options
        placed = expand(fine.parents, self.embedder._points(self.embedder.state), fine.graph.n, self.embedder.n, o.expansion_stretch, o.jitter, o.seed)
        self.level -= 1
        self.embedder = Embedder(fine.graph, replace(o, seed=o.seed + self.level), positions=placed)

    def run(self) -> DataFrame:
        while not self.finished:
            self.step()
        return self.embedder.coordinates()


def random_positions(g: Graph, d: int, seed: int, n: int | None = None) -> DataFrame:
    """Uniform in a cube of volume n."""
    side = float(n if n is not None else g.n) ** (1.0 / d)
    return g.nodes.select("id", *[(uniform(seed, F.col("id"), k) * side).alias(f"p{k}") for k in range(d)])


def embed(g: Graph, options: Options | None = None) -> DataFrame:
    """(id, pos) of a finished run."""
    o = options or Options()
    return (LayeredEmbedder(g, o) if o.layered else Embedder(g, o)).run()
