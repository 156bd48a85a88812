"""Similarity spaces as column expressions, unrolled over the dimensions. Low means similar.

A space takes two lists of coordinate columns and two weight columns. Register further ones with space().
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = list[Column]
SPACES: dict[str, Callable[[Point, Point, Column, Column], Column]] = {}

#: Largest squared norm in the Poincare ball, and the cosine distance that counts as no angle.
POINCARE_EDGE, SAME_ANGLE = 1 - 1e-5, 1e-15


def space(name: str):
    def register(f):
        SPACES[name] = f
        return f

    return register


def total(terms: list[Column]) -> Column:
    return reduce(add, terms) if terms else F.lit(0.0)


def dot(a: Point, b: Point) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def sq_norm(a: Point) -> Column:
    return dot(a, a)


def sq_distance(a: Point, b: Point) -> Column:
    return total([(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(sq_distance(a, b))


def inf_distance(a: Point, b: Point) -> Column:
    gaps = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]


def node_weight(name: str, w: Column) -> Column:
    """A vertex's weight in a space; 1 where it has none."""
    return w if name in ("weighted", "weighted_inf", "weighted_nodim", "additive") else F.lit(1.0)


def node_distance(name: str, a: Point, b: Point) -> Column:
    """The distance of two vertices before their weights scale it."""
    return inf_distance(a, b) if name in ("infnorm", "weighted_inf") else distance(a, b)


def safe_divide(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(float("nan")) if otherwise is None else otherwise)


@space("euclidean")
def _euclidean(a, b, wa=None, wb=None):
    return distance(a, b)


@space("infnorm")
def _infnorm(a, b, wa=None, wb=None):
    return inf_distance(a, b)


@space("dot")
def _dot(a, b, wa=None, wb=None):
    return -dot(a, b)


@space("cosine")
def _cosine(a, b, wa=None, wb=None):
    return safe_divide(-dot(a, b), F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b)))


@space("weighted")
def _weighted(a, b, wa, wb):
    return distance(a, b) / F.pow(wa * wb, F.lit(1.0 / len(a)))


@space("weighted_inf")
def _weighted_inf(a, b, wa, wb):
    return inf_distance(a, b) / F.pow(wa * wb, F.lit(1.0 / len(a)))


@space("weighted_nodim")
def _weighted_nodim(a, b, wa, wb):
    return distance(a, b) / (wa * wb)


@space("additive")
def _additive(a, b, wa, wb):
    return distance(a, b) / (F.pow(wa, F.lit(1.0 / len(a))) + F.pow(wb, F.lit(1.0 / len(a))))


@space("poincare")
def _poincare(a, b, wa=None, wb=None):
    inner = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(POINCARE_EDGE), sq_norm(p)))
    x = 2 * sq_distance(a, b) / ((1 - inner(a)) * (1 - inner(b))) + 1
    return F.log(x + F.sqrt(x * x - 1))


def hyperbolic(angle: Column, r1: Column, r2: Column, same: Column) -> Column:
    """Law of cosines for radii and an angle; no distance for one point, the radial gap at no angle."""
    x = 0.5 * ((1 - F.cos(angle)) * F.cosh(r1 + r2) + (1 + F.cos(angle)) * F.cosh(r1 - r2))
    return F.when(same, 0.0).when(angle == 0, F.abs(r1 - r2)).otherwise(F.acosh(F.greatest(x, F.lit(1.0))))


def mercator_s1(t1: Column, t2: Column, r1: Column, r2: Column) -> Column:
    """Circle: angles and radii."""
    angle = math.pi - F.abs(math.pi - F.abs(t1 - t2))
    return hyperbolic(angle, r1, r2, (t1 == t2) & (r1 == r2))


def mercator_sd(a: Point, b: Point, r1: Column, r2: Column) -> Column:
    """Sphere: direction vectors and radii."""
    cosine = safe_divide(dot(a, b), F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b)))
    angle = F.when(F.abs(cosine - 1) < SAME_ANGLE, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    same = reduce(lambda x, y: x & y, [x == y for x, y in zip(a, b, strict=True)]) & (r1 == r2)
    return hyperbolic(angle, r1, r2, same)


def similarity(name: str, a: Point, b: Point, wa: Column | None = None, wb: Column | None = None) -> Column:
    if name not in SPACES:
        raise ValueError(f"unknown space {name}; known: {', '.join(SPACES)}")
    return SPACES[name](a, b, wa, wb)


def spread(array: Column, d: int) -> Point:
    """Coordinates of an array column as d double columns."""
    return [F.get(array, k).cast("double") for k in range(d)]
