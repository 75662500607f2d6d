"""Filter sizing and layer plans. Computed once in Python and used as literals, so no engine's logarithm can differ."""

from __future__ import annotations

import math
from dataclasses import dataclass


def bits_for(capacity: int, fp_rate: float) -> tuple[int, int]:
    """(bits, hash functions) of a filter for `capacity` items at `fp_rate`."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    if not 0 < fp_rate < 1:
        raise ValueError("fp_rate must lie between 0 and 1")
    bits = math.ceil(-capacity * math.log(fp_rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


@dataclass(frozen=True)
class Layer:
    """One layer: it holds the items of ordinals lo..hi-1. m is the length of one stripe's bitmap."""

    layer: int
    capacity: int
    fp_rate: float
    m: int
    k: int
    lo: int
    hi: int


@dataclass(frozen=True)
class FilterConfig:
    """A scalable filter.

    tightening: each layer's rate is the one before times this; None keeps every layer at a tenth of the
    target, with growth 2, the rule of striped filters. stripes: sub-bitmaps of a layer, by item. wrap64: probe
    positions wrap at 64 bits before the modulus (compat hashing only). aged_layers: a plan whose depth stops there.
    """

    capacity: int
    fp_rate: float
    tightening: float | None = 0.9
    growth: int = 2
    stripes: int = 1
    wrap64: bool = False

    def __post_init__(self) -> None:
        if self.capacity <= 0:
            raise ValueError("capacity must be positive")
        if not 0 < self.fp_rate < 1:
            raise ValueError("fp_rate must lie between 0 and 1")
        if self.tightening is not None and not 0 < self.tightening < 1:
            raise ValueError("tightening must lie between 0 and 1")
        if self.growth <= 1:
            raise ValueError("growth must be above 1")
        if self.stripes < 1:
            raise ValueError("stripes must be positive")

    def layer(self, depth: int) -> Layer:
        """The layer at a depth, counted from 0."""
        capacity = self.capacity * self.growth**depth
        rate = 0.1 * self.fp_rate if self.tightening is None else self.fp_rate * (1 - self.tightening) * self.tightening**depth
        m, k = bits_for(capacity, rate)
        lo = self.capacity * (self.growth**depth - 1) // (self.growth - 1)
        return Layer(depth, capacity, rate, math.ceil(m / self.stripes), k, lo, lo + capacity)

    def plan(self, items: int) -> list[Layer]:
        """The layers that `items` insertions fill; one at least. A layer exactly full begins no other."""
        layers = [self.layer(0)]
        while layers[-1].hi < items:
            layers.append(self.layer(len(layers)))
        return layers


def fixed(capacity: int, fp_rate: float) -> list[Layer]:
    """The one unbounded layer of a fixed-size filter."""
    m, k = bits_for(capacity, fp_rate)
    return [Layer(0, capacity, fp_rate, m, k, 0, 1 << 62)]


def compound_rate(layers: list[Layer]) -> float:
    """The chance that some layer wrongly accepts an absent item, by design."""
    return 1 - math.prod(1 - x.fp_rate for x in layers)
