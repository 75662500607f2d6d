"""Filters as objects: insert and probe batches (DataFrames or Python lists), one item, unions, files.

    with ScalableFilter(spark, 100_000, 0.05) as f:
        f.add_batch(df, "url", order="page_id")
        f.contains_batch(other, "url")          # other with `present`
        "http://example.com/" in f

The state is a packed table in the shared folder, replaced by each batch; single items are one-row batches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.operators import build, metrics, probe, store
from quillsieve.params import FilterConfig, Layer, fixed

PACKED = "layer int, stripe int, bucket long, bitmap binary"


def canonical(item: object) -> bytes | None:
    """The bytes of one Python value, as functions.items makes them of a column."""
    if item is None:
        return None
    if isinstance(item, bytes):
        return item
    if isinstance(item, int):  # booleans too
        return int(item).to_bytes(8, "big", signed=True)
    return str(item).encode()


class _Filter:
    def __init__(self, spark: SparkSession, family: str = "sql") -> None:
        if family not in ("sql", "compat"):
            raise ValueError("family must be sql or compat")
        self.spark, self.family, self.inserted = spark, family, 0
        self.packed = spark.createDataFrame([], PACKED)

    # What kinds of filters differ in
    def plan(self, items: int | None = None) -> list[Layer]:
        raise NotImplementedError

    @property
    def config(self) -> FilterConfig | None:
        return None

    # Insertion
    def add_batch(self, items: DataFrame | Iterable, item: str = "item", order: str | None = None) -> _Filter:
        """Insert a batch, in the order of `order` (a list's own order). Repeats count; nulls are no items; an empty batch
        changes nothing."""
        rows, item, order = self._rows(items, item, order)
        rows, n = build.ordered(rows.select(*dict.fromkeys([item, order])).filter(F.col(item).isNotNull()), order)
        if not n:
            return self
        plan = self.plan(self.inserted + n)
        rows = rows.select(item, (F.col("ordinal") + self.inserted).alias("ordinal"))
        stripes = self.config.stripes if self.config else 1
        new = build.packed_bits(rows, item, plan, stripes) if self.family == "sql" else build.pack(build.compat_bits(rows, item, plan, self.config))
        self.packed = store.stored(store.union_filters(self.packed, new))
        self.inserted += n
        return self

    def add(self, item: object) -> _Filter:
        return self.add_batch([item])

    # Probing
    def contains_batch(self, items: DataFrame | Iterable, item: str = "item") -> DataFrame | list[bool | None]:
        """A DataFrame with `present`; for a list, a list in its order."""
        rows, column, _ = self._rows(items, item, None)
        plan = self.plan()
        found = probe.probe_by_size(rows, column, self.packed, plan, self.config, self.family)
        if isinstance(items, DataFrame):
            return found
        return [r.present for r in found.orderBy("ordinal").collect()]

    def __contains__(self, item: object) -> bool:
        return bool(self.contains_batch([item])[0])

    def _rows(self, items, item, order) -> tuple[DataFrame, str, str]:
        if isinstance(items, DataFrame):
            return items, item, order or item
        rows = [(k, canonical(x)) for k, x in enumerate(items)]
        return self.spark.createDataFrame(rows, "ordinal long, item binary"), "item", "ordinal"

    # What is in it
    def __len__(self) -> int:
        """Insertions, repeats counted."""
        return self.inserted

    def layers(self) -> DataFrame:
        """layer, capacity, m, k, set_bits, fill, actual_fp, one layer at least."""
        return metrics.layer_metrics(self.packed, self.plan())

    def union(self, other: _Filter) -> _Filter:
        """The bits of both; for filters whose layers are of the same sizes."""
        mine, theirs = ([(x.m, x.k) for x in f.plan()] for f in (self, other))
        if mine[: len(theirs)] != theirs[: len(mine)]:
            raise ValueError("the filters have different plans")
        self.packed = store.stored(store.union_filters(self.packed, other.packed))
        self.inserted = max(self.inserted, other.inserted) if len(mine) > 1 or len(theirs) > 1 else self.inserted + other.inserted
        return self

    def save(self, path: str) -> None:
        store.save_filter(self.packed, self.plan(), path)

    def __enter__(self) -> _Filter:
        return self

    def __exit__(self, *_) -> None:
        self.packed = self.spark.createDataFrame([], PACKED)
        self.inserted = 0


class FixedFilter(_Filter):
    """One layer of fixed size. Insertions beyond its capacity that raise its estimated rate above the target are an error,
    raised after the batch was inserted."""

    def __init__(self, spark: SparkSession, capacity: int, fp_rate: float, family: str = "sql") -> None:
        super().__init__(spark, family)
        self._layers = fixed(capacity, fp_rate)

    def plan(self, items: int | None = None) -> list[Layer]:
        return self._layers

    def add_batch(self, items, item: str = "item", order: str | None = None) -> FixedFilter:
        super().add_batch(items, item, order)
        layer = self._layers[0]
        if self.inserted > layer.capacity and self.layers().first().actual_fp > layer.fp_rate:
            raise ValueError(f"saturated: {self.inserted} insertions into a filter for {layer.capacity}")
        return self


class ScalableFilter(_Filter):
    """Layers of growing capacity; with stripes and without tightening, the striped rule."""

    def __init__(self, spark: SparkSession, capacity: int, fp_rate: float, tightening: float | None = 0.9, growth: int = 2, stripes: int = 1, family: str = "sql", wrap64: bool = False) -> None:
        super().__init__(spark, family)
        self._config = FilterConfig(capacity, fp_rate, tightening, growth, stripes, wrap64)

    @property
    def config(self) -> FilterConfig:
        return self._config

    def plan(self, items: int | None = None) -> list[Layer]:
        return self._config.plan(self.inserted if items is None else items)
