"""Micro-batch ingestion into a scalable filter, with retirement of the oldest layers.

Structured Streaming delivers batches one after another, with admission control in place of a bounded
queue. A batch's insertions go to the active layer and, beyond its capacity, to new ones; after each
batch, where more than max_layers are alive, the one oldest retires. Layer ids never repeat; a layer's
depth, which decides its size, is the number of layers alive when it began.

State lives in tables under `path`, one folder for each epoch: an epoch that is delivered again
overwrites its own folder and reads the state of the epoch before, so a repeat changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillsieve.operators.build import ordered, packed_bits
from quillsieve.operators.store import union_filters
from quillsieve.params import FilterConfig, Layer

PACKED = "layer int, stripe int, bucket long, bitmap binary"


@dataclass(frozen=True)
class Live:
    """A layer alive: its id, depth, capacity and insertions so far."""

    layer: int
    depth: int
    capacity: int
    m: int
    k: int
    n_items: int = 0


@dataclass(frozen=True)
class State:
    layers: tuple[Live, ...] = ()
    next_id: int = 0
    batches: int = 0


def advance(state: State, items: int, config: FilterConfig) -> tuple[State, list[tuple[Live, int, int]]]:
    """The state after a batch of `items` insertions, before aging, and which ordinals lo..hi-1 of the batch go to which layer."""
    layers, next_id, at, dealt = list(state.layers), state.next_id, 0, []
    if not layers:
        layers, next_id = [_begin(next_id, 0, config)], next_id + 1
    while at < items:
        active = layers[-1]
        room = active.capacity - active.n_items
        if room <= 0:
            layers.append(_begin(next_id, len(layers), config))
            next_id += 1
            continue
        take = min(room, items - at)
        layers[-1] = replace(active, n_items=active.n_items + take)
        dealt.append((layers[-1], at, at + take))
        at += take
    return State(tuple(layers), next_id, state.batches + 1), dealt


def _begin(layer_id: int, depth: int, config: FilterConfig) -> Live:
    x = config.layer(depth)
    return Live(layer_id, depth, x.capacity, x.m, x.k)


def aged(state: State, max_layers: int) -> State:
    """Without its oldest layer, where more than max_layers are alive: one for each batch at most."""
    return replace(state, layers=state.layers[1:]) if len(state.layers) > max_layers else state


class Ingestor:
    """foreachBatch body: `Ingestor(...)(batch, epoch)`. Items are inserted in the order of `order`."""

    def __init__(self, spark: SparkSession, path: str, item: str, config: FilterConfig, order: str | None = None, max_layers: int = 15) -> None:
        self.spark, self.path, self.item, self.config, self.order, self.max_layers = spark, path.rstrip("/"), item, config, order or item, max_layers

    def _read_state(self, epoch: int) -> State:
        if epoch < 0:
            return State()
        raw = json.loads(self.spark.read.text(f"{self.path}/epoch={epoch}/state").first().value)
        return State(tuple(Live(**x) for x in raw["layers"]), raw["next_id"], raw["batches"])

    def _read_bits(self, epoch: int) -> DataFrame:
        if epoch < 0:
            return self.spark.createDataFrame([], PACKED)
        return self.spark.read.schema(PACKED).parquet(f"{self.path}/epoch={epoch}/bits")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        before = self._read_state(epoch - 1)
        batch = batch.select(*dict.fromkeys([self.item, self.order])).persist()  # sorting reads it twice, the source once
        rows, n = ordered(batch, self.order)
        batch.unpersist()
        after, dealt = advance(before, n, self.config)
        after = aged(after, self.max_layers)
        bits = self._read_bits(epoch - 1)
        if dealt:
            plan = [Layer(live.layer, live.capacity, 0.0, live.m, live.k, lo, hi) for live, lo, hi in dealt]
            bits = union_filters(bits, packed_bits(rows, self.item, plan))
        alive = [x.layer for x in after.layers]
        bits.filter(F.col("layer").isin(alive)).select("layer", "stripe", "bucket", "bitmap").write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}/bits")
        text = json.dumps({"layers": [asdict(x) for x in after.layers], "next_id": after.next_id, "batches": after.batches, "batch_size": n})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/epoch={epoch}/state")
        self.last = epoch

    def plan(self, epoch: int) -> list[Layer]:
        return [Layer(x.layer, x.capacity, 0.0, x.m, x.k, 0, 0) for x in self._read_state(epoch).layers]

    def bits(self, epoch: int) -> DataFrame:
        return self._read_bits(epoch)

    def layers(self, epoch: int) -> DataFrame:
        rows = [(x.layer, x.depth, x.capacity, x.m, x.k, x.n_items) for x in self._read_state(epoch).layers]
        return self.spark.createDataFrame(rows, "layer int, depth int, capacity long, m long, k int, n_items long")


def ingest(stream: DataFrame, ingestor: Ingestor, checkpoint: str) -> StreamingQuery:
    """Runs the stream to its end; progress has each batch's rows, rate and the time of its parts."""
    return stream.writeStream.foreachBatch(ingestor).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_stats(query: StreamingQuery) -> list[dict]:
    """batch, rows, seconds and rows a second of each micro-batch, with the time of its parts in ms."""
    return [
        {"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["batchDuration"] / 1000, "items_per_second": p["numInputRows"] / max(p["batchDuration"] / 1000, 1e-9), "parts_ms": dict(p["durationMs"])}
        for p in query.recentProgress
        if p["numInputRows"]
    ]


def io_and_cpu(parts_ms: dict[str, int]) -> tuple[int, int]:
    """(ms of finding and planning what to read, ms of the batch's work) from a batch's parts."""
    io = sum(v for k, v in parts_ms.items() if k in ("latestOffset", "getBatch", "queryPlanning", "walCommit", "commitOffsets"))
    return io, parts_ms.get("addBatch", 0)


def layers_after(spark: SparkSession, batches: list[int], config: FilterConfig, max_layers: int = 15) -> DataFrame:
    """What `layers` gives after batches of the given sizes, without running them: sizes alone decide."""
    state = State()
    for n in batches:
        state = aged(advance(state, n, config)[0], max_layers)
    rows = [(x.layer, x.depth, x.capacity, x.m, x.k, x.n_items) for x in state.layers]
    return spark.createDataFrame(rows, "layer int, depth int, capacity long, m long, k int, n_items long")


def dedup_stream(stream: DataFrame, item: str, event_time: str, delay: str) -> DataFrame:
    """The exact baseline of probing before inserting: repeats within the watermark go."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([item])
