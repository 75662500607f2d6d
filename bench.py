"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON.

Without arguments: the headline queries and the base suite. Every query runs BENCH_WARMUP times (1) to warm up and
BENCH_RUNS times (2) measured; --full is the whole protocol, 2 and 5. Suites:

--base     3,000,000 insertions into a scalable filter of capacity 100,000 at 0.05, probes of all and of 500,000 absent items
--stripe   the base suite on three layouts: one bitmap a layer, four stripes probed from broadcast bitmaps, and by joins
--io       one build of all items against micro-batches of a stream: throughput, and the split into source and work
--scaling  strong and weak scaling by workers, and the granularity of partitions by rows in each
--queries  the headline queries
--explain NAME   prints the formatted plan of a registered query and its time, in place of a suite

Seconds are wall-clock; `cpu` has the CPU seconds of the JVM and its Python workers beside them. --mode real takes the
lines of `documents` for items, in place of generated ones.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ["bf_probe", "bf_probe_local", "bf_probe_int", "sbf_layer_stats", "sbf_probe", "striped_probe_local", "membership_semi_join", "bloom_prefilter_join", "cdxj_quality", "text_scan_nonblank", "stats_full", "compat_probe"]
SUITES = ("all", "base", "stripe", "io", "scaling", "queries")


def cpu_seconds() -> float:
    """CPU seconds so far of this process and all below it, ended children included."""
    tick, parents, used = os.sysconf("SC_CLK_TCK"), {}, {}
    for p in Path("/proc").iterdir():
        if p.name.isdigit():
            try:
                fields = (p / "stat").read_text().rsplit(")", 1)[1].split()
            except OSError:  # it has ended meanwhile
                continue
            parents[int(p.name)], used[int(p.name)] = int(fields[1]), sum(map(int, fields[11:15])) / tick
    own = {os.getpid()}
    while more := {p for p, parent in parents.items() if parent in own} - own:
        own |= more
    return sum(used.get(p, 0.0) for p in own)


class Clocks:
    """Wall and CPU seconds of named phases."""

    def __init__(self) -> None:
        self.wall: dict[str, float] = {}
        self.cpu: dict[str, float] = {}

    def time(self, name: str, f) -> None:
        wall, cpu = time.perf_counter(), cpu_seconds()
        f()
        self.wall[name], self.cpu[name] = time.perf_counter() - wall, cpu_seconds() - cpu


def items_of(spark, sf_dir: str, mode: str, items: int, absent: int):
    """(items with ordinal, absent items, number of items)."""
    from quillsieve.operators import build
    from quillsieve.sources.generators import labelled

    if mode == "synthetic":
        return labelled(spark, "IN_", items), labelled(spark, "OUT_", absent).select("item"), items
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "item"))
    rows, n = build.ordered(lines, "doc_id", "at")
    return rows.select("ordinal", "item"), rows.select(F.concat("item", F.lit("#absent")).alias("item")), n


def base_suite(spark, sf_dir: str, mode: str = "synthetic", items: int = 3_000_000, absent: int = 500_000, layout: str = "base") -> Clocks:
    """Inserting the items; probing them and the absent ones. layout: base, striped or striped_joined."""
    from quillsieve.operators import build, probe, store
    from quillsieve.params import FilterConfig

    config = FilterConfig(100_000, 0.05) if layout == "base" else FilterConfig(100_000, 0.05, tightening=None, stripes=4)
    rows, others, n = items_of(spark, sf_dir, mode, items, absent)
    plan, clocks, kept = config.plan(n), Clocks(), []
    clocks.time(f"{layout}_insert", lambda: kept.append(store.stored(build.packed_bits(rows, "item", plan, config.stripes))))

    def query():
        for asked in (rows.select("item"), others):
            found = probe.probe(asked, "item", kept[0], plan, config.stripes) if layout == "striped_joined" else probe.probe_local(asked, "item", kept[0], plan, config)
            found.groupBy("present").count().collect()

    clocks.time(f"{layout}_query", query)
    return clocks


def io_suite(spark, sf_dir: str, mode: str, items: int = 400_000, batches: int = 8) -> Clocks:
    """A build of all items at once, and the same items as a stream of files, one a micro-batch."""
    from quillsieve.operators import build, store, telemetry
    from quillsieve.params import FilterConfig
    from quillsieve.streaming import ingest

    config, clocks, base = FilterConfig(200_000, 0.01), Clocks(), store.scratch(spark)
    rows, _, n = items_of(spark, sf_dir, mode, items, 1)
    for b in range(batches):
        rows.filter((F.col("ordinal") * batches / n).cast("int") == b).coalesce(1).write.parquet(f"{base}/in/part={b}")
    files = spark.read.schema(rows.schema).parquet(f"{base}/in/part=*")
    clocks.time("io_batch", lambda: store.stored(build.packed_bits(files, "item", config.plan(n))))
    ran = []

    def stream():
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/part=*")
        ran.append(ingest.ingest(source, ingest.Ingestor(spark, f"{base}/state", "item", config, order="ordinal"), f"{base}/log"))
        ran[0].awaitTermination()

    clocks.time("io_stream", stream)
    io, work = (sum(x) / 1000 for x in zip(*(ingest.io_and_cpu(s["parts_ms"]) for s in ingest.batch_stats(ran[0])), strict=True))
    clocks.wall |= {"io_stream_source": io, "io_stream_work": work}
    a, b = clocks.wall["io_stream"], clocks.wall["io_batch"]
    lines = spark.range(1).select(telemetry.report_lines(F.lit(n / a), F.lit(n / b), F.lit(a), F.lit(b)).alias("x")).first().x
    print(lines, file=sys.stderr)
    return clocks


def scaling(spark, cpus: int, strong: int = 3_000_000, weak: int = 500_000) -> Clocks:
    """Insertion only, one layer: 1, 2, 4, ... partitions, and partitions of so many rows."""
    from quillsieve.operators import build
    from quillsieve.params import FilterConfig
    from quillsieve.sources.generators import labelled

    clocks = Clocks()

    def insert(name, n, partitions):
        plan = FilterConfig(n, 0.05).plan(n)
        rows = spark.range(0, n, 1, partitions).select(F.concat(F.lit(name.upper() + "_"), F.col("id")).alias("item"), F.col("id").alias("ordinal"))
        clocks.time(name, lambda: build.packed_bits(rows, "item", plan).write.format("noop").mode("overwrite").save())

    labelled(spark, "WARM_", 1000).write.format("noop").mode("overwrite").save()
    workers = 1
    while workers <= cpus:
        insert(f"strong_{workers}", strong, workers)
        insert(f"weak_{workers}", weak * workers, workers)
        workers *= 2
    for chunk in (10_000, 50_000, 100_000, 250_000, 500_000, 1_000_000):
        insert(f"chunk_{chunk}", strong, -(-strong // chunk))
    return clocks


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for suite in SUITES:
        parser.add_argument(f"--{suite}", action="store_true")
    parser.add_argument("--mode", choices=["synthetic", "real"], default="synthetic")
    parser.add_argument("--full", action="store_true")
    parser.add_argument("--explain", metavar="NAME")
    asked = parser.parse_args()
    wanted = {s for s in SUITES if getattr(asked, s)} or {"base", "queries"}
    wanted = set(SUITES) if "all" in wanted else wanted
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs, warmup = (5, 2) if asked.full else (int(os.environ.get("BENCH_RUNS", "2")), int(os.environ.get("BENCH_WARMUP", "1")))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillsieve.plans import registry

    if asked.explain:
        clocks, found = Clocks(), registry.QUERIES[asked.explain](spark, sf_dir)
        found.explain("formatted")
        clocks.time(asked.explain, lambda: found.write.format("noop").mode("overwrite").save())
        print(json.dumps({"wall": clocks.wall, "cpu": clocks.cpu}))
        return
    seconds: dict[str, float] = {}
    cpu: dict[str, float] = {}

    def measured(f, warm=warmup) -> None:
        """f() gives the clocks of one run; means of the measured runs."""
        got = [f() for _ in range(warm + runs)][warm:]
        for into, kind in ((seconds, "wall"), (cpu, "cpu")):
            for name in getattr(got[0], kind):
                into[name] = round(sum(getattr(g, kind)[name] for g in got) / len(got), 4)

    def query(name) -> Clocks:
        clocks = Clocks()
        clocks.time(name, lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        return clocks

    if "queries" in wanted:
        for name in HEADLINE:
            measured(lambda name=name: query(name))
    if "base" in wanted:
        base_suite(spark, sf_dir, "synthetic", 300_000, 50_000)
        measured(lambda: base_suite(spark, sf_dir, asked.mode), warm=2 if asked.full else 0)
    if "stripe" in wanted:
        for layout in ("base", "striped", "striped_joined"):
            measured(lambda layout=layout: base_suite(spark, sf_dir, asked.mode, 300_000, 50_000, layout=layout))
    if "io" in wanted:
        measured(lambda: io_suite(spark, sf_dir, asked.mode))
    if "scaling" in wanted:
        measured(lambda: scaling(spark, cpus))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "cpu": cpu, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
