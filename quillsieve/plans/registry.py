"""All registered queries of the membership engine, each beside the SQL that checks it.

Sizes come from quillsieve.params and stand as literals in both, so that no engine's logarithm decides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions.hashing import sql_pair, sql_positions, with_compat_pair
from quillsieve.functions.items import item_bytes
from quillsieve.operators import build, metrics, probe, stats, store, telemetry
from quillsieve.params import FilterConfig, Layer, bits_for, fixed
from quillsieve.plans.murmur_sql import murmur3_32, murmur3_128
from quillsieve.sources import cdxj, generators, text
from quillsieve.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL for the oracles -------------------------------------------------------------------------------------------------

def _pair(x: str, integer: bool) -> str:
    digest = f"md5(unhex(lpad(to_hex({x}::BIGINT), 16, '0')))" if integer else f"md5({x})"
    return f"('0x' || substr({digest}, 1, 12))::BIGINT AS h1, ('0x' || substr({digest}, 13, 12))::BIGINT AS h2"


def _values(plan: list[Layer]) -> str:
    return "(VALUES " + ", ".join(f"({x.layer}, {x.m}, {x.k}, {x.lo}, {x.hi})" for x in plan) + ") AS p(layer, m, k, lo, hi)"


def _bits(items: str, plan: list[Layer], integer: bool, stripes: int = 1) -> str:
    """items: SQL of rows (item, ordinal). Distinct (layer, stripe, bit)."""
    return f"""SELECT DISTINCT layer, stripe, (h1 + i * h2) % m AS bit FROM (
        SELECT layer, m, k, h1, h2, ((h1 % 2147483647) % {stripes})::INTEGER AS stripe, unnest(range(k)) AS i FROM (
            SELECT p.layer, p.m, p.k, {_pair('item', integer)} FROM ({items}) JOIN {_values(plan)} ON ordinal >= lo AND ordinal < hi WHERE item IS NOT NULL))"""


def _probe(items: str, bits: str, plan: list[Layer], integer: bool, stripes: int = 1) -> str:
    """items: SQL of rows (item). Items with present."""
    return f"""(WITH b AS ({bits}), d AS (SELECT DISTINCT item FROM ({items}) WHERE item IS NOT NULL),
        q AS (SELECT DISTINCT item, layer, stripe, (h1 + i * h2) % m AS bit FROM (
            SELECT item, layer, m, h1, h2, ((h1 % 2147483647) % {stripes})::INTEGER AS stripe, unnest(range(k)) AS i FROM (SELECT item, p.layer, p.m, p.k, {_pair('item', integer)} FROM d CROSS JOIN {_values(plan)}))),
        h AS (SELECT q.item, q.layer, count(*) AS wanted, count(b.bit) AS hits FROM q LEFT JOIN b ON q.layer = b.layer AND q.stripe = b.stripe AND q.bit = b.bit GROUP BY ALL)
        SELECT item, bool_or(wanted = hits) AS present FROM h GROUP BY item)"""


# Sizing, items and hashing --------------------------------------------------------------------------------------------

#: The configurations of the reference workloads (items, capacity, target rate).
WORKLOADS = [(3_000_000, 100_000, 0.05), (1_500_000, 100_000, 0.05), (5_000_000, 200_000, 0.01), (5_000_000, 50_000, 0.01), (300_000, 100_000, 0.01), (50_000, 50_000, 0.05)]


@query("bf_params", "SELECT n, p, ceil(-n * ln(p) / pow(ln(2), 2))::BIGINT AS m, greatest(1, round_even(ceil(-n * ln(p) / pow(ln(2), 2)) / n * ln(2), 0))::INTEGER AS k FROM (VALUES " + ", ".join(f"({c}::BIGINT, {p}::DOUBLE)" for c, p in sorted({w[1:] for w in WORKLOADS})) + ") t(n, p)")
def bf_params(spark, sf_dir):
    return spark.createDataFrame([(c, p, *bits_for(c, p)) for c, p in sorted({w[1:] for w in WORKLOADS})], "n long, p double, m long, k int")


@query("item_bytes_hex", "SELECT c_custkey, lpad(to_hex(c_custkey), 16, '0') AS key_hex, hex(c_name) AS name_hex, lpad(to_hex(-c_custkey), 16, '0') AS negative_hex FROM customer")
def item_bytes_hex(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("negative", -F.col("c_custkey"))
    return c.select("c_custkey", F.hex(item_bytes(c, "c_custkey")).alias("key_hex"), F.hex(item_bytes(c, "c_name")).alias("name_hex"), F.hex(item_bytes(c, "negative")).alias("negative_hex"))


_NATION = bits_for(25, 0.01)


@query("bf_hash_positions", f"SELECT n_nationkey, i, (h1 + i * h2) % {_NATION[0]} AS bit FROM (SELECT n_nationkey, h1, h2, unnest(range({_NATION[1]}))::INTEGER AS i FROM (SELECT n_nationkey, {_pair('n_name', False)} FROM nation))")
def bf_hash_positions(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    h1, h2 = sql_pair(item_bytes(n, "n_name"))
    return n.select("n_nationkey", F.posexplode(sql_positions(h1, h2, _NATION[1], _NATION[0])).alias("i", "bit"))


# Fixed-size filters ---------------------------------------------------------------------------------------------------

_PAGES = fixed(1000, 0.01)
_PAGE_BITS = _bits("SELECT url AS item, 0 AS ordinal FROM pages", _PAGES, False)
_CUSTOMERS = fixed(10_000, 0.05)
_URGENT = "SELECT o_custkey AS item, 0 AS ordinal FROM orders WHERE o_orderpriority = '1-URGENT'"


def _page_items(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("url")


def _urgent_customers(spark, sf_dir):
    """All customers, and a filter of those with an urgent order."""
    urgent = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return _table(spark, sf_dir, "customer").select("c_custkey"), build.packed_bits(urgent, "o_custkey", _CUSTOMERS)


@query("bf_build_bits", f"SELECT layer, bit FROM ({_PAGE_BITS})")
def bf_build_bits(spark, sf_dir):
    return build.bit_rows(_page_items(spark, sf_dir), "url", _PAGES).select("layer", "bit")


@query("bf_set_bits_fill_fp", f"SELECT count(*) AS set_bits, round(count(*) / {_PAGES[0].m}::DOUBLE, 9) AS fill, round(pow(count(*) / {_PAGES[0].m}::DOUBLE, {_PAGES[0].k}), 9) AS actual_fp FROM ({_PAGE_BITS})")
def bf_set_bits_fill_fp(spark, sf_dir):
    m = metrics.layer_metrics(build.packed_bits(_page_items(spark, sf_dir), "url", _PAGES), _PAGES)
    return m.select("set_bits", F.round("fill", 9).alias("fill"), F.round("actual_fp", 9).alias("actual_fp"))


@query("bf_probe", f"SELECT item AS c_custkey, present FROM {_probe('SELECT c_custkey AS item FROM customer', _bits(_URGENT, _CUSTOMERS, True), _CUSTOMERS, True)}")
def bf_probe(spark, sf_dir):
    customers, packed = _urgent_customers(spark, sf_dir)
    return probe.probe(customers, "c_custkey", packed, _CUSTOMERS)


@query("bf_probe_local", ORACLES["bf_probe"])
def bf_probe_local(spark, sf_dir):
    customers, packed = _urgent_customers(spark, sf_dir)
    return probe.probe_local(customers, "c_custkey", packed, _CUSTOMERS)


_USERS = fixed(2000, 0.02)
_BUYERS = "SELECT user_id AS item, 0 AS ordinal FROM events WHERE event_type = 'purchase' AND value > 200"


@query("bf_probe_int", f"SELECT e.event_id, e.user_id, p.present FROM events e LEFT JOIN {_probe('SELECT user_id AS item FROM events', _bits(_BUYERS, _USERS, True), _USERS, True)} p ON e.user_id = p.item")
def bf_probe_int(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    packed = build.packed_bits(e.filter("event_type = 'purchase' AND value > 200").select("user_id"), "user_id", _USERS)
    return probe.probe(e.select("event_id", "user_id"), "user_id", packed, _USERS)


_NAMED = fixed(4000, 0.01)


def _name_bits(table: str, column: str) -> str:
    return _bits(f"SELECT {column} AS item, 0 AS ordinal FROM {table}", _NAMED, False)


def _named(spark, sf_dir, table: str, column: str) -> DataFrame:
    return build.packed_bits(_table(spark, sf_dir, table).select(column), column, _NAMED)


@query("bf_union", f"SELECT layer, count(*) AS set_bits FROM (({_name_bits('part', 'p_name')}) UNION ({_name_bits('customer', 'c_name')})) GROUP BY layer")
def bf_union(spark, sf_dir):
    both = store.union_filters(_named(spark, sf_dir, "part", "p_name"), _named(spark, sf_dir, "customer", "c_name"))
    return metrics.layer_metrics(both, _NAMED).select("layer", "set_bits")


@query("bf_popcount", f"SELECT count(*) AS set_bits FROM ({_name_bits('part', 'p_name')})")
def bf_popcount(spark, sf_dir):
    return metrics.popcount(_named(spark, sf_dir, "part", "p_name"))


_SATURATED = fixed(300, 0.01)


@query("bf_saturation_check", f"""WITH items AS (SELECT user_id AS item, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events),
    firsts AS (SELECT bit, min(ordinal) AS ordinal FROM (SELECT ordinal, (h1 + i * h2) % {_SATURATED[0].m} AS bit FROM (SELECT ordinal, h1, h2, unnest(range({_SATURATED[0].k})) AS i FROM (SELECT ordinal, {_pair('item', True)} FROM items))) GROUP BY bit),
    steps AS (SELECT ordinal // 100 AS step, max(ordinal) + 1 AS inserted FROM items GROUP BY 1),
    news AS (SELECT ordinal // 100 AS step, count(*) AS n FROM firsts GROUP BY 1),
    runs AS (SELECT inserted, (sum(coalesce(n, 0)) OVER (ORDER BY step))::BIGINT AS set_bits FROM steps LEFT JOIN news USING (step))
    SELECT inserted::BIGINT AS inserted, set_bits, round(pow(set_bits / {_SATURATED[0].m}::DOUBLE, {_SATURATED[0].k}), 9) AS actual_fp,
        inserted > {_SATURATED[0].capacity} AND inserted % 100 = 0 AND pow(set_bits / {_SATURATED[0].m}::DOUBLE, {_SATURATED[0].k}) > {_SATURATED[0].fp_rate} AS saturated FROM runs""")
def bf_saturation_check(spark, sf_dir):
    items = build.with_ordinal(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    return metrics.saturation(items, "user_id", _SATURATED).withColumn("actual_fp", F.round("actual_fp", 9))


# Scalable filters -----------------------------------------------------------------------------------------------------

@query("sbf_layer_plan", "SELECT n, c, p, layer::INTEGER AS layer, capacity, lo, least(n, lo + capacity) - lo AS used FROM (SELECT n, c, p, layer, (c * pow(2, layer))::BIGINT AS capacity, (c * (pow(2, layer) - 1))::BIGINT AS lo FROM (VALUES " + ", ".join(f"({n}::BIGINT, {c}::BIGINT, {p}::DOUBLE)" for n, c, p in WORKLOADS) + ") t(n, c, p) CROSS JOIN range(12) r(layer)) WHERE lo < n")
def sbf_layer_plan(spark, sf_dir):
    rows = [(n, c, p, x.layer, x.capacity, x.lo, min(n, x.hi) - x.lo) for n, c, p in WORKLOADS for x in FilterConfig(c, p).plan(n)]
    return spark.createDataFrame(rows, "n long, c long, p double, layer int, capacity long, lo long, used long")


#: Enough layers for the largest tables here; the last bounds are never reached by smaller ones.
_EVENT_CONFIG, _ORDER_CONFIG, _STRIPED = FilterConfig(500, 0.02), FilterConfig(1000, 0.05), FilterConfig(300, 0.05, tightening=None, stripes=4)


def _longest(config: FilterConfig, layers: int = 16) -> list[Layer]:
    return [config.layer(d) for d in range(layers)]


def _plan_rows(config: FilterConfig) -> str:
    return _values(_longest(config))


@query("sbf_layer_assignment", f"SELECT event_id, user_id, ordinal::BIGINT AS ordinal, layer FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events) JOIN {_plan_rows(_EVENT_CONFIG)} ON ordinal >= lo AND ordinal < hi")
def sbf_layer_assignment(spark, sf_dir):
    items, n = build.ordered(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    return items.withColumn("layer", build.layer_of(F.col("ordinal"), _EVENT_CONFIG.plan(n)))


_ORDER_ITEMS = "SELECT o_custkey AS item, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders"


def _order_items(spark, sf_dir):
    items, n = build.ordered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return items, _ORDER_CONFIG.plan(n)


@query("sbf_layer_stats", f"""WITH items AS ({_ORDER_ITEMS}), counts AS (SELECT layer, m, k, count(*) AS n_items FROM items JOIN {_plan_rows(_ORDER_CONFIG)} ON ordinal >= lo AND ordinal < hi GROUP BY ALL),
    bits AS (SELECT layer, count(*) AS set_bits FROM ({_bits(_ORDER_ITEMS, _longest(_ORDER_CONFIG), True)}) GROUP BY layer)
    SELECT layer, n_items, set_bits, round(set_bits / m::DOUBLE, 9) AS fill, round(pow(set_bits / m::DOUBLE, k), 9) AS actual_fp FROM counts JOIN bits USING (layer)""")
def sbf_layer_stats(spark, sf_dir):
    items, plan = _order_items(spark, sf_dir)
    return metrics.layer_stats(items, "o_custkey", plan).select("layer", "n_items", "set_bits", F.round("fill", 9).alias("fill"), F.round("actual_fp", 9).alias("actual_fp"))


@query("sbf_element_count", "SELECT count(*) AS n_items FROM orders")
def sbf_element_count(spark, sf_dir):
    items, plan = _order_items(spark, sf_dir)
    return build.layer_counts(items, plan).agg(F.sum("n_items").alias("n_items"))


def _sbf_probe(items: str) -> str:
    """Only layers that hold bits can answer, so the oracle may probe more layers than exist."""
    return _probe(items, _bits(_ORDER_ITEMS, _longest(_ORDER_CONFIG, 10), True), _longest(_ORDER_CONFIG, 10), True)


@query("sbf_probe", f"SELECT item AS c_custkey, present FROM {_sbf_probe('SELECT c_custkey AS item FROM customer')}")
def sbf_probe(spark, sf_dir):
    items, plan = _order_items(spark, sf_dir)
    bits = build.packed_bits(items, "o_custkey", plan)
    return probe.probe_by_size(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", bits, plan, _ORDER_CONFIG)


@query("sbf_probe_relational", ORACLES["sbf_probe"])
def sbf_probe_relational(spark, sf_dir):
    items, plan = _order_items(spark, sf_dir)
    return probe.probe(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", build.packed_bits(items, "o_custkey", plan), plan)


_ABSENT = "SELECT c_custkey + 1000000 AS item FROM customer"


@query("sbf_false_negatives", f"SELECT count(*) AS false_negatives FROM {_sbf_probe('SELECT o_custkey AS item FROM orders')} WHERE NOT present")
def sbf_false_negatives(spark, sf_dir):
    items, plan = _order_items(spark, sf_dir)
    keys = items.select("o_custkey").distinct()
    found = probe.probe_by_size(keys, "o_custkey", build.packed_bits(items, "o_custkey", plan), plan, _ORDER_CONFIG)
    return metrics.false_negatives(keys, found, "o_custkey").agg(F.count(F.lit(1)).alias("false_negatives"))


def _absent(spark, sf_dir):
    items, plan = _order_items(spark, sf_dir)
    absent = _table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"))
    return metrics.empirical_rate(probe.probe_by_size(absent, "c_custkey", build.packed_bits(items, "o_custkey", plan), plan, _ORDER_CONFIG))


@query("sbf_empirical_fpr", f"SELECT coalesce(sum(present::INT), 0)::BIGINT AS false_positives, count(*) AS probes, round(coalesce(avg(present::INT), 0), 9)::DOUBLE AS fpr FROM {_sbf_probe(_ABSENT)}")
def sbf_empirical_fpr(spark, sf_dir):
    return _absent(spark, sf_dir).withColumn("fpr", F.round("fpr", 9))


@query("sbf_verdict", f"SELECT coalesce(avg(present::INT), 0) <= 0.05 OR abs(coalesce(avg(present::INT), 0) - 0.05) < 0.005 AS scalable_ok, abs(coalesce(avg(present::INT), 0) - 0.05) < 0.02 AS fixed_ok FROM {_sbf_probe(_ABSENT)}")
def sbf_verdict(spark, sf_dir):
    return _absent(spark, sf_dir).select(metrics.verdict(F.col("fpr"), 0.05, True).alias("scalable_ok"), metrics.verdict(F.col("fpr"), 0.05, False).alias("fixed_ok"))


_PART_ITEMS = "SELECT p_name AS item, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal FROM part"
_STRIPED_BITS = _bits(_PART_ITEMS, _longest(_STRIPED, 10), False, _STRIPED.stripes)


def _striped(spark, sf_dir):
    items, n = build.ordered(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return items, _STRIPED.plan(n)


@query("striped_layout", f"SELECT layer, stripe, count(*) AS set_bits FROM ({_STRIPED_BITS}) GROUP BY layer, stripe")
def striped_layout(spark, sf_dir):
    items, plan = _striped(spark, sf_dir)
    packed = build.packed_bits(items, "p_name", plan, _STRIPED.stripes)
    return packed.groupBy("layer", "stripe").agg(F.sum(F.bitmap_count("bitmap")).alias("set_bits"))


_NAMES = "SELECT p_name AS item FROM part UNION ALL SELECT c_name FROM customer"


@query("striped_probe", f"SELECT item, present FROM {_probe(_NAMES, _STRIPED_BITS, _longest(_STRIPED, 10), False, _STRIPED.stripes)}")
def striped_probe(spark, sf_dir):
    items, plan = _striped(spark, sf_dir)
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("item")).union(_table(spark, sf_dir, "customer").select("c_name")).distinct()
    return probe.probe(names, "item", build.packed_bits(items, "p_name", plan, _STRIPED.stripes), plan, _STRIPED.stripes)


@query("striped_probe_local", ORACLES["striped_probe"])
def striped_probe_local(spark, sf_dir):
    items, plan = _striped(spark, sf_dir)
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("item")).union(_table(spark, sf_dir, "customer").select("c_name")).distinct()
    return probe.probe_local(names, "item", build.packed_bits(items, "p_name", plan, _STRIPED.stripes), plan, _STRIPED)


# Membership as joins --------------------------------------------------------------------------------------------------

@query("membership_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def membership_semi_join(spark, sf_dir):
    urgent = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("membership_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def membership_anti_join(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(_table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("bloom_prefilter_join", "SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderpriority = '1-URGENT'")
def bloom_prefilter_join(spark, sf_dir):
    urgent = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    plan = fixed(max(1, urgent.count()), 0.01)
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    packed = build.packed_bits(urgent.select("l_orderkey"), "l_orderkey", plan)
    if probe.packed_size(plan) > probe.BROADCAST_BYTES:
        return lines.join(urgent, "l_orderkey")
    return probe.prefiltered_join(lines, urgent, "l_orderkey", packed, plan)


# Web-index lines ------------------------------------------------------------------------------------------------------

_PAYLOAD = """'{"url":"' || replace(url, '"', '') || '","status":"' || CASE WHEN page_id % 5 = 0 THEN '404' WHEN page_id % 11 = 0 THEN '301' ELSE '200' END || '"' || CASE WHEN page_id % 7 = 0 THEN '' ELSE ',"mime":"text/html"' END || '}'"""
_LINE = f"CASE WHEN page_id % 17 = 0 THEN substr('com,example)/' || page_id || ' 20240222000000 ' || {_PAYLOAD}, 1, 40) WHEN page_id % 19 = 0 THEN 'onlytwo parts' ELSE 'com,example)/' || page_id || ' 20240222000000 ' || {_PAYLOAD} END"
_PARSED = f"""(SELECT page_id, valid AS is_valid, CASE WHEN valid THEN rest->>'$.url' END AS url, CASE WHEN valid THEN rest->>'$.status' END AS status, CASE WHEN valid THEN rest->>'$.mime' END AS mime, CASE WHEN valid THEN urlkey END AS urlkey, CASE WHEN valid THEN ts END AS ts FROM (
    SELECT page_id, urlkey, ts, CASE WHEN n >= 3 AND json_valid(payload) THEN payload::JSON END AS rest, coalesce(n >= 3 AND json_valid(payload), false) AS valid FROM (
    SELECT page_id, split_part(line, ' ', 1) AS urlkey, split_part(line, ' ', 2) AS ts, len(string_split(line, ' ')) AS n, substr(line, len(split_part(line, ' ', 1)) + len(split_part(line, ' ', 2)) + 3) AS payload FROM (SELECT page_id, {_LINE} AS line FROM pages))))"""


def _lines(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.expr(_LINE).alias("value"))


def _parsed(spark, sf_dir):
    return cdxj.parse(_lines(spark, sf_dir)).drop("value")


@query("cdxj_parse", f"SELECT page_id, is_valid, urlkey, ts, url, status, mime FROM {_PARSED}")
def cdxj_parse(spark, sf_dir):
    return _parsed(spark, sf_dir)


@query("cdxj_urls", f"SELECT url FROM {_PARSED} WHERE is_valid AND url IS NOT NULL AND url <> ''")
def cdxj_urls(spark, sf_dir):
    return cdxj.urls(_parsed(spark, sf_dir))


@query("cdxj_urls_limit", f"SELECT url FROM {_PARSED} WHERE is_valid AND url IS NOT NULL AND url <> '' ORDER BY page_id LIMIT 20")
def cdxj_urls_limit(spark, sf_dir):
    return cdxj.urls(_parsed(spark, sf_dir).orderBy("page_id"), 20)


@query("cdxj_quality", f"SELECT sum(is_valid::INT)::BIGINT AS valid, sum((NOT is_valid)::INT)::BIGINT AS corrupted, round(100.0 * sum(is_valid::INT) / count(*), 6)::DOUBLE AS valid_pct, round(100.0 * sum((NOT is_valid)::INT) / count(*), 6)::DOUBLE AS corrupted_pct FROM {_PARSED}")
def cdxj_quality(spark, sf_dir):
    return cdxj.quality(_parsed(spark, sf_dir))


@query("cdxj_top_status", f"SELECT coalesce(status, 'Unknown') AS status, count(*) AS n FROM {_PARSED} WHERE is_valid GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def cdxj_top_status(spark, sf_dir):
    return cdxj.top_values(_parsed(spark, sf_dir), "status")


@query("cdxj_top_mime", f"SELECT coalesce(mime, 'Unknown') AS mime, count(*) AS n FROM {_PARSED} WHERE is_valid GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def cdxj_top_mime(spark, sf_dir):
    return cdxj.top_values(_parsed(spark, sf_dir), "mime")


@query("cdxj_outcome", f"SELECT CASE WHEN sum((NOT is_valid)::INT) / count(*) > 0.05 THEN 'WARNING' ELSE 'SUCCESS' END AS outcome FROM {_PARSED}")
def cdxj_outcome(spark, sf_dir):
    q = cdxj.quality(_parsed(spark, sf_dir))
    return q.select(cdxj.outcome(F.col("corrupted"), F.col("valid") + F.col("corrupted")).alias("outcome"))


@query("cdxj_preview", f"SELECT page_id, {_LINE} AS value FROM pages ORDER BY page_id LIMIT 3")
def cdxj_preview(spark, sf_dir):
    return cdxj.preview(_lines(spark, sf_dir).orderBy("page_id"))


# Text, generators, checksums ------------------------------------------------------------------------------------------

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("text_scan_nonblank", f"SELECT doc_id, line_no::INTEGER AS line_no, trim(line, {_SPACE}) AS value FROM (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE trim(line, {_SPACE}) <> ''")
def text_scan_nonblank(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", text.stripped(F.col("line")).alias("value")).filter("value <> ''")


@query("load_split_present_absent", "SELECT ordinal::BIGINT AS ordinal, url, ordinal < 100 AS is_present FROM (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS ordinal FROM pages) WHERE ordinal < 150")
def load_split_present_absent(spark, sf_dir):
    pages = build.with_ordinal(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return text.split_present_absent(pages, 100, 50).select("ordinal", "url", "is_present")


@query("synthetic_items", "SELECT i AS ordinal, 'IN_' || i AS item FROM range(1000) t(i) UNION ALL SELECT i, 'OUT_' || i FROM range(1000) t(i)")
def synthetic_items(spark, sf_dir):
    return generators.labelled(spark, "IN_", 1000).unionByName(generators.labelled(spark, "OUT_", 1000))


@query("session_stream_items", "SELECT i AS ordinal, 'USER_SESSION_' || (i % 10000) || '_' || i AS item FROM range(25000) t(i)")
def session_stream_items(spark, sf_dir):
    return generators.sessions(spark, 25_000)


@query("sha256_items", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_items(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("json_props_groupcount", "SELECT coalesce(props->>'$.k', 'Unknown') AS k, count(*) AS n FROM events GROUP BY 1")
def json_props_groupcount(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("Unknown"))
    return _table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


# Statistics of timings ------------------------------------------------------------------------------------------------

#: Timings derived from events: the architecture is the event type, seven runs for each of eight worker counts.
_RUNS = "(SELECT event_type AS architecture, (user_id % 8 + 1)::INTEGER AS workers, (event_id % 7)::INTEGER AS run_idx, max(value) AS seconds FROM events GROUP BY ALL)"
_MEANS = f"(SELECT architecture, workers, round(avg(seconds), 6) AS mean FROM {_RUNS} WHERE run_idx >= 2 GROUP BY ALL)"
_MARGIN = "CASE WHEN count(seconds) > 1 THEN 2.776 * stddev_samp(seconds) / sqrt(count(seconds)) ELSE 0 END"


def _runs(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    keys = [F.col("event_type").alias("architecture"), (F.col("user_id") % 8 + 1).cast("int").alias("workers"), (F.col("event_id") % 7).cast("int").alias("run_idx")]
    return e.groupBy(*keys).agg(F.max("value").alias("seconds"))


def _means(spark, sf_dir):
    return stats.mean_ci(stats.measured(_runs(spark, sf_dir)), "architecture", "workers").select("architecture", "workers", "mean")


@query("warmup_filter", f"SELECT architecture, workers, run_idx, seconds FROM {_RUNS} WHERE run_idx >= 2")
def warmup_filter(spark, sf_dir):
    return stats.measured(_runs(spark, sf_dir))


@query("stats_ci", f"SELECT architecture, workers, count(*) AS n, round(avg(seconds), 6) AS mean, round({_MARGIN}, 6) AS margin FROM {_RUNS} WHERE run_idx >= 2 GROUP BY ALL")
def stats_ci(spark, sf_dir):
    return stats.mean_ci(stats.measured(_runs(spark, sf_dir)), "architecture", "workers")


@query("stats_full", f"SELECT architecture, workers, count(*) AS n, round(avg(seconds), 6) AS mean, round(median(seconds), 6) AS median, round({_MARGIN}, 6) AS margin, round(avg(seconds) - {_MARGIN}, 6) AS ci_lower, round(avg(seconds) + {_MARGIN}, 6) AS ci_upper FROM {_RUNS} WHERE run_idx >= 2 GROUP BY ALL")
def stats_full(spark, sf_dir):
    return stats.full_stats(stats.measured(_runs(spark, sf_dir)), "architecture", "workers").drop("raw_runs")


_TOTALS = f"(SELECT architecture, round(sum(mean), 6) AS total FROM {_MEANS} GROUP BY 1)"


def _totals(spark, sf_dir):
    return _means(spark, sf_dir).groupBy("architecture").agg(F.round(F.sum("mean"), 6).alias("total"))


@query("speedup_vs_baseline", f"SELECT architecture, total, round(CASE WHEN total > 0 THEN (SELECT total FROM {_TOTALS} WHERE architecture = 'click') / total ELSE 0 END, 6) AS speedup FROM {_TOTALS}")
def speedup_vs_baseline(spark, sf_dir):
    return stats.speedup_vs_baseline(_totals(spark, sf_dir), "click").withColumn("speedup", F.round("speedup", 6))


@query("speedup_vs_one_worker", f"SELECT architecture, workers, mean, round(CASE WHEN mean > 0 THEN first_value(mean) OVER (PARTITION BY architecture ORDER BY workers) / mean ELSE 0 END, 6) AS speedup FROM {_MEANS}")
def speedup_vs_one_worker(spark, sf_dir):
    return stats.speedup_vs_one_worker(_means(spark, sf_dir)).withColumn("speedup", F.round("speedup", 6))


@query("weak_baseline", f"SELECT architecture, workers, mean, (SELECT mean FROM {_MEANS} ORDER BY architecture, workers LIMIT 1) AS baseline FROM {_MEANS}")
def weak_baseline(spark, sf_dir):
    return stats.weak_baseline(_means(spark, sf_dir))


@query("optimal_chunk", f"SELECT chunk_size, mean FROM (SELECT workers * 10000 AS chunk_size, round(avg(mean), 6) AS mean FROM {_MEANS} GROUP BY 1) ORDER BY mean, chunk_size LIMIT 1")
def optimal_chunk(spark, sf_dir):
    means = _means(spark, sf_dir).groupBy((F.col("workers") * 10_000).alias("chunk_size")).agg(F.round(F.avg("mean"), 6).alias("mean"))
    return stats.optimal_chunk(means)


@query("ci_band", f"SELECT architecture, workers, mean, margin, round(mean - margin, 6) AS low, round(mean + margin, 6) AS high FROM ({ORACLES['stats_ci']})")
def ci_band(spark, sf_dir):
    band = stats.ci_band(stats_ci(spark, sf_dir).select("architecture", "workers", "mean", "margin"))
    return band.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


_PHASES = "(SELECT l_returnflag AS architecture, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS ins, avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS reads, count(*) AS items FROM lineitem GROUP BY 1)"


def _phases(spark, sf_dir):
    q = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("architecture")).agg(q("O").alias("ins"), q("F").alias("reads"), F.count(F.lit(1)).alias("items"))


@query("total_exec_time", f"SELECT architecture, round(coalesce(ins, 0) + coalesce(reads, 0), 6) AS total FROM {_PHASES}")
def total_exec_time(spark, sf_dir):
    return _phases(spark, sf_dir).select("architecture", F.round(stats.total_time(F.col("ins"), F.col("reads")), 6).alias("total"))


@query("throughput", f"SELECT architecture, items, round(CASE WHEN ins > 0 THEN items / ins ELSE 0 END, 4) AS items_per_second, round(CASE WHEN reads < ins AND reads > 0 THEN ins / reads END, 6) AS async_speedup FROM {_PHASES}")
def throughput(spark, sf_dir):
    rated = stats.throughput(_phases(spark, sf_dir), "items", "ins")
    return rated.select("architecture", "items", F.round("items_per_second", 4).alias("items_per_second"), F.round(stats.async_speedup(F.col("ins"), F.col("reads")), 6).alias("async_speedup"))


#: Outputs of runs: none, one or two reports of throughput, and a speedup where the asynchronous run took less time.
_REPORTED = """(SELECT c_custkey AS run, concat_ws(chr(10), 'begin',
    CASE WHEN c_custkey % 3 > 0 THEN '[METRIC] Throughput: ' || format('{:,}', c_custkey * 1237) || ' items/second' END,
    CASE WHEN c_custkey % 3 > 1 THEN '[METRIC] Throughput:  ' || format('{:,}', c_custkey * 2741) || ' items/second' END,
    CASE WHEN c_custkey % 2 > 0 THEN '[ANALYSIS] The Asynchronous implementation achieved a ' || format('{:.2f}', (100 + c_custkey % 400) / 100) || 'x speedup.' END, 'end') AS output FROM customer)"""


@query("metric_scrape", f"""SELECT run, CASE WHEN len(rates) >= 2 THEN replace(rates[1], ',', '')::DOUBLE END AS sequential, CASE WHEN len(rates) >= 2 THEN replace(rates[2], ',', '')::DOUBLE END AS asynchronous,
    coalesce(nullif(regexp_extract(output, 'achieved a ([0-9.]+)x speedup', 1), '')::DOUBLE, 1.0) AS speedup
    FROM (SELECT run, output, regexp_extract_all(output, '\\[METRIC\\] Throughput:\\s+([0-9,]+)\\s+items/second', 1) AS rates FROM {_REPORTED})""")
def metric_scrape(spark, sf_dir):
    c, key = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    rate = lambda reports, gap, n: F.when(key % 3 > reports, F.concat(F.lit("[METRIC] Throughput:" + gap), F.format_number(key * n, 0), F.lit(" items/second")))
    faster = F.when(key % 2 > 0, F.concat(F.lit("[ANALYSIS] The Asynchronous implementation achieved a "), F.format_string("%.2f", (key % 400 + 100) / 100), F.lit("x speedup.")))
    output = F.concat_ws("\n", F.lit("begin"), rate(0, " ", 1237), rate(1, "  ", 2741), faster, F.lit("end"))
    return c.select(key.alias("run"), output.alias("output")).select("run", *telemetry.scraped(F.col("output")))


_TELEMETRY = "SELECT architecture, 'insert' AS phase, 'wall' AS clock, workers, 1000::BIGINT AS workload, run_idx, seconds"


@query("telemetry_merge", f"{_TELEMETRY} FROM {_RUNS} WHERE workers <= 4 UNION ALL SELECT * REPLACE (seconds * 2 AS seconds) FROM ({_TELEMETRY} FROM {_RUNS}) WHERE workers > 4")
def telemetry_merge(spark, sf_dir):
    """Runs written as JSON and read again, those of more than four workers replaced by a second file's."""
    columns = [f.name for f in telemetry.RUNS]
    runs = _runs(spark, sf_dir).withColumns({"phase": F.lit("insert"), "clock": F.lit("wall"), "workload": F.lit(1000).cast("long")}).select(columns)
    base = store.scratch(spark)
    telemetry.write_runs(runs, f"{base}/first")
    telemetry.write_runs(runs.filter("workers > 4").withColumn("seconds", F.col("seconds") * 2), f"{base}/second")
    return telemetry.merge_runs(telemetry.read_runs(spark, f"{base}/first"), telemetry.read_runs(spark, f"{base}/second"))


@query("gzip_lines", "SELECT trim(url) AS value FROM pages WHERE trim(url) <> ''")
def gzip_lines(spark, sf_dir):
    path = f"{store.scratch(spark)}/lines"
    _table(spark, sf_dir, "pages").select("url").write.option("compression", "gzip").text(path)
    return text.scan_lines(spark, path)


@query("file_checksum", "SELECT sum(octet_length(encode(n_name)) + 1)::BIGINT AS length, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation")
def file_checksum(spark, sf_dir):
    path = f"{store.scratch(spark)}/file"
    _table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return text.file_checksums(spark, f"{path}/*.txt").select("length", "sha256")


# Streaming ------------------------------------------------------------------------------------------------------------

_STREAM = FilterConfig(100, 0.02)


def _streamed(spark, sf_dir, max_layers: int, batches: int = 4):
    """Events split by event_id into files, streamed one file a batch."""
    base = store.scratch(spark)
    e = _table(spark, sf_dir, "events").select("event_id", "user_id")
    span = e.agg(F.max("event_id")).first()[0] + 1
    for b in range(batches):  # in this order, so that the source lists them so
        e.filter((F.col("event_id") * batches / span).cast("int") == b).coalesce(1).write.parquet(f"{base}/in/part={b}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/part=*")
    ingestor = ingest.Ingestor(spark, f"{base}/state", "user_id", _STREAM, order="event_id", max_layers=max_layers)
    q = ingest.ingest(stream, ingestor, f"{base}/log")
    q.awaitTermination()
    return ingestor, q


@query("stream_ingest_layers", f"SELECT layer, count(*) AS n_items, capacity FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events) JOIN (SELECT layer, lo, hi, hi - lo AS capacity FROM {_values(_longest(_STREAM))}) ON ordinal >= lo AND ordinal < hi GROUP BY layer, capacity")
def stream_ingest_layers(spark, sf_dir):
    ingestor, _ = _streamed(spark, sf_dir, max_layers=30)
    return ingestor.layers(ingestor.last).select("layer", "n_items", "capacity")


_STREAM_SIZES = "(SELECT (event_id * 4.0 / (max(event_id) OVER () + 1))::DOUBLE AS place FROM events)"


def _aged(max_layers: int) -> str:
    """The layers alive after the batches, by their sizes alone: fill, begin a layer, or end a batch, one at a time."""
    return f"""WITH RECURSIVE sizes AS (SELECT floor(place)::INTEGER AS b, count(*) AS n FROM {_STREAM_SIZES} GROUP BY 1),
    s(b, rest, layers, next_id) AS (
        SELECT 0, (SELECT n FROM sizes WHERE b = 0), [{{'layer': 0, 'depth': 0, 'n_items': 0::BIGINT}}], 1
        UNION ALL
        SELECT CASE WHEN rest = 0 THEN b + 1 ELSE b END,
            CASE WHEN rest = 0 THEN (SELECT n FROM sizes WHERE sizes.b = s.b + 1) ELSE rest - least(rest, {_STREAM.capacity} * (1 << layers[-1].depth) - layers[-1].n_items) END,
            CASE WHEN rest = 0 THEN CASE WHEN len(layers) > {max_layers} THEN layers[2:] ELSE layers END
                WHEN layers[-1].n_items >= {_STREAM.capacity} * (1 << layers[-1].depth) THEN list_append(layers, {{'layer': next_id, 'depth': len(layers)::INTEGER, 'n_items': 0::BIGINT}})
                ELSE list_append(layers[:-2], {{'layer': layers[-1].layer, 'depth': layers[-1].depth, 'n_items': layers[-1].n_items + least(rest, {_STREAM.capacity} * (1 << layers[-1].depth) - layers[-1].n_items)}}) END,
            CASE WHEN rest > 0 AND layers[-1].n_items >= {_STREAM.capacity} * (1 << layers[-1].depth) THEN next_id + 1 ELSE next_id END
        FROM s WHERE rest IS NOT NULL)
    SELECT x.layer, x.depth, hi - lo AS capacity, m, k, x.n_items FROM (SELECT unnest(layers) AS x FROM s WHERE rest IS NULL) JOIN {_values(_longest(_STREAM))} ON p.layer = x.depth"""


@query("stream_aging", _aged(2))
def stream_aging(spark, sf_dir):
    ingestor, _ = _streamed(spark, sf_dir, max_layers=2)
    return ingestor.layers(ingestor.last)


@query("stream_batch_rows", f"SELECT floor(place)::BIGINT AS batch, count(*) AS n_rows FROM {_STREAM_SIZES} GROUP BY 1")
def stream_batch_rows(spark, sf_dir):
    _, q = _streamed(spark, sf_dir, max_layers=30)
    return spark.createDataFrame([(s["batch"], s["rows"]) for s in ingest.batch_stats(q)], "batch long, n_rows long")


@query("stream_batch_stats")
def stream_batch_stats(spark, sf_dir):
    """Timings of each batch: whole, and split into reading the source (io_ms) and inserting (cpu_ms)."""
    _, q = _streamed(spark, sf_dir, max_layers=30)
    rows = [(s["batch"], s["rows"], float(s["seconds"]), float(s["items_per_second"]), *ingest.io_and_cpu(s["parts_ms"])) for s in ingest.batch_stats(q)]
    return spark.createDataFrame(rows, "batch long, rows long, seconds double, items_per_second double, io_ms long, cpu_ms long")


# The compat hash family -------------------------------------------------------------------------------------------------

_COMPAT = FilterConfig(100, 0.01)
_URLS = "SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS ordinal FROM pages"


def _compat_bits(items: str, plan: list[Layer]) -> str:
    """items: SQL of rows (id, item, ordinal). Distinct (layer, stripe, bit)."""
    return f"""SELECT DISTINCT layer, 0 AS stripe, ((h1 + i * h2) % m::UHUGEINT)::BIGINT AS bit FROM (
    SELECT p.layer, p.m, p.k, h1, h2, unnest(range(p.k))::UHUGEINT AS i FROM {murmur3_128(f'SELECT id, item FROM ({items})')} JOIN (SELECT id, ordinal FROM ({items})) USING (id) JOIN {_values(plan)} ON ordinal >= lo AND ordinal < hi)"""


def _compat_probe(bits: str, asked: str, plan: list[Layer]) -> str:
    """asked: SQL of rows (item), distinct. Items with present."""
    return f"""(WITH b AS ({bits}), d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item) AS id, item FROM ({asked})),
    q AS (SELECT DISTINCT id, layer, ((h1 + i * h2) % m::UHUGEINT)::BIGINT AS bit FROM (SELECT id, p.layer, p.m, h1, h2, unnest(range(p.k))::UHUGEINT AS i FROM {murmur3_128('SELECT * FROM d')} CROSS JOIN {_values(plan)})),
    h AS (SELECT id, q.layer, count(*) = count(b.bit) AS present FROM q LEFT JOIN b ON q.layer = b.layer AND q.bit = b.bit GROUP BY ALL)
    SELECT item, bool_or(present) AS present FROM h JOIN d USING (id) GROUP BY item)"""


_COMPAT_BITS = _compat_bits(f"SELECT page_id AS id, url AS item, ordinal FROM ({_URLS})", _longest(_COMPAT, 12))
_ASKED = "(SELECT url AS item FROM pages UNION ALL SELECT url || '#absent' FROM pages)"


def _compat_items(spark, sf_dir):
    items, n = build.ordered(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return items, _COMPAT.plan(n)


@query("compat_hash", f"SELECT page_id, h1::VARCHAR AS h1, h2::VARCHAR AS h2 FROM {murmur3_128('SELECT page_id AS id, url AS item FROM pages')} JOIN pages ON id = page_id")
def compat_hash(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    unsigned = lambda c: F.when(F.col(c) < 0, F.col(c).cast("decimal(20)") + F.lit("18446744073709551616").cast("decimal(20)")).otherwise(F.col(c)).cast("decimal(20)").cast("string").alias(c)
    return with_compat_pair(pages, item_bytes(pages, "url")).select("page_id", unsigned("h1"), unsigned("h2"))


@query("compat_bits", _COMPAT_BITS)
def compat_bits(spark, sf_dir):
    items, plan = _compat_items(spark, sf_dir)
    return build.compat_bits(items, "url", plan, _COMPAT)


@query("compat_probe", f"SELECT item, present FROM {_ASKED} JOIN {_compat_probe(_COMPAT_BITS, f'SELECT DISTINCT item FROM {_ASKED}', _longest(_COMPAT, 12))} USING (item)")
def compat_probe(spark, sf_dir):
    items, plan = _compat_items(spark, sf_dir)
    packed = build.pack(build.compat_bits(items, "url", plan, _COMPAT))
    names = items.select(F.col("url").alias("item")).unionByName(items.select(F.concat("url", F.lit("#absent")).alias("item")))
    return probe.probe_local(names, "item", packed, plan, _COMPAT, family="compat")


#: The workloads of the reference's own tests (name, prefix, items, capacity, target rate).
_FIXTURES = [("no_false_negatives", "item_pos_", 500, 1000, 0.01), ("false_positive_rate", "known_", 8000, 5000, 0.05), ("scaling", "scale_test_", 300, 100, 0.01)]


def _generated(prefix: str, n: int) -> str:
    return f"SELECT i AS id, '{prefix}' || i AS item, i AS ordinal FROM range({n}) t(i)"


def _fixture_bits(prefix: str, n: int, capacity: int, rate: float) -> str:
    return _compat_bits(_generated(prefix, n), FilterConfig(capacity, rate).plan(n))


def _fixture(spark, prefix: str, n: int, capacity: int, rate: float):
    items, config = generators.labelled(spark, prefix, n), FilterConfig(capacity, rate)
    plan = config.plan(n)
    return items, config, plan, build.compat_bits(items, "item", plan, config)


@query("compat_fixture_layers", " UNION ALL ".join(f"(SELECT '{name}' AS fixture, layer, count(*) AS set_bits FROM ({_fixture_bits(*x)}) GROUP BY layer)" for name, *x in _FIXTURES))
def compat_fixture_layers(spark, sf_dir):
    """The bits set in each layer of the reference's test filters."""
    found = [metrics.layer_metrics(bits, plan).select(F.lit(name).alias("fixture"), "layer", "set_bits") for name, *x in _FIXTURES for _, _, plan, bits in [_fixture(spark, *x)]]
    return reduce(DataFrame.unionByName, found)


def _fixture_counts(name: str, prefix: str, n: int, capacity: int, rate: float) -> str:
    asked = f"SELECT '{prefix}' || i AS item FROM range({n}) t(i) UNION ALL SELECT 'unknown_' || i FROM range(5000) t(i)"
    found = _compat_probe(_fixture_bits(prefix, n, capacity, rate), asked, FilterConfig(capacity, rate).plan(n))
    return f"(SELECT '{name}' AS fixture, count_if(item NOT LIKE 'unknown%' AND NOT present)::BIGINT AS false_negatives, count_if(item LIKE 'unknown%' AND present)::BIGINT AS false_positives FROM {found})"


@query("compat_fixture_probes", " UNION ALL ".join(_fixture_counts(*x) for x in _FIXTURES))
def compat_fixture_probes(spark, sf_dir):
    """Items of the reference's test filters found absent, and absent items found present."""
    out = []
    for name, *x in _FIXTURES:
        items, config, plan, bits = _fixture(spark, *x)
        asked = items.select("item", F.lit(False).alias("absent")).unionByName(generators.labelled(spark, "unknown_", 5000).select("item", F.lit(True).alias("absent")))
        found = probe.probe_local(asked, "item", build.pack(bits), plan, config, family="compat")
        count = lambda wrong: F.coalesce(F.sum(wrong.cast("long")), F.lit(0).cast("long"))
        out.append(found.agg(count(~F.col("absent") & ~F.col("present")).alias("false_negatives"), count(F.col("absent") & F.col("present")).alias("false_positives")).select(F.lit(name).alias("fixture"), "*"))
    return reduce(DataFrame.unionByName, out)


_COMPAT_STRIPED = FilterConfig(100, 0.01, tightening=None, stripes=4)


def _compat_striped(stripe: str) -> str:
    """The bits set in each stripe; stripe: SQL of an item's stripe by h1 and route."""
    items = "SELECT page_id AS id, url AS item FROM pages"
    return f"""SELECT layer, stripe, count(*) AS set_bits FROM (SELECT DISTINCT layer, ({stripe})::INTEGER AS stripe, (h1 + i * h2) % m::UHUGEINT AS bit FROM (
    SELECT p.layer, p.m, h1, h2, route, unnest(range(p.k))::UHUGEINT AS i FROM {murmur3_128(items)} JOIN {murmur3_32(items)} USING (id) JOIN ({_URLS}) ON id = page_id JOIN {_values(_longest(_COMPAT_STRIPED, 12))} ON ordinal >= lo AND ordinal < hi)) GROUP BY layer, stripe"""


def _compat_stripes(spark, sf_dir, scheme: str) -> DataFrame:
    items, n = build.ordered(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    bits = build.compat_bits(items, "url", _COMPAT_STRIPED.plan(n), _COMPAT_STRIPED, scheme)
    return bits.groupBy("layer", "stripe").agg(F.count(F.lit(1)).alias("set_bits"))


@query("compat_striped_h1", _compat_striped(f"h1 % 2147483647::UHUGEINT % {_COMPAT_STRIPED.stripes}::UHUGEINT"))
def compat_striped_h1(spark, sf_dir):
    """Stripes by the first 64 bits of the item's hash."""
    return _compat_stripes(spark, sf_dir, "h1")


@query("compat_striped_hash32", _compat_striped(f"(route % {_COMPAT_STRIPED.stripes} + {_COMPAT_STRIPED.stripes}) % {_COMPAT_STRIPED.stripes}"))
def compat_striped_hash32(spark, sf_dir):
    """Stripes by the 32-bit hash, with the floor modulus of its sign."""
    return _compat_stripes(spark, sf_dir, "hash32")
