"""Web-index lines (CDXJ): `key timestamp json`, parsed, extracted, and reported on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
#: A payload that is an object and nothing more: get_json_object alone takes trailing text.
_OBJECT = r"^\s*\{[\s\S]*\}\s*$"


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with urlkey, ts, url, status, mime and is_valid. A line is corrupt with fewer than three parts, or
    where the third is no JSON object; its fields are null."""
    parts = F.split(F.col(value), " ", 3)
    payload = F.get(parts, 2)
    valid = (F.size(parts) >= 3) & payload.rlike(_OBJECT) & F.get_json_object(payload, "$").isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    named = {"urlkey": F.get(parts, 0), "ts": F.get(parts, 1)} | {f: F.get_json_object(payload, f"$.{f}") for f in ("url", "status", "mime")}
    out = lines.withColumn("is_valid", valid)
    return out.withColumns({name: F.when(F.col("is_valid"), c) for name, c in named.items()})


def urls(parsed: DataFrame, limit: int | None = None) -> DataFrame:
    """The urls of valid records that have one; repeats stay. limit: at most so many, all where it is 0 or less."""
    found = parsed.filter("is_valid and url is not null and url <> ''").select("url")
    return found if limit is None or limit <= 0 else found.limit(limit)


def write_urls(parsed: DataFrame, path: str, limit: int | None = None) -> None:
    urls(parsed, limit).write.mode("overwrite").text(path)


def quality(parsed: DataFrame, sample_size: int | None = None) -> DataFrame:
    """valid, corrupted and their percentages. Of the rows read, or of `sample_size` where one is asked for."""
    rows = parsed if sample_size is None else parsed.limit(sample_size)
    n = F.count(F.lit(1)) if sample_size is None else F.lit(sample_size)
    valid, corrupt = (F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long") for c in (F.col("is_valid"), ~F.col("is_valid")))
    share = lambda x: F.when(n > 0, F.round(100.0 * x / n, 6)).otherwise(0.0)
    return rows.agg(valid.alias("valid"), corrupt.alias("corrupted"), share(valid).alias("valid_pct"), share(corrupt).alias("corrupted_pct"))


def top_values(parsed: DataFrame, field: str, k: int = 5) -> DataFrame:
    """The k most frequent values of a field among valid records, missing ones as Unknown; ties by value."""
    counts = parsed.filter("is_valid").groupBy(F.coalesce(F.col(field), F.lit(UNKNOWN)).alias(field)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), field).limit(k)


def outcome(corrupted: Column, total: Column, threshold: float = 0.05) -> Column:
    return F.when(corrupted / total > threshold, "WARNING").otherwise("SUCCESS")


def size_warning(length: Column, least: int = 100 << 20) -> Column:
    return length < least


def preview(lines: DataFrame, n: int = 3) -> DataFrame:
    return lines.limit(n)
