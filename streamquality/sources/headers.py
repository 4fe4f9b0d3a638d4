"""Provenance of recordings from their header text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import attach

#: Fixed value: the line that ends a header.
END = "#End Of ASCII Header"
ENTRY = r'<entry key="([^"]+)" value="([^"]*)"\s*/>'


def attribute_keys(files: DataFrame, text: str, pattern: str) -> DataFrame:
    """Every attribute key in each file's header text, one row per occurrence."""
    return files.select("file", F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("key"))


def key_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def unexpected_keys(keys: DataFrame, allowed: list[str]) -> DataFrame:
    """Keys outside the allow-list of recorded-output descriptions, with their counts."""
    return key_counts(keys.where(~F.col("key").isin(allowed)))


def whole(lines: DataFrame, marker: str = END) -> DataFrame:
    """The lines; a file without a line that begins with the end marker fails the job, as what was read
    of its header may be a part."""
    ended = lines.groupBy("file").agg(F.bool_or(F.col("line").startswith(marker)).alias("_ended"))
    checked = attach(lines, ended, ["file"], name="headers")
    refusal = F.raise_error(F.concat(F.lit("no end of header in "), "file"))
    return checked.where(F.when(F.coalesce("_ended", F.lit(False)), F.lit(True)).otherwise(refusal.cast("boolean"))).drop("_ended")


def fields(lines: DataFrame, names: list[str]) -> DataFrame:
    """``# name: value`` header fields per file, for the named fields."""
    m = [F.regexp_extract("line", r"^# ([A-Za-z]+):\s*(.*)$", i) for i in (1, 2)]
    return lines.select("file", m[0].alias("name"), F.trim(m[1]).alias("value")).where(
        F.col("name").isin(names))


def field_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("name", "value").agg(F.count_distinct("file").alias("files"))


def settings(lines: DataFrame, prefix: str) -> DataFrame:
    """Preference entries whose key starts with ``prefix``, prefix removed."""
    key, value = (F.regexp_extract("line", ENTRY, i) for i in (1, 2))
    return lines.select("file", key.alias("key"), value.alias("value")).where(
        F.col("key").startswith(prefix)).withColumn("key", F.expr(f"substring(key, {len(prefix) + 1})"))


def setting_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("key", "value").agg(F.count_distinct("file").alias("files"))


def chain_census(files: DataFrame) -> DataFrame:
    """Per stored filter chain: files, files per session, files with no enabled member.

    ``files`` holds file, session, chain and enabled (arrays); files without a chain are left out.
    """
    known = files.where(F.col("chain").isNotNull()).withColumn(
        "running", F.array_intersect("chain", "enabled"))
    per = known.groupBy("chain", "session").agg(
        F.count("*").alias("n"), F.count_if(F.size("running") == 0).alias("idle"))
    return per.groupBy("chain").agg(
        F.sum("n").alias("files"), F.sum("idle").alias("idle"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("session", "n")))).alias("sessions"))


def enabled_filters(files: DataFrame) -> DataFrame:
    """How often each filter is enabled inside and outside the stored chain."""
    known = files.where(F.col("chain").isNotNull())
    both = known.select(F.inline(F.concat(
        F.transform(F.array_intersect("chain", "enabled"), lambda f: F.struct(f.alias("filter"), F.lit(True).alias("in_chain"))),
        F.transform(F.array_except("enabled", "chain"), lambda f: F.struct(f.alias("filter"), F.lit(False).alias("in_chain"))))))
    return both.groupBy("filter", "in_chain").agg(F.count("*").alias("files"))
