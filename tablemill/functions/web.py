"""Expressions over addresses: which may be fetched, and a host without www."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and address ranges that no public site has.
PRIVATE = r"^(?:localhost|.*\.local|.*\.internal|[0-9.]+|\[.*\])$"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def is_public_https(url: Column) -> Column:
    """https to a dotted name that isn't private, loopback or a bare address."""
    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(url.rlike("^(?i)https://") & name.contains(".") & ~name.rlike(PRIVATE), F.lit(False))


def shop_references(refs: DataFrame, presets: DataFrame) -> DataFrame:
    """refs(ref) as (ref, id, label, site): the preset(id, label, site) of that id, else a shop of one's own at an address
    that may be fetched, whose label is its host; all null where it is neither."""
    own = is_public_https(F.col("ref"))
    site = F.concat(F.lit("https://"), F.lower(F.try_parse_url("ref", F.lit("HOST"))))
    found = refs.join(presets.withColumnsRenamed({"id": "pid", "label": "plabel", "site": "psite"}), F.col("ref") == F.col("pid"), "left")
    pick = lambda preset, made: F.coalesce(preset, F.when(own, made))
    return found.select("ref", pick("pid", F.lit("custom")).alias("id"), pick("plabel", host(F.col("ref"))).alias("label"), pick("psite", site).alias("site"))
