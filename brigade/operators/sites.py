"""The known sites: listing, lookup by host, search URLs and source data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import LICENSE, SITES, UNKNOWN_LICENSE
from ..functions.urls import encode_component


def sites(spark: SparkSession) -> DataFrame:
    """The six sites in their default order (site_rank from 0)."""
    rows = [(i, s, n, LICENSE, n, [h], u, p) for i, (s, n, h, u, p) in enumerate(SITES)]
    return spark.createDataFrame(rows, "site_rank int, site_id string, source_name string, source_license string, source_attribution string, host_suffixes array<string>, search_prefix string, query_prefix string")


def build_search_url(site_id: Column, query: Column) -> Column:
    return F.coalesce(*[F.when(site_id == s, F.concat(F.lit(u), encode_component(F.concat(F.lit(p), query)))) for s, _, _, u, p in SITES])


def site_of(host: Column) -> Column:
    """The id of the first site that a host belongs to; null if none."""
    h = F.lower(host)
    return F.coalesce(*[F.when((h == suffix) | h.endswith("." + suffix), F.lit(s)) for s, _, suffix, _, _ in SITES])


def source_meta(host: Column) -> Column:
    """struct(source_name, source_license, source_attribution); an unknown host stands for itself."""
    site = site_of(host)
    name = F.coalesce(*[F.when(site == s, F.lit(n)) for s, n, *_ in SITES], host)
    return F.struct(name.alias("source_name"), F.when(site.isNotNull(), LICENSE).otherwise(UNKNOWN_LICENSE).alias("source_license"), name.alias("source_attribution"))
