"""URL expressions: domain prefix, split and rebuild, host, thumbnail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = r"^(https?://[^/]+)"


def domain(url: Column) -> Column:
    """Scheme and host of an http url; '' for null and for anything else."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), DOMAIN, 1)


def suffix(url: Column) -> Column:
    """What follows the domain; the whole text where there is none."""
    return F.substring(url, F.length(domain(url)) + 1, F.length(url))


def rebuild(prefix: Column, rest: Column) -> Column:
    """Prefix and suffix together; null for either is '', and null if both are empty."""
    return F.nullif(F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(rest, F.lit(""))), F.lit(""))


def host(url: Column) -> Column:
    """Host in lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def thumbnail(url: Column, throttled: list[str]) -> Column:
    """On a throttled host, the medium size instead of the original."""
    return F.when(host(url).isin(throttled), F.replace(url, F.lit("/original/"), F.lit("/medium/"))).otherwise(url)
