"""Short links: checked and normalised URLs, codes, collision odds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URL = 2048
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised_url(raw: Column) -> Column:
    """The URL with http:// where it has no scheme and with its scheme and host in lower case; null where it may not be shortened.

    Refused: empty, over-long or with control characters, schemes other than http and https, no host, a host without a dot
    other than localhost, credentials.
    """
    url = F.regexp_replace(raw, r"\A\s+|\s+\z", "")
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    scheme, rest = F.lower(F.substring_index(full, "://", 1)), F.regexp_extract(full, r"\A[^:]*://([^/?#]*)", 1)
    host = F.regexp_extract(rest, r"\A([^:]*)", 1)
    tail = F.substr(full, F.length(F.regexp_extract(full, r"\A[^:]*://[^/?#]*", 0)) + 1)
    bare_scheme = ~F.contains(url, F.lit("://")) & F.substring_index(url, "/", 1).rlike(r":(?!\d+\z)")
    ok = (F.length(url) > 0) & (F.length(url) <= MAX_URL) & ~url.rlike(r"[\x00-\x1f\x7f]") & ~bare_scheme & scheme.isin("http", "https") & (F.length(host) > 0)
    ok = ok & (F.contains(host, F.lit(".")) | (F.lower(host) == "localhost")) & ~F.contains(rest, F.lit("@"))
    return F.when(ok, F.concat(scheme, F.lit("://"), F.lower(rest), tail))


def valid_alias(c: Column, reserved: tuple[str, ...] = ("api", "admin", "static", "stats")) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9_-]{3,32}\z") & ~F.lower(c).isin(*reserved), F.lit(False))


def code_of(*cols: Column, length: int = 7, seed: int = 0) -> Column:
    """A code of base 62 that hangs on the columns and the seed."""
    h = F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(62**length))
    digits = [F.substring(F.lit(ALPHABET), F.pmod(F.floor(h / 62**i), F.lit(62)).cast("int") + 1, F.lit(1)) for i in range(length)]
    return F.concat(*digits)


def expected_collisions(length: int, n: int) -> float:
    """Expected number of codes drawn again among n even draws of `length` characters."""
    space = 62.0**length
    return n - space * -math.expm1(n * math.log1p(-1 / space))
