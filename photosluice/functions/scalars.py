"""Scalar expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0

# fixed values: file name extensions of MIME types
EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/heic": ".heic",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/tiff": ".tiff",
    "video/mp4": ".mp4",
    "video/quicktime": ".mov",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_score(c: str | Column) -> Column:
    """Score in 0..1: null and NaN count as 0."""
    s = col(c)
    return F.when(s.isNull() | F.isnan(s), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def bits_of_hash(c: str | Column) -> Column:
    """The 64 bits of a hash of 16 hex digits as a signed long; null for anything else."""
    h = col(c)
    return F.when(h.rlike("^[0-9A-Fa-f]{16}$"), F.conv(h, 16, -10).cast("long"))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Number of differing bits of two longs."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def most_distance(threshold: float, bits: int = 64) -> int:
    """Largest Hamming distance that a similarity threshold in 0..1 allows."""
    return int((1 - threshold) * bits)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two places on the sphere; null if any part is."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def place(c: str | Column) -> Column:
    """A coordinate, null where it is NaN."""
    return F.when(~F.isnan(col(c)), col(c))


def dot(a: str | Column, b: str | Column) -> Column:
    """Scalar product in double of two arrays of equal length."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def safe_name(c: str | Column, default: str = "asset") -> Column:
    """A name that is safe in a path: other characters than letters, digits, ``.``, ``_``, ``-`` become ``_``."""
    plain = F.regexp_replace(col(c), r"[^A-Za-z0-9._-]", "_")
    plain = F.regexp_replace(plain, r"^[._]+|[._]+$", "")
    return F.when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(F.lit(default))


def asset_file_name(asset_id: str | Column, mime_type: str | Column) -> Column:
    """File name of an exported asset; unknown types get ``.jpg``."""
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    ext = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(col(mime_type))), F.lit(".jpg"))
    return F.concat(safe_name(asset_id), ext)


def short_digest(text: str) -> str:
    """First eight hex digits of a text's SHA-256, as cache keys carry them."""
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:8]


def grid_key(lat, lon, precision: int, *rest) -> Column:
    """Cache key of a place: coordinates rounded half to even, then the other settings."""
    parts = [F.bround(col(lat), precision), F.bround(col(lon), precision), *[F.lit(str(r)) for r in rest]]
    return F.concat_ws(":", *parts)


def place_label(name, city, state, country) -> Column:
    """``name, city`` with the state in place of a missing city, and the country if there is neither."""
    filled = lambda c: F.when(F.trim(col(c)) != "", F.trim(col(c)))
    second = F.coalesce(filled(city), filled(state))
    label = F.concat_ws(", ", filled(name), second, F.when(filled(city).isNull(), filled(country)))
    return F.when(label != "", label)


def parse_day(c: str | Column) -> Column:
    """Date in ISO text of a day or a point in time; null for anything else."""
    t = col(c)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_timestamp(t).cast("date"))


def pick_limit(count: Column, most: int, share: float) -> Column:
    """How many to pick: ``share`` of ``count`` rounded up, at least 1, at most ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(count * F.lit(share)).cast("int")))


def ceil_share(count: int, share: float) -> int:
    return max(1, math.ceil(count * share))
