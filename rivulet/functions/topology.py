"""Path-encoded edge keys: prefixes, junctions, directed distances and what is derived from a pair of sites.

The outlet's key is "1"; an upstream edge appends 0 or 1 to its downstream neighbour's key. So an ancestor is a prefix, and the
edge where two paths join is the longest common prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary digits compared at once as a whole number.
CHUNK = 60


def _chunk_lcp(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    differ = F.conv(F.substr(a, F.lit(1), n), 2, 10).cast("bigint").bitwiseXOR(F.conv(F.substr(b, F.lit(1), n), 2, 10).cast("bigint"))
    return F.when(n == 0, F.lit(0)).when(differ == 0, n).otherwise(n - F.length(F.bin(differ)))


def lcp(a: Column, b: Column, longest: int | None = None) -> Column:
    """Length of the longest common prefix of two keys of any length.

    Keys of up to CHUNK digits, or `longest` where the caller knows it, are compared by integer arithmetic; longer ones by the
    back reference of a regular expression, which is slower and has no limit.
    """
    known = CHUNK if longest is None else longest
    out = F.lit(0)
    for i in reversed(range(-(-known // CHUNK))):
        here = _chunk_lcp(F.substring(a, CHUNK * i + 1, CHUNK), F.substring(b, CHUNK * i + 1, CHUNK))
        out = here if i * CHUNK + CHUNK >= known else here + F.when(here == CHUNK, out).otherwise(F.lit(0))
    if longest is not None:
        return out
    return F.when(F.least(F.length(a), F.length(b)) > CHUNK, F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"^(.*).*\n\1", 1))).otherwise(out)


def flow_connected(a: Column, b: Column, longest: int | None = None) -> Column:
    return lcp(a, b, longest) == F.least(F.length(a), F.length(b))


def prefix_code(a: Column, b: Column, longest: int | None = None) -> Column:
    """The shorter length, negated, if one key is a prefix of the other; else the length of what they share."""
    n = lcp(a, b, longest)
    return F.when(n == F.least(F.length(a), F.length(b)), -n).otherwise(n)


def down_distance(connected: Column, from_up: Column, to_up: Column, junction_up: Column) -> Column:
    """Distance that water from one site flows until it passes the other or the junction of their paths."""
    return F.greatest(F.when(connected, from_up - to_up).otherwise(from_up - junction_up), F.lit(0.0))


def afv_weight(b: Column, afv_i: Column, afv_j: Column) -> Column:
    """Square root of the ratio of additive values where one site is downstream of the other, else 0."""
    high = F.greatest(afv_i.cast("double"), afv_j.cast("double"))
    return F.when((b == 0) & (high > 0), F.sqrt(F.least(afv_i.cast("double"), afv_j.cast("double")) / high)).otherwise(F.lit(0.0))


def rotate_scale(x: Column, y: Column, rotate: float, scale: float) -> tuple[Column, Column]:
    """Anisotropy: turn by the angle, then stretch the second axis."""
    c, s = F.cos(F.lit(float(rotate))), F.sin(F.lit(float(rotate)))
    return c * x + s * y, (c * y - s * x) / F.lit(float(scale))


def unrotate_scale(x: Column, y: Column, rotate: float, scale: float) -> tuple[Column, Column]:
    c, s = F.cos(F.lit(float(rotate))), F.sin(F.lit(float(rotate)))
    up = y * F.lit(float(scale))
    return c * x - s * up, s * x + c * up


def netgeom_edge(net: Column, rid: Column, up: Column) -> Column:
    return F.concat(F.lit("ENETWORK ("), F.concat_ws(" ", net, rid, up), F.lit(")"))


def netgeom_site(net: Column, rid: Column, up: Column, ratio: Column, pid: Column, loc: Column) -> Column:
    return F.concat(F.lit("SNETWORK ("), F.concat_ws(" ", net, rid, up, ratio, pid, loc), F.lit(")"))


EDGE_FIELDS = (("NetworkID", "int"), ("SegmentID", "bigint"), ("DistanceUpstream", "double"))
SITE_FIELDS = (*EDGE_FIELDS, ("ratio", "double"), ("pid", "bigint"), ("locID", "bigint"))


def parse_netgeom(text: Column, netvars: list[str] | None = None, site: bool = True) -> dict[str, Column]:
    """The named parts of a network geometry text, as numbers."""
    fields = SITE_FIELDS if site else EDGE_FIELDS
    unknown = set(netvars or []) - {f for f, _ in fields}
    if unknown:
        raise ValueError(f"no such network variable: {sorted(unknown)}")
    parts = F.split(F.regexp_extract(text, r"\(([^)]*)\)", 1), " ")
    return {f: F.element_at(parts, i + 1).cast(kind).alias(f) for i, (f, kind) in enumerate(fields) if not netvars or f in netvars}
