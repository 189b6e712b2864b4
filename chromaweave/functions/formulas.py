"""Column formulas of the simulation model: coordinates, barriers, planning numbers, collision words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_of(pos: Column, bin_size: int, start: Column | int = 0) -> Column:
    """Bin of a position relative to ``start``."""
    return F.floor((pos - start) / bin_size).cast("bigint")


def band_row(bin1: Column, bin2: Column) -> Column:
    """Distance from the diagonal; the column of the band is ``greatest(bin1, bin2)``."""
    return F.abs(bin2 - bin1)


def encode_pixel(bin1: Column, bin2: Column, nrows: Column | int) -> Column:
    """Place of a pixel in a column-major band of ``nrows`` rows."""
    return (F.greatest(bin1, bin2) * nrows + band_row(bin1, bin2)).cast("bigint")


def decode_pixel(index: Column, nrows: int) -> tuple[Column, Column]:
    """(bin1, bin2) of ``encode_pixel``, bin1 <= bin2."""
    bin2 = F.floor(index / nrows).cast("bigint")
    return bin2 - index % nrows, bin2


def barrier_position(start: Column, end: Column) -> Column:
    """Middle of a record, rounded up."""
    return F.floor((start + end + 1) / 2).cast("bigint")


def blocking_direction(strand: Column) -> Column:
    """What a motif on this strand blocks: + stops units that move to lower coordinates."""
    return F.when(strand == "+", "rev").when(strand == "-", "fwd")


def stp_active_from_occupancy(stp_inactive: Column, occupancy: Column) -> Column:
    """Chance that an active barrier stays active, from how often it is bound; 0 for an occupancy of 0."""
    leave = (1 - stp_inactive) * (1 - occupancy) / F.when(occupancy != 0, occupancy)
    return F.when(occupancy == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - leave)))


def occupancy_from_stp(stp_active: Column, stp_inactive: Column) -> Column:
    """Share of time a barrier is active; 0 if both self-transition chances are 0, null if both are 1."""
    total = (1 - stp_inactive) + (1 - stp_active)
    share = (1 - stp_inactive) / F.when(total != 0, total)
    return F.when(stp_active + stp_inactive == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def logistic(x: Column, scale: float) -> Column:
    return 1 / (1 + F.exp(-x / scale))


def lefs_of(size: Column, per_mbp: float) -> Column:
    """How many extruding units an interval gets: density times megabases, at least 1."""
    return F.greatest(F.lit(1), F.round(size * per_mbp / 1_000_000).cast("bigint"))


def contacts_per_epoch(lefs: Column, rev_speed: int, fwd_speed: int, sampling_interval: int) -> Column:
    return F.greatest(F.lit(1), F.round(lefs * (rev_speed + fwd_speed) / sampling_interval).cast("bigint"))


def cell_target(total: Column, cells: int, cell_id: Column) -> Column:
    """A cell's share of ``total`` contacts: equal shares rounded up, the last cells get what is left."""
    share = F.ceil(total / cells)
    return F.greatest(F.lit(0), F.least(share, total - share * cell_id)).cast("bigint")


def genextreme(u: Column, mu: float, sigma: float, xi: float) -> Column:
    """Inverse distribution function of the generalised extreme value distribution."""
    if xi == 0:
        return mu - sigma * F.log(-F.log(u))
    return mu + sigma * (F.pow(-F.log(u), F.lit(-xi)) - 1) / xi


#: Kinds of collision event and the bits that carry them above the index.
EVENTS = {"none": 0, "boundary": 1, "barrier": 2, "primary": 4, "secondary": 8}
_INDEX_BITS = 56


def encode_collision(kind: Column, index: Column, occurred: Column) -> Column:
    """One bigint: 56 bits of index, then the event's bits, then whether it occurred (or was avoided)."""
    code = F.coalesce(*[F.when(kind == name, F.lit(bits)) for name, bits in EVENTS.items()])
    return (F.shiftleft((code + F.when(occurred, 16).otherwise(0)).cast("bigint"), _INDEX_BITS) + index).cast("bigint")


def decode_collision(word: Column) -> dict[str, Column]:
    """kind, index and occurred of an encoded collision."""
    high = F.shiftright(word, _INDEX_BITS)
    kind = F.coalesce(*[F.when(high % 16 == bits, F.lit(name)) for name, bits in EVENTS.items()])
    return {"kind": kind, "index": word % (1 << _INDEX_BITS), "occurred": high >= 16}


_DISTANCE = re.compile(r"([0-9]+(?:\.[0-9]*)?(?:e[+-]?[0-9]+)?)(|bp|k|kb|kbp|m|mb|mbp|g|gb|gbp)", re.IGNORECASE)


def genomic_distance(text: str) -> int:
    """Base pairs of a literal such as ``10kb`` or ``1e6kb``; anything else, and fractions of one, are errors."""
    found = _DISTANCE.fullmatch(text)
    if not found:
        raise ValueError(f"{text!r} is no genomic distance")
    unit = found[2].lower()[:1]
    value = float(found[1]) * {"": 1, "b": 1, "k": 10**3, "m": 10**6, "g": 10**9}[unit]
    if value != int(value):
        raise ValueError(f"{text!r} is no whole number of base pairs")
    return int(value)


def strip_quotes(text: Column) -> Column:
    """Without a pair of equal quotes around it."""
    return F.regexp_replace(text, r"""^(["'])(.*)\1$""", "$2")


def split_fields(text: Column, separator: str) -> Column:
    """Split on a character; an empty last field is dropped."""
    parts = F.split(text, f"[{re.escape(separator)}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
