"""Binning expressions: label cuts, fixed and density histogram bins, hexagons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LABEL_NAMES


def cut_right_closed(x: Column, edges: Sequence, labels: Sequence[int], strict: bool = False) -> Column:
    """Class of ``x`` on intervals ``(edge[i], edge[i+1]]``; outside all of them NULL, or an error
    when ``strict``. Edges may be numbers or column expressions."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
        hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
        cond = (x > lo_c) & (x <= hi_c)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if strict:
        out = out.otherwise(F.raise_error(F.concat(F.lit("value outside label bins: "), x.cast("string"))).cast("int"))
    return out


def pt_label(signal_pt: Column, pt_hard_min: Column, strict: bool = False) -> Column:
    """1 fake / 2 squish / 3 real, with edges that follow the hard-scattering threshold."""
    ptm = pt_hard_min.cast("double")
    edges = [-1.0, F.lit(0.05) * F.pow(ptm, F.lit(1.5)), F.lit(0.8) * ptm, 1e7]
    return cut_right_closed(signal_pt, edges, [1, 2, 3], strict)


def label_names(label: Column, names: Sequence[str] = LABEL_NAMES) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), label.cast("int"))


def purity_class(x: Column) -> Column:
    """0..3 by true-momentum share, left-closed at 0.1, 0.5 and 0.9."""
    return F.when(x < 0.1, 0).when(x < 0.5, 1).when(x < 0.9, 2).when(x.isNotNull(), 3)


def fixed_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """0 = underflow, 1..n, n+1 = overflow (x == hi counts as overflow)."""
    return F.width_bucket(x, F.lit(float(lo)), F.lit(float(hi)), F.lit(n)).cast("int")


def density_bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based equal-width bin of a data-driven range; the last bin is closed, a zero-width
    range puts everything in bin 0."""
    scaled = F.floor(F.try_divide((x - lo) * F.lit(float(n)), hi - lo))
    return F.when(x.isNotNull() & (hi > lo), F.least(scaled, F.lit(n - 1))).when(x.isNotNull(), 0).cast("int")


def hexbin_centres(x: Column, y: Column, x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column,
                   grid: int) -> tuple[Column, Column, Column]:
    """Hexagon of a point: two staggered lattices, the nearer centre wins (ties to the first).

    Returns (lattice, ix, iy). The lattice has ``grid`` columns and grid/sqrt(3) rows; distances
    weigh dy by 3 so the cells are regular hexagons.
    """
    ny = int(grid / 3 ** 0.5)
    sx, sy = (x_hi - x_lo) / F.lit(float(grid)), (y_hi - y_lo) / F.lit(float(ny))
    # A flat column lies in the first row or column of hexagons.
    u, v = (F.when(a.isNotNull(), F.coalesce(F.try_divide(a - lo, s), F.lit(0.0))) for a, lo, s in ((x, x_lo, sx), (y, y_lo, sy)))
    ix1, iy1 = F.floor(u + 0.5), F.floor(v + 0.5)
    ix2, iy2 = F.floor(u), F.floor(v)
    d1 = (u - ix1) * (u - ix1) + F.lit(3.0) * (v - iy1) * (v - iy1)
    d2 = (u - ix2 - 0.5) * (u - ix2 - 0.5) + F.lit(3.0) * (v - iy2 - 0.5) * (v - iy2 - 0.5)
    first = d1 <= d2
    return (F.when(first, 0).otherwise(1), F.when(first, ix1).otherwise(ix2).cast("bigint"),
            F.when(first, iy1).otherwise(iy2).cast("bigint"))
