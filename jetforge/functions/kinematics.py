"""Angles and momenta as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two_pi() -> Column:
    return F.pi() * F.lit(2.0)


def delta_phi(a: Column, b: Column) -> Column:
    """Azimuth difference wrapped to one turn around zero."""
    return F.pmod(a - b + F.pi(), _two_pi()) - F.pi()


def delta_eta(a: Column, b: Column) -> Column:
    return a - b


def delta_r(eta_a: Column, phi_a: Column, eta_b: Column, phi_b: Column) -> Column:
    dphi, deta = delta_phi(phi_a, phi_b), delta_eta(eta_a, eta_b)
    return F.sqrt(dphi * dphi + deta * deta)


def kinematics(px: Column, py: Column, pz: Column, mass: Column | None = None) -> dict[str, Column]:
    """pT, p, pseudorapidity, azimuth in [0, 2*pi] and energy; eta is NULL along the beam axis."""
    pt = F.sqrt(px * px + py * py)
    p = F.sqrt(px * px + py * py + pz * pz)
    out = {
        "pt": pt,
        "p": p,
        "eta": F.lit(0.5) * F.ln(F.try_divide(p + pz, F.nullif(p - pz, F.lit(0.0)))),
        "phi": F.pi() + F.atan2(-py, -px),
    }
    if mass is not None:
        out["energy"] = F.sqrt(p * p + mass * mass)
    return out


def vertex_distance_um(vx: Column, vy: Column, vz: Column) -> Column:
    """Distance of a vertex from the origin, millimetres to micrometres."""
    return F.sqrt(vx * vx + vy * vy + vz * vz) * F.lit(1000.0)


# Azimuth ranges of the three event-plane regions.
IN_PLANE = [(0.0, 0.524), (5.760, 6.283), (2.618, 3.665)]
MID_PLANE = [(0.524, 1.047), (5.236, 5.760), (2.094, 2.618), (3.665, 4.189)]
OUT_OF_PLANE = [(1.047, 2.094), (4.189, 5.236)]


def plane_class(phi: Column) -> Column:
    """in / mid / out of the event plane; ranges are left-closed."""
    def inside(ranges):
        cond = F.lit(False)
        for lo, hi in ranges:
            cond = cond | ((phi >= lo) & (phi < hi))
        return cond

    return (F.when(inside(IN_PLANE), "in_plane").when(inside(MID_PLANE), "mid_plane")
            .when(inside(OUT_OF_PLANE), "out_of_plane"))
