"""Pieces of DuckDB SQL for the oracles."""

from __future__ import annotations

from shuttleplan.functions.geo import EARTH, EARTH_RADIUS_SEARCH
from shuttleplan.sources import fixtures


def ctes(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({fixtures.sql(n)})" for n in names)


def hav(a: str, b: str, c: str, d: str, radius: float = EARTH) -> str:
    h = f"(sin(radians({c}-({a}))/2)*sin(radians({c}-({a}))/2)+cos(radians({a}))*cos(radians({c}))*sin(radians({d}-({b}))/2)*sin(radians({d}-({b}))/2))"
    return f"({2 * radius!r}*atan2(sqrt({h}),sqrt(greatest(0e0,1e0-{h}))))"


def near(a: str, b: str, c: str, d: str) -> str:
    return hav(a, b, c, d, EARTH_RADIUS_SEARCH)


def wrap(x: str) -> str:
    return f"((({x}) % 360e0 + 360e0) % 360e0)"


def bearing(a: str, b: str, c: str, d: str) -> str:
    p, q, l = f"radians({a})", f"radians({c})", f"radians(({d})-({b}))"
    return f"case when {a}={c} and {b}={d} then null else {wrap(f'degrees(atan2(sin({l})*cos({q}),cos({p})*sin({q})-sin({p})*cos({q})*cos({l})))')} end"


def dest(lat: str, lon: str, m: str, h: str) -> tuple[str, str]:
    """Spherical law form, independent of the vector form."""
    p, l, t, d = f"radians({lat})", f"radians({lon})", f"radians({h})", f"(({m})/{EARTH!r})"
    s = f"(sin({p})*cos({d})+cos({p})*sin({d})*cos({t}))"
    return f"degrees(asin({s}))", f"degrees({l}+atan2(sin({t})*sin({d})*cos({p}),cos({d})-sin({p})*{s}))"


def in_poly(lat: str, lon: str, points: list[tuple[float, float]]) -> str:
    """Odd number of edges above the point on its meridian."""
    hits = []
    for (a, b), (c, d) in zip(points, points[1:]):
        if b > d:
            a, b, c, d = c, d, a, b
        if b != d:
            hits.append(f"case when {lon} >= {b!r} and {lon} <= {d!r} and {lat} <= {a!r} + ({lon} - ({b!r})) * {(c - a) / (d - b)!r} then 1 else 0 end")
    return f"coalesce(({' + '.join(hits)}) % 2 = 1, false)"
