"""Spectral band math as column expressions.

Missing values are NULL, so an index of a missing band is NULL. Denominators below ``EPS`` give 0.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9

BANDS = ("B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12")
# Names by which bands are known.
NAMES = {
    "blue": "B02", "green": "B03", "red": "B04", "rededge1": "B05", "rededge2": "B06", "rededge3": "B07", "nir": "B08", "nir08": "B8A", "swir16": "B11", "swir22": "B12",
    "nir_broad": "B08", "nir_narrow": "B8A", "swir1": "B11", "swir2": "B12", "red_edge1": "B05", "red_edge2": "B06", "red_edge3": "B07",
}
ALIASES = {b: b for b in BANDS} | {b.lower(): b for b in BANDS} | NAMES


def guarded(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) < EPS, F.lit(0.0) * top).otherwise(top / F.when(F.abs(bottom) >= EPS, bottom))


def norm_diff(a: Column, b: Column) -> Column:
    return guarded(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return norm_diff(nir, red)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return guarded(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return guarded((nir - red) * (1.0 + soil), nir + red + soil)


def ndwi(green: Column, nir: Column) -> Column:
    return norm_diff(green, nir)


def mndwi(green: Column, swir1: Column) -> Column:
    return norm_diff(green, swir1)


def ndbi(swir1: Column, nir: Column) -> Column:
    return norm_diff(swir1, nir)


def nbr(nir: Column, swir2: Column) -> Column:
    return norm_diff(nir, swir2)


def ndsi(green: Column, swir1: Column) -> Column:
    return norm_diff(green, swir1)


def cig(nir: Column, green: Column) -> Column:
    return F.when(F.abs(green) < EPS, F.lit(0.0) * nir).otherwise(nir / F.when(F.abs(green) >= EPS, green) - 1.0)


def arvi(nir: Column, red: Column, blue: Column) -> Column:
    return norm_diff(nir, 2.0 * red - blue)


def ndvi_or_null(nir: Column, red: Column) -> Column:
    """NDVI where both bands add up to more than 0, else NULL."""
    return F.when(nir + red > 0, (nir - red) / F.when(nir + red > 0, nir + red))


class Index:
    def __init__(self, bands: tuple[str, ...], fn: Callable[..., Column], long_name: str, valid_range: tuple[float, float]):
        self.bands, self.fn, self.long_name, self.valid_range = bands, fn, long_name, valid_range


# Required bands, names and ranges.
INDICES = {
    "ndvi": Index(("B08", "B04"), ndvi, "Normalised Difference Vegetation Index", (-1.0, 1.0)),
    "evi": Index(("B08", "B04", "B02"), evi, "Enhanced Vegetation Index", (-1.0, 1.0)),
    "savi": Index(("B08", "B04"), savi, "Soil Adjusted Vegetation Index", (-1.5, 1.5)),
    "ndwi": Index(("B03", "B08"), ndwi, "Normalised Difference Water Index", (-1.0, 1.0)),
    "mndwi": Index(("B03", "B11"), mndwi, "Modified NDWI (Xu 2006)", (-1.0, 1.0)),
    "ndbi": Index(("B11", "B08"), ndbi, "Normalised Difference Built-up Index", (-1.0, 1.0)),
    "nbr": Index(("B08", "B12"), nbr, "Normalised Burn Ratio", (-1.0, 1.0)),
    "ndsi": Index(("B03", "B11"), ndsi, "Normalised Difference Snow Index", (-1.0, 1.0)),
    "cig": Index(("B08", "B03"), cig, "Chlorophyll Index Green", (0.0, 30.0)),
    "arvi": Index(("B08", "B04", "B02"), arvi, "Atmospherically Resistant Vegetation Index", (-1.0, 1.0)),
}
AVAILABLE_INDICES = sorted(INDICES)


def list_indices() -> dict[str, dict]:
    return {k: {"bands": list(v.bands), "long_name": v.long_name, "valid_range": v.valid_range} for k, v in INDICES.items()}


def missing_bands(available: Iterable[str], required: Iterable[str]) -> list[str]:
    """Required bands (by any name) that are not among the available ones."""
    known = {ALIASES.get(b, b) for b in available}
    return [b for b in dict.fromkeys(ALIASES.get(b, b) for b in required) if b not in known]


def bands_of(df: DataFrame) -> dict[str, str]:
    """Canonical band: column, for the columns whose name is a band's."""
    found: dict[str, str] = {}
    for c in df.columns:
        if c in ALIASES:
            found.setdefault(ALIASES[c], c)
    return found


def compute_indices(df: DataFrame, names: str | Iterable[str], scale_factor: float | None = None) -> DataFrame:
    """The columns that are no bands, and one column for each index whose bands are there: one projection over one scan."""
    wanted = [n.strip().lower() for n in ([names] if isinstance(names, str) else names)]
    if not wanted or (unknown := [n for n in wanted if n not in INDICES]):
        raise ValueError(f"unknown or no indices: {unknown if wanted else wanted}; known: {AVAILABLE_INDICES}")
    found = bands_of(df)
    value = lambda b: F.col(f"`{found[b]}`").cast("double") * F.lit(1.0 if scale_factor is None else float(scale_factor))
    out = []
    for n in dict.fromkeys(wanted):
        if lacks := missing_bands(found, INDICES[n].bands):
            warnings.warn(f"{n} left out: no {', '.join(lacks)}", stacklevel=2)
        else:
            out.append(INDICES[n].fn(*(value(b) for b in INDICES[n].bands)).alias(n))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in found.values()], *out)
