"""Kernels over grey rasters, in batches: sharpness, edges, ink and the votes made of them. A raster is a struct height, width, data (bytes)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNALS = "laplacian double, variance double, edge_density double, ink double, skew_degrees double"


def laplacian(x: np.ndarray) -> np.ndarray:
    """Four-neighbour Laplacian of the inner pixels."""
    return x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]


def edges(x: np.ndarray, step: float = 30.0) -> float:
    """Share of inner pixels whose gradient is steeper than step."""
    gx, gy = x[1:-1, 2:] - x[1:-1, :-2], x[2:, 1:-1] - x[:-2, 1:-1]
    return float((np.hypot(gx, gy) / 2 > step).mean()) if gx.size else 0.0


def skew(x: np.ndarray, limit: float = 5.0, step: float = 0.5) -> float:
    """Angle of shear at which the row sums of the ink vary most."""
    ink = 255 - x
    columns = np.arange(x.shape[1]) - x.shape[1] / 2
    best, angle = -1.0, 0.0
    for a in sorted(np.arange(-limit, limit + step / 2, step), key=abs):  # of equals the smallest angle
        shift = np.rint(columns * np.tan(np.radians(a))).astype(int)
        rows = np.clip(np.arange(x.shape[0])[:, None] + shift[None, :], 0, x.shape[0] - 1)
        score = float(np.take_along_axis(ink, rows, 0).sum(1).var())
        if score > best + 1e-9:
            best, angle = score, float(a)
    return angle


def signals(raster: Column) -> Column:
    """The signals of a raster; zeros for one smaller than 3 by 3 or null."""

    @F.pandas_udf(SIGNALS)
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, data in zip(batch["height"], batch["width"], batch["data"], strict=True):
            if data is None or pd.isna(h) or h < 3 or w < 3:
                out.append((0.0,) * 5)
                continue
            x = np.frombuffer(data, np.uint8).reshape(int(h), int(w)).astype(float)
            out.append((float(laplacian(x).var()), float(x.var()), edges(x), float((x < 128).mean()), skew(x)))
        return pd.DataFrame(out, columns=["laplacian", "variance", "edge_density", "ink", "skew_degrees"])

    return run(raster)


def blank(s: str) -> Column:
    """Two of three votes: little variance, few edges, little ink."""
    votes = (F.col(f"{s}.variance") < 100).cast("int") + (F.col(f"{s}.edge_density") < 0.01).cast("int") + (F.col(f"{s}.ink") < 0.02).cast("int")
    return votes >= 2


def has_text(s: str) -> Column:
    return (F.col(f"{s}.edge_density") > 0.05) & ~blank(s)
