"""Named steps: the extension point for own demosaic, colour and curve jobs.

A step takes pixels (or tiles) and parameters and returns a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawlake.functions import curves
from rawlake.operators import develop, tiles

Step = Callable[[DataFrame, DataFrame], DataFrame]

_STEPS: dict[tuple[str, str], Step] = {}
KINDS = ("demosaic", "colour", "curve")


def register_step(kind: str, name: str, step: Step) -> None:
    """Add or replace a step of a kind."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    _STEPS[kind, name] = step


def step(kind: str, name: str) -> Step:
    return _STEPS[kind, name]


def run_steps(table: DataFrame, params: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """Apply steps one after another."""
    for kind, name in names:
        table = step(kind, name)(table, params)
    return table


def _clipped_matrix(pixels: DataFrame, params: DataFrame) -> DataFrame:
    p = develop.with_params(pixels, params.select("clip_id", F.col("fused").alias("_m")))
    out = develop.dot_rows("_m", list(develop.RGB))
    return p.withColumns({c: develop.clamp(v, 0.0, 1.0) for c, v in zip(develop.RGB, out)}).drop("_m")


register_step("demosaic", "bilinear", lambda t, _: tiles.demosaic_export(t))
register_step("demosaic", "preview", lambda t, _: tiles.demosaic_preview(t))
register_step("demosaic", "edges", lambda t, _: tiles.plane_pixels(tiles.demosaic_edges(t)))
register_step("colour", "matrix", _clipped_matrix)
for _name in curves.ENCODE:
    register_step("curve", _name, lambda p, _, n=_name: curves.encode_table(p, n))
