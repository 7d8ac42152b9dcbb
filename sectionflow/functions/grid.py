"""Block-grid arithmetic shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Overlapping blocks over a width x height section.

    Block centres sit at ``radius + i * step`` while they stay inside the
    section, so a radius at or beyond the extent leaves no block.
    """

    width: int
    height: int
    radius: tuple[int, int]
    step: tuple[int, int]

    @staticmethod
    def _count(extent: int, radius: int, step: int) -> int:
        return max(0, -((radius - extent) // step))

    @property
    def nx(self) -> int:
        return self._count(self.width, self.radius[0], self.step[0])

    @property
    def ny(self) -> int:
        return self._count(self.height, self.radius[1], self.step[1])

    @property
    def size(self) -> int:
        return self.nx * self.ny

    def contains(self, bx: Column, by: Column) -> Column:
        return bx.between(0, self.nx - 1) & by.between(0, self.ny - 1)

    def axis(self, name: str) -> tuple[int, int, int, int]:
        """(block count, radius, step, extent) along ``x`` or ``y``."""
        i = "xy".index(name)
        return (self.nx, self.ny)[i], self.radius[i], self.step[i], (self.width, self.height)[i]


def member_range(axis: str, grid: Grid, closed: bool = False) -> tuple[Column, Column]:
    """First and last block index whose window holds pixel coordinate ``axis``.

    Windows are ``[c - r, c + r)``, or ``[c - r, c + r]`` when ``closed``; both
    end at the section border.  An empty range has first > last.
    """
    count, radius, step, _ = grid.axis(axis)
    over = f"{axis} - {2 * radius}"
    if closed:
        first = F.expr(f"CASE WHEN {over} <= 0 THEN 0L ELSE ({over} + {step - 1}) div {step} END")
    else:
        first = F.expr(f"CASE WHEN {over} < 0 THEN 0L ELSE ({over}) div {step} + 1 END")
    last = F.least(F.lit(count - 1).cast("bigint"), F.expr(f"{axis} div {step}"))
    return first, last


def cell_origin(axis: str, grids: Sequence[Grid]) -> Column:
    """First coordinate of the stretch of ``axis`` that no window border of any grid cuts.

    Windows begin at multiples of a grid's step and end two radii later, so the last
    border at or before a pixel follows from its coordinate alone.
    """
    borders = [F.lit(0).cast("bigint")]
    for grid in grids:
        _, radius, step, _ = grid.axis(axis)
        borders.append(F.expr(f"{axis} div {step} * {step}"))
        borders.append(F.expr(f"CASE WHEN {axis} >= {2 * radius} THEN ({axis} - {2 * radius}) div {step} * {step} + {2 * radius} ELSE 0L END"))
    return F.greatest(*borders)


def explode_range(first: Column, last: Column) -> Column:
    """explode(first..last), giving no row for an empty range.

    ``sequence`` counts downwards when its ends are swapped, hence the guard.
    """
    none = F.array().cast("array<bigint>")
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(none))
