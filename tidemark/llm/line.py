"""Cells: hash ranges of rows that keep every group of a window bounded.

Running sums over a whole table work without one task per group: rows are hashed
into cells; the totals of cells, one row each, give the start of a cell on the
line of its group, and a window inside the cell does the rest.
"""

from __future__ import annotations

ROWS_PER_CELL = 100_000


def cells(rows: int, per_cell: int = ROWS_PER_CELL) -> int:
    """Cells for a table of ``rows``: one cell holds about ``per_cell`` rows at any size."""
    return max(1, -(-rows // per_cell))
