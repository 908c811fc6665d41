"""A batch of movements and all that it changes: ledger, items, batches and alerts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from clinicflow.operators import alerts as al
from clinicflow.operators import inventory
from clinicflow.operators.skew import CHUNK_ROWS, written


@dataclass(frozen=True)
class MovementBatch:
    """The next states: `movements` has every request with its outcome; the others are whole tables."""

    movements: DataFrame
    items: DataFrame
    batches: DataFrame
    alerts: DataFrame


def post_batch(
    requests: DataFrame,
    items: DataFrame,
    batches: DataFrame,
    alerts: DataFrame,
    order: Sequence[str] = inventory.ORDER,
    basis: str = "previous",
    chunk_rows: int = CHUNK_ROWS,
) -> MovementBatch:
    """Post movement requests (with `batch_number`) and derive the next state of all tables.

    The requests are sorted and posted once; their outcomes are written to the shared folder, and
    items, batches and alerts are aggregated from there.
    """
    posted = written(inventory.post_movements(requests, items, order, basis, chunk_rows, batches))
    return MovementBatch(
        posted,
        inventory.item_state_after(items, posted, order),
        inventory.batch_balance(batches, posted),
        al.low_stock_alerts(alerts, posted, items, order),
    )
