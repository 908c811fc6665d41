"""Stock and average cost of every item, kept as state of a movement stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinicflow.functions.scalars import folded, from_hundredths, hundredths
from clinicflow.operators.folds import Fold, run_fold
from clinicflow.operators.inventory import FULL_WEIGHT, ORDER, validate_step, weighted_average
from clinicflow.operators.skew import CHUNK_ROWS, written
from clinicflow.streaming.sinks import Batches

_KEPT = ("_stock", "_active", "_cost", "_last")
_OUT = T.StructType(
    [
        T.StructField("message", T.StringType()), T.StructField("is_accepted", T.BooleanType()),
        *[T.StructField(f"_now{n}", T.LongType()) for n in (*_KEPT, "_seen")],
    ]
)
_INPUTS = ("_before", "_after", "_quantity", "_exact", "_price", "_in", "_bought")


def track_stock(
    movements: DataFrame, items: DataFrame, order: Sequence[str] = ORDER, chunk_rows: int = CHUNK_ROWS
) -> Batches:
    """Movements with outcome and the item's stock and costs after each, for `run_available`.

    `movements` is a stream of rows that state the stock before and after. A row whose stock
    before is not the item's current stock came too early, too late or twice; it is marked
    as refused and changes nothing, so `is_accepted = false` is the side output. Items start
    from `items` when their first movement arrives; NULL in the state says that there is no
    such item or no such cost. Rows of one run are put in order per item, so the result does not
    depend on how the input is cut into files; a row that comes in a later run than its successors
    is refused. Items with more than `chunk_rows` rows are cut into chunks.
    """
    begin = items.select(
        F.col("id").alias("item_id"),
        hundredths(F.col("current_stock")).alias("_stock"),
        F.col("is_active").cast("bigint").alias("_active"),
        F.coalesce(hundredths(F.col("unit_cost")), F.lit(0)).alias("_cost"),
        hundredths(F.col("last_purchase_cost")).alias("_last"),
    )
    fold = Fold(
        keys=["item_id"],
        order=list(order),
        inputs=_INPUTS,
        state=[*_KEPT, "_weight", "_seen"],
        outputs=_OUT,
        step=_step,
        guess={"_stock": "_before"},
        predict=_tracked_from,
    )

    def judge(arrived: DataFrame, states: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        category = folded(F.col("movement_category"))
        rows = arrived.withColumns(
            {
                "_before": hundredths(F.col("previous_stock")),
                "_after": hundredths(F.col("new_stock")),
                "_quantity": hundredths(F.col("quantity")),
                "_exact": category.isin("in", "out"),
                "_price": hundredths(F.col("unit_cost")),
                "_in": category == "in",
                "_bought": folded(F.col("movement_type")) == "purchase",
            }
        )
        opening = begin
        if states is not None:
            opening = begin.join(states, "item_id", "left_anti").unionByName(states)
        opening = opening.withColumns(
            {"_weight": F.lit(FULL_WEIGHT).cast("bigint"), "_seen": F.lit(0).cast("bigint")}
        )
        judged = written(run_fold(rows, opening, fold, chunk_rows).drop(*_INPUTS))
        now = F.struct(*[F.col(f"_now{n}").alias(n) for n in _KEPT])
        ended = judged.groupBy("item_id").agg(F.max_by(now, "_now_seen").alias("s")).select("item_id", "s.*")
        if states is not None:
            same = states.item_id.eqNullSafe(ended.item_id)
            ended = ended.unionByName(states.join(ended.select("item_id"), same, "left_anti"))
        out = judged.withColumns(
            {
                "current_stock": from_hundredths(F.col("_now_stock")),
                "average_cost": from_hundredths(F.col("_now_cost")),
                "last_purchase_cost": from_hundredths(F.col("_now_last")),
            }
        ).drop(*[f"_now{n}" for n in (*_KEPT, "_seen")])
        return out, ended

    return Batches(movements, judge)


def _step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    stock, active, cost, last, weight, seen = state or (*[None] * 4, FULL_WEIGHT, 0)
    before, after, quantity, exact, price, incoming, bought = row
    known = None if active is None else (stock, active)
    following, (message,) = validate_step(known, (before, after, quantity, exact))
    if message is None and following is not None:
        if incoming and price is not None:
            # An accepted row starts from the item's stock, if that is known.
            cost = weighted_average(before, cost, abs(quantity), price)
            weight = weight * before // (before + abs(quantity)) if before > 0 else 0
        if bought and price is not None:
            last = price
        stock = following[0]
    seen += 1
    return (stock, active, cost, last, weight, seen), (message, message is None, stock, active, cost, last, seen)


def _tracked_from(assumed: tuple, end: tuple, now: tuple) -> tuple:
    """Rows claim their stock, so a chunk forgets it; the cost keeps the weight it still carries."""
    seen = end[5] + now[5] - assumed[5]
    if now[1] in (None, 0):
        return (*now[:4], FULL_WEIGHT, seen)
    cost = end[2] + (end[4] * (now[2] - assumed[2]) + FULL_WEIGHT // 2) // FULL_WEIGHT
    return end[0], end[1], cost, now[3] if end[3] == assumed[3] else end[3], FULL_WEIGHT, seen
