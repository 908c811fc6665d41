"""Stock: status reports, movement checks, and the ledger of stock and average cost."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinicflow.functions import texts
from clinicflow.functions.scalars import collated, folded, from_hundredths, hundredths, stored
from clinicflow.operators.folds import Fold, Summary, run_fold
from clinicflow.operators.sequences import running_totals
from clinicflow.operators.skew import CHUNK_ROWS, hot_keys, positioned, split

# How movement types count, and which large ones need approval.
IN_TYPES = ("purchase", "return")
OUT_TYPES = ("consumption", "waste", "expired", "transfer")
OTHER_TYPES = ("adjustment",)
APPROVAL_TYPES = ("waste", "expired", "adjustment")
APPROVAL_ABOVE = 100
HALF_MINIMUM = "0.5"
LARGEST_STOCK = 10**10 - 1  # hundredths a DECIMAL(10,2) holds

# How much of an earlier average cost is left in a later one, in billionths.
FULL_WEIGHT = 10**9

ORDER = ("created_at", "id")


def movement_category(movement_type: Column) -> Column:
    kind = folded(movement_type)
    return (
        F.when(kind.isin(*IN_TYPES), F.lit("in"))
        .when(kind.isin(*OUT_TYPES), F.lit("out"))
        .otherwise(F.lit("adjustment"))
    )


def is_critical(current: Column, minimum: Column) -> Column:
    return current <= minimum * F.lit(HALF_MINIMUM).cast("decimal(2,1)")


def stock_status(current: Column, minimum: Column, maximum: Column) -> Column:
    """Label of a stock level; the most urgent one that applies."""
    levels = [
        (current == 0, texts.NO_STOCK),
        (is_critical(current, minimum), texts.CRITICAL),
        (current <= minimum, texts.LOW),
        (current >= maximum, texts.EXCESS),
    ]
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label in levels], F.lit(texts.NORMAL))


def _with_category(items: DataFrame, categories: DataFrame, name: str) -> DataFrame:
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias(name))
    return items.join(names, "category_id")


def inventory_status(items: DataFrame, categories: DataFrame, alerts: DataFrame) -> DataFrame:
    """Items with category, stock label and the number of open alerts."""
    counts = (
        alerts.filter(~F.col("is_resolved"))
        .groupBy(F.col("item_id").alias("id"))
        .agg(F.count("*").alias("active_alerts"))
    )
    return (
        _with_category(items, categories, "category_name")
        .join(counts, "id", "left")
        .select(
            "id", "code", "name", "category_name", "current_stock", "minimum_stock",
            "available_stock", "unit_of_measure", "unit_cost", "location", "has_expiration",
            "expiration_date",
            stock_status(
                F.col("current_stock"), F.col("minimum_stock"), F.col("maximum_stock")
            ).alias("stock_status"),
            F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"),
            "is_active",
        )
    )


def critical_stock_report(
    items: DataFrame, categories: DataFrame, movements: DataFrame, as_of: date
) -> DataFrame:
    """Active items at or below minimum, the most urgent first."""
    short = items.filter(F.col("is_active") & (F.col("current_stock") <= F.col("minimum_stock")))
    bought = (
        movements.filter(folded(F.col("movement_type")) == "purchase")
        .groupBy(F.col("item_id").alias("id"))
        .agg(F.max("created_at").alias("last_purchase"))
    )
    current, minimum = F.col("current_stock"), F.col("minimum_stock")
    urgency = F.when(current == 0, 1).when(is_critical(current, minimum), 2).otherwise(3)
    since = F.coalesce(F.col("last_purchase"), F.col("created_at")).cast("date")
    return (
        _with_category(short, categories, "category")
        .join(bought, "id", "left")
        .orderBy(urgency, "current_stock", collated(F.col("name")))
        .select(
            "code", "name", "category", "current_stock", "minimum_stock", "unit_of_measure",
            "location", "primary_supplier",
            stock_status(current, minimum, F.lit(None)).alias("status"),
            F.datediff(F.lit(as_of), since).alias("days_since_last_purchase"),
            (F.col("unit_cost") * minimum * 2).cast("decimal(24,4)").alias(
                "recommended_purchase_value"
            ),
        )
    )


def ledger_breaks(
    movements: DataFrame, order: Sequence[str] = ORDER, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Movements that do not continue the item's ledger, or whose stock does not add up."""
    line = Window.partitionBy("item_id").orderBy(*order)
    expected = F.lag("new_stock").over(line)
    hot = hot_keys(movements, ["item_id"], chunk_rows)
    if hot is None:
        checked = movements.withColumn("expected_stock", expected)
    else:
        cold, large = split(movements, hot, ["item_id"])
        cut = positioned(large, ["item_id", *order])
        checked = cold.withColumn("expected_stock", expected).unionByName(_expected_by_chunk(cut, order))
    gap = F.col("previous_stock") != F.col("expected_stock")
    wrong = folded(F.col("movement_category")).isin("in", "out") & (
        F.col("new_stock") != F.col("previous_stock") + F.col("quantity")
    )
    return (
        checked.withColumn("breaks_chain", F.coalesce(gap, F.lit(False)))
        .withColumn("wrong_sum", F.coalesce(wrong, F.lit(False)))
        .filter("breaks_chain or wrong_sum")
    )


def _expected_by_chunk(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The stock left by the row before, looked up inside a chunk.

    The first row of a chunk looks at the last row of the item's chunk before, taken from one
    row per item and chunk.
    """
    by_chunk = ["item_id", "_chunk"]
    last = rows.groupBy(*by_chunk).agg(
        F.max_by(F.struct("new_stock"), F.struct(*order)).alias("_last")
    )
    in_line = Window.partitionBy("item_id").orderBy("_chunk")
    last = last.select(*by_chunk, F.lag("_last").over(in_line).alias("_carried"))
    inside = Window.partitionBy(*by_chunk).orderBy(*order)
    before = F.lag(F.struct("new_stock")).over(inside)
    return (
        rows.join(last, by_chunk, "left")
        .withColumn("expected_stock", F.coalesce(before, F.col("_carried"))["new_stock"])
        .drop("_chunk", "_carried")
    )


def running_stock(
    movements: DataFrame,
    items: DataFrame,
    order: Sequence[str] = ORDER,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Stock after each movement if every movement is accepted."""
    moved = {"_moved": F.col("quantity")}
    summed = running_totals(movements, ["item_id"], order, moved, chunk_rows)
    opening = items.select(F.col("id").alias("item_id"), F.col("current_stock").alias("_open"))
    return (
        summed.join(opening, "item_id", "left")
        .withColumn(
            "running_stock",
            stored(F.coalesce("_open", F.lit(0)) + F.col("_moved"), 18),
        )
        .drop("_open", "_moved")
    )


def validate_movements(
    movements: DataFrame,
    items: DataFrame,
    order: Sequence[str] = ORDER,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Check movement rows that state their stock before and after, in order per item.

    An accepted row moves the item's stock to its new value; a refused one does not. Large
    waste, expiry and adjustment rows are marked as needing approval.
    """
    opening = items.select(
        F.col("id").alias("item_id"),
        hundredths(F.col("current_stock")).alias("_stock"),
        F.col("is_active").cast("bigint").alias("_active"),
    )
    rows = movements.withColumns(
        {
            "_before": hundredths(F.col("previous_stock")),
            "_after": hundredths(F.col("new_stock")),
            "_quantity": hundredths(F.col("quantity")),
            "_exact": folded(F.col("movement_category")).isin("in", "out"),
        }
    )
    fold = Fold(
        keys=["item_id"],
        order=list(order),
        inputs=["_before", "_after", "_quantity", "_exact"],
        state=["_stock", "_active"],
        outputs=T.StructType([T.StructField("message", T.StringType())]),
        step=validate_step,
        summary=StockClaimed,
    )
    judged = run_fold(rows, opening, fold, chunk_rows).withColumn(
        "is_accepted", F.col("message").isNull()
    )
    flagged = needs_approval() & ~F.coalesce(F.col("approval_required"), F.lit(True))
    return judged.withColumns(
        {
            "approval_required": F.col("approval_required") | flagged,
            "is_approved": F.col("is_approved") & ~flagged,
        }
    ).drop("_before", "_after", "_quantity", "_exact")


def needs_approval() -> Column:
    """Accepted waste, expiry and adjustment rows of more than the free quantity."""
    large = folded(F.col("movement_type")).isin(*APPROVAL_TYPES) & (
        F.abs("quantity") > APPROVAL_ABOVE
    )
    return F.coalesce(F.col("is_accepted") & large, F.lit(False))


class StockClaimed(Summary):
    """The stock after a chunk for any stock before it, of an active item.

    A sound row moves exactly those starts that now stand where it claims to begin. An inactive
    item refuses all rows, whatever it starts from, so for it the end does not matter.
    """

    def __init__(self):
        self.starts: dict[int, list[int]] = {}

    def add(self, inputs: tuple) -> None:
        before, after, quantity, exact = inputs
        if None in inputs[:3] or after < 0 or (exact and after != before + quantity):
            return
        if self.unset in (None, before):
            self.unset = after
        if before == after:
            return
        moved = self.starts.setdefault(before, [before])
        there = self.starts.setdefault(after, [after])
        if len(there) < len(moved):
            moved, there = there, moved
        there += moved
        self.starts[before], self.starts[after] = [], there

    def moves(self) -> Iterator[tuple[int, int]]:
        for end, starts in self.starts.items():
            yield from ((start, end) for start in starts if start != end)


def validate_step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
    before, after, quantity, exact = row
    stock, active = state or (None, None)
    if active == 0:
        return state, (texts.INACTIVE_ITEM,)
    if None in (before, after, quantity):
        return state, (texts.INCOMPLETE_MOVEMENT,)
    if stock is not None and before != stock:
        return state, (texts.STALE_STOCK,)
    if after < 0:
        return state, (texts.NEGATIVE_STOCK,)
    if exact and after != before + quantity:
        return state, (texts.WRONG_STOCK,)
    return (None if state is None else (after, active)), (None,)


POSTED_COLUMNS = (
    "movement_category", "is_accepted", "message", "previous_stock", "new_stock",
    "average_cost", "last_purchase_cost", "approval_required", "is_approved", "is_low",
    "is_refilled", "episode",
)
_POSTED = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("is_accepted", T.BooleanType()),
        T.StructField("_before", T.LongType()),
        T.StructField("_after", T.LongType()),
        T.StructField("_average", T.LongType()),
        T.StructField("_purchase", T.LongType()),
        T.StructField("is_low", T.BooleanType()),
        T.StructField("is_refilled", T.BooleanType()),
        T.StructField("episode", T.LongType()),
    ]
)


def post_movements(
    requests: DataFrame,
    items: DataFrame,
    order: Sequence[str] = ORDER,
    basis: str = "previous",
    chunk_rows: int = CHUNK_ROWS,
    batches: DataFrame | None = None,
) -> DataFrame:
    """Post movement requests in order per item: outcome, stock and costs after each.

    Given `batches`, an outgoing movement that names one of them also takes from its balance,
    and fails where that would fall below nothing. Numbers that name no known batch only
    count for the item, as an update of no row would.

    A refused request leaves stock and costs as they were. The average cost weighs the stock
    before an incoming movement and is rounded to cents each time; `basis="as_written"`
    weighs the stock after it instead. `is_low` and `is_refilled` tell whether an accepted row
    left the stock at or below the minimum, or brought more of the item to above it, and
    `episode` counts the refills before the row; the alert operators use them. Columns of
    these names in the requests are replaced.
    """
    requests = requests.drop(*POSTED_COLUMNS)
    opening = items.filter("is_active and current_stock is not null").select(
        F.col("id").alias("item_id"),
        hundredths(F.col("current_stock")).alias("_stock"),
        F.coalesce(hundredths(F.col("unit_cost")), F.lit(0)).alias("_cost"),
        hundredths(F.col("last_purchase_cost")).alias("_last"),
        hundredths(F.col("minimum_stock")).alias("_minimum"),
        F.lit(0).cast("bigint").alias("_episode"),
        F.lit(FULL_WEIGHT).cast("bigint").alias("_weight"),
    )
    category = movement_category(F.col("movement_type"))
    quantity, price = F.col("quantity"), F.col("unit_cost")
    known = folded(F.col("movement_type")).isin(*IN_TYPES, *OUT_TYPES, *OTHER_TYPES)
    signed = F.when(category == "in", quantity > 0).when(category == "out", quantity < 0)
    sound = known & F.coalesce(signed, F.lit(True)) & F.coalesce(price >= 0, F.lit(True))
    for needed in ("reason", "user_id"):
        if needed in requests.columns:
            sound = sound & F.col(needed).isNotNull()
    named = F.lit(None).cast("string")
    if batches is not None and "batch_number" in requests.columns:
        named = F.when(category == "out", _batch_name())
    rows = requests.withColumns(
        {
            "_batch": named,
            "movement_category": category,
            "_quantity": hundredths(quantity),
            "_price": hundredths(price),
            "_bought": folded(F.col("movement_type")) == "purchase",
            "_sound": F.coalesce(sound, F.lit(False)),
            "_in": category == "in",
            "_out": category == "out",
        }
    )
    if batches is not None:
        touched = rows.filter("_batch is not null").select("item_id", "_batch").distinct()
        balances = batches.select(
            "item_id", _batch_name().alias("_batch"), hundredths(F.col("quantity_current")).alias("_stock")
        ).join(touched, ["item_id", "_batch"], "left_semi")
        opening = opening.withColumn("_batch", F.lit("")).unionByName(balances, allowMissingColumns=True)
    else:
        opening = opening.withColumn("_batch", F.lit(""))
    fold = Fold(
        keys=["item_id"],
        order=list(order),
        part="_batch",
        inputs=["_batch", "_quantity", "_price", "_bought", "_sound", "_in", "_out"],
        state=["_stock", "_cost", "_last", "_minimum", "_episode", "_weight"],
        outputs=_POSTED,
        step=partial(_post, basis == "as_written"),
        predict=_posted_from,
    )
    posted = run_fold(rows, opening, fold, chunk_rows)
    return posted.withColumns(
        {
            "previous_stock": from_hundredths(F.col("_before")),
            "new_stock": from_hundredths(F.col("_after")),
            "average_cost": from_hundredths(F.col("_average")),
            "last_purchase_cost": from_hundredths(F.col("_purchase")),
            "approval_required": needs_approval(),
            "is_approved": ~needs_approval(),
        }
    ).select(
        *requests.columns, *POSTED_COLUMNS
    )


def _batch_name() -> Column:
    """The number of a batch as numbers compare; never empty."""
    return F.concat(F.lit("="), folded(F.col("batch_number")))


def weighted_average(weight: int, cost: int, quantity: int, price: int) -> int:
    """Average cost in cents after an incoming quantity, rounded half up."""
    if weight <= 0:
        return price
    units = weight + quantity
    return (2 * (weight * cost + quantity * price) + units) // (2 * units)


def _post(
    as_written: bool, state: tuple | None, row: tuple, batches: dict[str, int | None]
) -> tuple[tuple | None, tuple]:
    if state is None:
        return None, (texts.UNKNOWN_ITEM, False, *[None] * 4, False, False, None)
    stock, cost, last, minimum, episode, weight = state
    batch, quantity, price, bought, sound, incoming, outgoing = row
    balance = batches.get(batch)
    after = None if quantity is None else stock + quantity
    refusal = None
    if after is not None and after < 0 and outgoing:
        refusal = texts.NOT_ENOUGH
    elif after is None or not sound or not 0 <= after <= LARGEST_STOCK:
        refusal = texts.MOVEMENT_FAILED
    elif balance is not None and balance + quantity < 0:
        refusal = texts.MOVEMENT_FAILED
    if refusal:
        return state, (refusal, False, stock, None, cost, last, False, False, episode)
    if balance is not None:
        batches[batch] = balance + quantity
    if incoming and price is not None:
        basis = after if as_written else stock
        cost = weighted_average(basis, cost, quantity, price)
        weight = weight * max(basis, 0) // (max(basis, 0) + quantity)
        if bought:
            last = price
    low = minimum is not None and after <= minimum
    refilled = minimum is not None and incoming and after > minimum
    result = (texts.MOVEMENT_DONE, True, stock, after, cost, last, low, refilled, episode)
    return (after, cost, last, minimum, episode + refilled, weight), result


def _posted_from(assumed: tuple, end: tuple, now: tuple) -> tuple:
    """Stock and episodes shift with the start; the cost by the weight it still carries."""
    stock = max(end[0] + now[0] - assumed[0], 0)
    cost = end[1] + (end[5] * (now[1] - assumed[1]) + FULL_WEIGHT // 2) // FULL_WEIGHT
    last = now[2] if end[2] == assumed[2] else end[2]
    episode = end[4] + now[4] - assumed[4]
    return stock, cost, last, end[3], episode, FULL_WEIGHT


def item_state_after(items: DataFrame, posted: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Items with stock and costs as the last accepted movement left them."""
    arrival = F.struct(*order)
    last = (
        posted.filter("is_accepted")
        .groupBy(F.col("item_id").alias("id"))
        .agg(
            F.max_by(F.struct("new_stock", "average_cost", "last_purchase_cost"), arrival).alias("_s")
        )
    )
    moved = F.col("_s").isNotNull()
    joined = items.join(last, "id", "left").withColumns(
        {
            "current_stock": F.when(moved, F.col("_s.new_stock")).otherwise(F.col("current_stock")),
            "unit_cost": F.when(moved, F.col("_s.average_cost")).otherwise(F.col("unit_cost")),
            "last_purchase_cost": F.when(moved, F.col("_s.last_purchase_cost")).otherwise(
                F.col("last_purchase_cost")
            ),
        }
    ).drop("_s")
    if "available_stock" in items.columns:
        joined = joined.withColumn(
            "available_stock", stored(F.col("current_stock") - F.col("reserved_stock"))
        )
    return joined.select(*items.columns)


def batch_balance(batches: DataFrame, movements: DataFrame) -> DataFrame:
    """Batches after accepted outgoing movements that name them; all rows count without `is_accepted`."""
    if "is_accepted" in movements.columns:
        movements = movements.filter("is_accepted")
    out = (
        movements.filter(
            F.col("batch_number").isNotNull() & (folded(F.col("movement_category")) == "out")
        )
        .groupBy("item_id", _batch_name().alias("_batch"))
        .agg(F.sum("quantity").alias("_taken"))
    )
    left = stored(F.col("quantity_current") + F.coalesce("_taken", F.lit(0)), 18)
    return (
        batches.withColumn("_batch", _batch_name())
        .join(out, ["item_id", "_batch"], "left")
        .withColumn("quantity_current", left)
        .select(*batches.columns)
    )


def deactivate_batches(batches: DataFrame) -> DataFrame:
    """Empty batches become inactive."""
    empty = F.coalesce(F.col("quantity_current") == 0, F.lit(False))
    return batches.withColumn("is_active", F.col("is_active") & ~empty)
