"""Stock and expiry alerts: raising, refreshing, resolving, purging and listing them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicflow.functions.scalars import folded
from clinicflow.operators.inventory import ORDER
from clinicflow.operators.snapshots import delete_where, update_where, upsert

# Alert kinds, limits in days, and texts.
LOW_STOCK, EXPIRING, EXPIRED, DEPLETED = "low_stock", "expiring_soon", "expired", "batch_depleted"
CRITICAL_DAYS, WARNING_DAYS, DEFAULT_ALERT_DAYS, KEEP_RESOLVED_DAYS = 7, 15, 30, 30
DAY_FORMAT = "dd/MM/yyyy"
NO_STOCK_TITLE, LOW_STOCK_TITLE = "SIN STOCK: %s", "Stock bajo: %s"
LOW_STOCK_MESSAGE = 'Artículo "%s" - Stock actual: %s, Mínimo: %s'
EXPIRING_TITLE, EXPIRING_MESSAGE = "Vence: %s (%s días)", 'Artículo "%s" vence %s'
EXPIRED_TITLE, EXPIRED_MESSAGE = "VENCIDO: %s", 'Artículo "%s" venció %s'
DEPLETED_TITLE = "Lote agotado: %s"
DEPLETED_MESSAGE = 'Lote "%s" del artículo "%s" se ha agotado'

KEY = ["item_id", "alert_type"]


def filled(template: str, *values: Column) -> Column:
    """The template with the values put in for each %s; NULL if any value is NULL."""
    pieces = template.split("%s")
    parts = [F.lit(pieces[0])]
    for piece, value in zip(pieces[1:], values):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def is_kind(kind: str) -> Column:
    return folded(F.col("alert_type")) == kind


def is_open() -> Column:
    return ~F.col("is_resolved")


def pending_alerts(alerts: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """Open alerts with item and category, the most urgent first."""
    kind, level = folded(F.col("a.alert_type")), folded(F.col("a.alert_level"))
    priority = (
        F.when(kind == EXPIRED, 1)
        .when((kind == EXPIRING) & (level == "critical"), 2)
        .when(level == "critical", 3)
        .when(level == "warning", 4)
        .otherwise(5)
    )
    a, i, c = alerts.filter(is_open()).alias("a"), items.alias("i"), categories.alias("c")
    return (
        a.join(i, F.col("a.item_id") == F.col("i.id"))
        .join(c, F.col("i.category_id") == F.col("c.id"))
        .select(
            "a.id", "a.alert_type", "a.alert_level", "a.title", "a.message",
            F.col("i.code").alias("item_code"), F.col("i.name").alias("item_name"),
            F.col("c.name").alias("category_name"), "a.current_value", "a.threshold_value",
            "a.expiration_date", "a.created_at", priority.alias("priority_order"),
        )
        .orderBy("priority_order", "created_at")
    )


def purge_alerts(alerts: DataFrame, now: datetime) -> DataFrame:
    """Drop alerts that resolved themselves long ago."""
    limit = F.lit(now - timedelta(days=KEEP_RESOLVED_DAYS))
    return delete_where(alerts, F.col("auto_resolve_date") < limit)


def _item_feed(items: DataFrame, now: datetime) -> DataFrame:
    """Expiring and expired items in stock, both found in one pass over the items."""
    today = F.lit(now.date())
    expires, name = F.col("expiration_date"), F.col("name")
    days = F.datediff(expires, today)
    written = F.date_format(expires, DAY_FORMAT)
    window = F.coalesce(F.col("expiration_alert_days"), F.lit(DEFAULT_ALERT_DAYS)).cast("int")
    level = (
        F.when(days <= CRITICAL_DAYS, "critical").when(days <= WARNING_DAYS, "warning")
        .otherwise("info")
    )

    def alert(kind: str, level: Column, title: Column, message: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("alert_type"), level.alias("alert_level"),
            title.alias("title"), message.alias("message"),
        )

    raised = F.array(
        F.when(
            expires <= F.date_add(today, window),
            alert(EXPIRING, level, filled(EXPIRING_TITLE, name, days), filled(EXPIRING_MESSAGE, name, written)),
        ),
        F.when(
            expires < today,
            alert(EXPIRED, F.lit("critical"), filled(EXPIRED_TITLE, name), filled(EXPIRED_MESSAGE, name, written)),
        ),
    )
    able = F.col("has_expiration") & F.col("is_active") & (F.col("current_stock") > 0)
    return (
        items.filter(able & expires.isNotNull())
        .select(
            F.col("id").alias("item_id"), "expiration_date",
            F.explode(F.filter(raised, lambda a: a.isNotNull())).alias("a"),
        )
        .select("item_id", "a.*", "expiration_date")
    )


def _batch_feed(batches: DataFrame, items: DataFrame) -> DataFrame:
    """One alert per item with a depleted batch; the batch with the lowest id is named.

    `raised_again` tells that a further batch finds the alert already there.
    """
    empty = (
        batches.filter((F.col("quantity_current") == 0) & F.col("is_active"))
        .groupBy("item_id")
        .agg(F.min_by("batch_number", "id").alias("batch_number"), F.count("*").alias("n_batches"))
    )
    names = items.select(F.col("id").alias("item_id"), "name")
    return empty.join(names, "item_id").select(
        "item_id", F.lit(DEPLETED).alias("alert_type"), F.lit("info").alias("alert_level"),
        filled(DEPLETED_TITLE, F.col("name")).alias("title"),
        filled(DEPLETED_MESSAGE, F.col("batch_number"), F.col("name")).alias("message"),
        "batch_number", (F.col("n_batches") > 1).alias("raised_again"),
    )


def expiration_feed(items: DataFrame, batches: DataFrame, now: datetime) -> DataFrame:
    """Alerts due today: expiring items, expired items, depleted batches."""
    return _raised(items, batches, now).drop("raised_again")


def _raised(items: DataFrame, batches: DataFrame, now: datetime) -> DataFrame:
    feed = _item_feed(items, now).unionByName(_batch_feed(batches, items), allowMissingColumns=True)
    return feed.withColumn("created_at", F.lit(now))


def daily_alerts(
    alerts: DataFrame, items: DataFrame, batches: DataFrame, now: datetime
) -> DataFrame:
    """The alert table after the daily run: purge, then raise or refresh.

    Only an open alert is refreshed; resolved ones are history. An expiring alert gets a new
    level and message but keeps its title; the other kinds only note the time. The second
    depleted batch of an item refreshes the alert that the first one raised in the same run.
    """
    kept = purge_alerts(alerts, now)
    again = F.when(F.col("raised_again"), F.lit(now))
    fresh = _raised(items, batches, now).withColumns(
        {"is_read": F.lit(False), "is_resolved": F.lit(False), "updated_at": again}
    )
    expiring = F.col("old.alert_type") == EXPIRING
    after = upsert(
        kept.filter(is_open()),
        fresh,
        KEY,
        {
            "alert_level": F.when(expiring, F.col("new.alert_level")).otherwise(F.col("old.alert_level")),
            "message": F.when(expiring, F.col("new.message")).otherwise(F.col("old.message")),
            "updated_at": F.lit(now),
        },
    )
    return after.unionByName(kept.filter(~is_open()))


def low_stock_episodes(
    posted: DataFrame, items: DataFrame, order: Sequence[str] = ORDER
) -> DataFrame:
    """One row per item and replenishment episode in which the stock fell to its minimum.

    Between two replenishments above the minimum, all low readings belong to one alert: the
    first reading opens it, the last gives its level, the replenishment resolves it. An
    episode without readings is kept if a replenishment ended it, to resolve an alert that
    was open before.
    """
    named = items.select(F.col("id").alias("item_id"), "name", "minimum_stock")
    low, arrival = F.col("is_low"), F.struct(*order)
    reading = F.struct("new_stock", "created_at")
    return (
        posted.filter(low | F.col("is_refilled"))
        .groupBy("item_id", "episode")
        .agg(
            F.min_by(reading, F.when(low, arrival)).alias("_first"),
            F.max_by(reading, F.when(low, arrival)).alias("_last"),
            F.count(F.when(low, 1)).alias("readings"),
            F.max(F.when(F.col("is_refilled"), F.col("created_at"))).alias("resolved_at"),
        )
        .withColumn("_first", F.when(F.col("readings") > 0, F.col("_first")))
        .withColumn("_last", F.when(F.col("readings") > 0, F.col("_last")))
        .join(named, "item_id")
    )


def low_stock_alerts(
    alerts: DataFrame, posted: DataFrame, items: DataFrame, order: Sequence[str] = ORDER
) -> DataFrame:
    """The alert table after a batch of posted movements."""
    episodes = low_stock_episodes(posted, items, order)
    name, minimum = F.col("name"), F.col("minimum_stock")
    opened, latest = F.col("_first.new_stock"), F.col("_last.new_stock")
    title = F.when(opened == 0, filled(NO_STOCK_TITLE, name)).otherwise(filled(LOW_STOCK_TITLE, name))
    resolved = F.col("resolved_at").isNotNull()
    rows = episodes.select(
        "item_id", F.lit(LOW_STOCK).alias("alert_type"), "episode", "readings",
        F.when(latest == 0, "critical").when(latest.isNotNull(), "warning").alias("alert_level"),
        title.alias("title"),
        filled(LOW_STOCK_MESSAGE, name, opened, minimum).alias("message"),
        minimum.alias("threshold_value"), latest.alias("current_value"),
        F.lit(False).alias("is_read"), resolved.alias("is_resolved"), "resolved_at",
        F.col("resolved_at").alias("auto_resolve_date"),
        F.col("_first.created_at").alias("created_at"),
        F.when(F.col("readings") > 1, F.col("_last.created_at")).alias("updated_at"),
        F.col("_last.created_at").alias("_seen"),
    )
    mine = F.coalesce(is_kind(LOW_STOCK) & is_open(), F.lit(False))
    standing = alerts.filter(mine).withColumns(
        {"alert_type": F.lit(LOW_STOCK), "episode": F.lit(0).cast("bigint"), "readings": F.lit(1).cast("bigint")}
    )
    after = upsert(
        standing, rows, [*KEY, "episode"],
        {
            "alert_level": F.coalesce("new.alert_level", "old.alert_level"),
            "current_value": F.coalesce("new.current_value", "old.current_value"),
            "is_resolved": F.col("new.is_resolved"),
            "resolved_at": F.coalesce("new.resolved_at", "old.resolved_at"),
            "auto_resolve_date": F.coalesce("new.auto_resolve_date", "old.auto_resolve_date"),
            "updated_at": F.coalesce("new._seen", "old.updated_at"),
        },
    )
    raised = after.filter("readings > 0").select(*alerts.columns)
    return alerts.filter(~mine).unionByName(raised)


def resolve_replenished(alerts: DataFrame, posted: DataFrame) -> DataFrame:
    """Resolve open low-stock alerts of items that a movement brought above the minimum."""
    refilled = (
        posted.filter("is_refilled").groupBy("item_id").agg(F.min("created_at").alias("_at"))
    )
    hit = is_kind(LOW_STOCK) & is_open() & F.col("_at").isNotNull()
    return update_where(
        alerts.join(refilled, "item_id", "left"),
        hit,
        {"resolved_at": F.col("_at"), "auto_resolve_date": F.col("_at"), "is_resolved": F.lit(True)},
    ).select(*alerts.columns)


def resolve_empty(
    alerts: DataFrame, items: DataFrame, touched: DataFrame, now: datetime
) -> DataFrame:
    """Of the alerts in `touched` (id), resolve open expiring ones whose item has no stock."""
    empty = items.filter(F.col("current_stock") == 0).select(
        F.col("id").alias("item_id"), F.lit(True).alias("_empty")
    )
    named = touched.select("id").distinct().withColumn("_touched", F.lit(True))
    hit = is_kind(EXPIRING) & is_open() & F.col("_empty").isNotNull() & F.col("_touched").isNotNull()
    joined = alerts.join(empty, "item_id", "left").join(named, "id", "left")
    return update_where(
        joined, hit, {"auto_resolve_date": F.lit(now), "is_resolved": F.lit(True)}
    ).select(*alerts.columns)
