"""Costs, usage logs and saved items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.schema import ITEM_TYPES, TIERS

# Tiers with their reader and synthesiser, prices in USD per million tokens, estimates in USD.
LARGE, MID, SMALL = "claude-opus-4-20250514", "claude-sonnet-4-20250514", "claude-haiku-4-5-20251001"
MODELS = [("premium", MID, LARGE), ("standard", SMALL, LARGE), ("economy", SMALL, MID)]
PRICES = [(LARGE, 15.0, 75.0), (MID, 3.0, 15.0), (SMALL, 1.0, 5.0)]
ESTIMATES = {"premium": (0.027, 0.52), "standard": (0.005, 0.52), "economy": (0.005, 0.05)}


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "tier string, reader_model string, synth_model string")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


def tier_of(c: Column) -> Column:
    """The tier, premium for null, empty and unknown ones."""
    return F.when(c.isin(*TIERS), c).otherwise("premium")


def cost_of_calls(calls: DataFrame, price_list: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Calls, tokens and cost (six decimals) by the keys; models without a price cost nothing. Sums are exact decimals; total_cost_usd is their double."""
    rows = calls.join(price_list, "model", "left")
    of = lambda n, p: F.coalesce(F.col(n).cast("decimal(18,0)") * F.col(p).cast("decimal(10,4)"), F.lit(0).cast("decimal(29,4)"))
    cost = of("input_tokens", "input_price") + of("output_tokens", "output_price")
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost) / F.lit(1_000_000), 6).cast("double").alias("total_cost_usd"))


def cost_estimate(tier: Column, rulings: Column, transparency: Column) -> Column:
    rate = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, v in ESTIMATES.items() for x in (k, v[i]))), tier_of(tier))
    return rate(0) * rulings * F.when(transparency, 1.4).otherwise(1.0) + rate(1)


def usage_summary(logs: DataFrame, limit_rows: int | None = 100, newest: tuple = ("created_at", "id")) -> DataFrame:
    """n and cost by tier (null and empty ones are premium) over the newest rows, or over all with None; the sums of these rows are the totals."""
    rows = logs.orderBy(*(F.desc(c) for c in newest)).limit(limit_rows) if limit_rows else logs
    tier = F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("premium"))
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))


def valid_usage(logs: DataFrame) -> DataFrame:
    """Rows whose tier is one of the known ones or empty."""
    return logs.where(F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("premium")).isin(*TIERS))


def saved_items(items: DataFrame, user_id: str, kind: str | None = None) -> DataFrame:
    """A user's own items, newest first; of one type if asked."""
    own = items.where(F.col("user_id") == user_id)
    return (own.where(F.col("type") == kind) if kind else own).orderBy(F.desc("created_at"), "id")


def valid_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("type").isin(*ITEM_TYPES))


def without_item(items: DataFrame, user_id: str, item_id: str) -> DataFrame:
    """items without a user's own item."""
    return items.where(~((F.col("user_id") == user_id) & (F.col("id") == item_id)))


def strip_fields(df: DataFrame, list_col: str, fields: list[str], columns: list[str]) -> DataFrame:
    """df without the columns and without the fields of the structs in a list."""
    return df.withColumn(list_col, F.transform(list_col, lambda x: x.dropFields(*fields))).drop(*columns)


def item_title(prefix: str, text: Column, chars: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(text, 1, chars))


def ingest_stats(df: DataFrame, status_col: str = "status", total: int | None = None, elapsed: float | None = None) -> DataFrame:
    """processed, written, skipped, errors, and the share of `total` in percent (0 without one); with the seconds elapsed also per_second and eta_minutes (null without a total)."""
    n = lambda s: F.count_if(F.col(status_col) == s).alias(s)
    share = F.round(100.0 * F.count("*") / total, 1) if total else F.lit(0.0)
    out = df.agg(F.count("*").alias("processed"), n("written"), n("skipped"), n("errors"), share.alias("percent"))
    if elapsed is None:
        return out
    rate = F.col("processed") / max(elapsed, 1.0)
    left = (F.lit(total) - F.col("processed")) / F.greatest(rate, F.lit(0.1)) / 60
    return out.withColumn("per_second", F.round(rate, 1)).withColumn("eta_minutes", F.round(left, 1).cast("double"))


def fleet_rollup(servers: DataFrame, goal: int = 1_000_000, per_day: int = 57_000) -> DataFrame:
    """Servers (name, status, running, count, errors) with their state, and in a last row without a name the totals, the share of the goal and the days left."""
    state = F.when(F.col("status") == "OFFLINE", "OFFLINE").when(F.col("running") == 0, "STOPPED").otherwise("RUNNING")
    rows = servers.select("name", state.alias("state"), F.col("count").cast("long").alias("docs"), F.col("errors").cast("long").alias("errors"), F.lit(None).cast("double").alias("percent"), F.lit(None).cast("double").alias("eta_days"))
    total = rows.agg(F.lit(None).cast("string").alias("name"), F.when(F.count_if(F.col("state") != "RUNNING") > 0, "DEGRADED").otherwise("RUNNING").alias("state"), F.sum("docs").alias("docs"), F.sum("errors").alias("errors"))
    return rows.unionByName(total.select("*", F.round(F.col("docs") * 100.0 / goal, 1).alias("percent"), F.when(F.col("docs") > 0, F.round((goal - F.col("docs")) / per_day, 1)).alias("eta_days")))


def status_line(c: Column) -> Column:
    """running, count, errors, cost, log of a line of five fields parted by bars; fields that are no number count as 0, the log has 150 characters."""
    parts = F.split(c, r"\|", 5)
    part = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    number = lambda i: F.coalesce(F.when(part(i).rlike(r"^\d+$"), part(i)).try_cast("long"), F.lit(0).cast("long"))
    return F.struct(number(0).alias("running"), number(1).alias("count"), number(2).alias("errors"), part(3).alias("cost"), F.substring(part(4), 1, 150).alias("log"))


def of_known_users(rows: DataFrame, users: DataFrame, user_col: str = "user_id", id_col: str = "id") -> DataFrame:
    """Rows of users that exist, as is left when a user's deletion takes all that is theirs; rows without a user go too."""
    return rows.join(users.select(F.col(id_col).alias("__user")).distinct(), rows[user_col] == F.col("__user"), "left_semi")


def usage_list(logs: DataFrame, user_id: str | None = None, most: int = 100, newest: tuple = ("created_at", "id")) -> DataFrame:
    """The newest logs, of one user if asked."""
    own = logs if user_id is None else logs.where(F.col("user_id") == user_id)
    return own.orderBy(*(F.desc(c) for c in newest)).limit(most)
