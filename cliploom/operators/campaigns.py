"""Campaigns, clips, posts and what they earn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import earning, views_value


def posts_with_rates(campaigns: DataFrame, clips: DataFrame, posts: DataFrame) -> DataFrame:
    """One row for each post, or for a campaign or clip without any: campaign_id, clip_id, platform, status, views, value."""
    c = campaigns.select(F.col("id").alias("campaign_id"), "rate_per_1000_views")
    k = clips.select(F.col("id").alias("clip_id"), "campaign_id")
    p = posts.select("clip_id", "platform", "status", F.col("views_count").alias("views"))
    # posts are summed by clip before they meet the rest, so the large table shuffles once and small
    sums = p.groupBy("clip_id", "platform", "status").agg(F.sum("views").alias("views"), F.count("*").alias("n_posts"))
    rows = c.join(k, "campaign_id", "left").join(sums, "clip_id", "left")
    return rows.withColumn("value", views_value(F.col("views"), F.col("rate_per_1000_views")))


def report(campaigns: DataFrame, clips: DataFrame, posts: DataFrame) -> DataFrame:
    """Expected earnings by campaign, by clip, by platform and in all; accepted is the part of accepted posts.

    level says which: a null key of a subtotal is told from a missing clip or platform by it.
    """
    rows = posts_with_rates(campaigns, clips, posts)
    sets = F.when(F.grouping("campaign_id") == 0, "campaign").when(F.grouping("clip_id") == 0, "clip").when(F.grouping("platform") == 0, "platform").otherwise("total")
    accepted = F.when(F.col("status") == "accepted", F.col("value"))
    out = rows.groupingSets([["campaign_id"], ["clip_id"], ["platform"], []], "campaign_id", "clip_id", "platform").agg(
        sets.alias("level"), F.coalesce(F.sum("n_posts"), F.lit(0)).alias("n_posts"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"), earning(F.sum("value")).alias("expected"), F.coalesce(earning(F.sum(accepted)), F.lit(0.0)).alias("accepted")
    )
    return out.select("level", "campaign_id", "clip_id", "platform", "n_posts", "views", "expected", "accepted")


def budget_use(campaigns: DataFrame, clips: DataFrame, posts: DataFrame) -> DataFrame:
    """campaign_id, budget, expected, left: aggregated before the budget joins, so it counts once."""
    spent = posts_with_rates(campaigns, clips, posts).groupBy("campaign_id").agg(earning(F.sum("value")).alias("expected"))
    out = campaigns.select(F.col("id").alias("campaign_id"), F.col("budget").cast("double").alias("budget")).join(spent, "campaign_id")
    return out.withColumn("left", F.round(F.col("budget") - F.col("expected"), 4))


def audit(posts: DataFrame, earnings: DataFrame, clips: DataFrame, campaigns: DataFrame) -> DataFrame:
    """post_id, currency, stored, computed, differs: stored earnings against the formula; currencies are never summed together."""
    rate = clips.select(F.col("id").alias("clip_id"), "campaign_id").join(campaigns.select(F.col("id").alias("campaign_id"), "rate_per_1000_views"), "campaign_id")
    now = posts.select(F.col("id").alias("post_id"), "clip_id", "views_count").join(rate, "clip_id").select("post_id", earning(views_value(F.col("views_count"), F.col("rate_per_1000_views"))).alias("computed"))
    kept = earnings.groupBy("post_id", "currency").agg(F.sum("calculated_earning").cast("double").alias("stored"))
    return now.join(kept, "post_id", "left").select("post_id", "currency", "stored", "computed", (~F.col("stored").eqNullSafe(F.col("computed"))).alias("differs"))


def by_status(posts: DataFrame) -> DataFrame:
    """platform and how many posts are pending, accepted and rejected."""
    return posts.groupBy("platform").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "accepted", "rejected")))
