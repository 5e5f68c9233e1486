"""Campaign analytics over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import earning, views_value
from ..operators import campaigns as C
from ..operators import ordering, planning
from ..sources import standins as S

BASE = f"WITH {S.CAMPAIGNS}, {S.CLIPS}, {S.POSTS}"


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return S.campaigns(spark, d), S.clips(spark, d), S.posts(spark, d)


def campaign_report(spark: SparkSession, d: str) -> DataFrame:
    return C.report(*_three(spark, d))


def post_earnings(spark: SparkSession, d: str) -> DataFrame:
    campaigns, clips, posts = _three(spark, d)
    rates = clips.select(F.col("id").alias("clip_id"), "campaign_id").join(campaigns.select(F.col("id").alias("campaign_id"), "rate_per_1000_views"), "campaign_id")
    rows = posts.join(rates, "clip_id")
    return rows.select(F.col("id").alias("post_id"), "campaign_id", "platform", "status", "views_count", earning(views_value(F.col("views_count"), F.col("rate_per_1000_views"))).alias("expected"))


def earnings_audit(spark: SparkSession, d: str) -> DataFrame:
    """Posts that are no longer pending have stored earnings."""
    campaigns, clips, posts = _three(spark, d)
    posts = posts.groupBy("id", "clip_id").agg(F.max("views_count").alias("views_count"), F.min("status").alias("status"))
    stored = posts.where("status != 'pending'").select(F.col("id").alias("post_id"), (F.col("views_count") * F.lit("0.0015").cast("decimal(18,4)")).cast("decimal(18,4)").alias("calculated_earning"), F.when(F.col("id") % 2 == 0, "USD").otherwise("EUR").alias("currency"))
    return C.audit(posts, stored, clips, campaigns)


def posts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return C.by_status(S.posts(spark, d))


def budget_use(spark: SparkSession, d: str) -> DataFrame:
    return C.budget_use(*_three(spark, d))


def latest_post_state(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("last_checked_at").desc(), F.col("views_count").desc(), F.col("status")]
    rows = ordering.latest(S.posts(spark, d), ["id"], order)
    return rows.select("id", "clip_id", "platform", "views_count", "status", F.col("last_checked_at").cast("date").cast("string").alias("last_checked_on"))


def active_campaigns(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2024-06-01").cast("date")
    rows = S.campaigns(spark, d).where((F.col("status") == "open") & day.between(F.col("start_date"), F.col("end_date")))
    return rows.select("id", "name", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


def unposted_clips(spark: SparkSession, d: str) -> DataFrame:
    return S.clips(spark, d).alias("c").join(S.posts(spark, d).alias("p"), F.expr("c.id = p.clip_id"), "left_anti").select("id", "campaign_id", "title")


def licensed_clips(spark: SparkSession, d: str) -> DataFrame:
    licensed = planning.licensed(S.videos(spark, d)).select(F.col("id").alias("video_source_id"))
    return S.clips(spark, d).join(licensed, "video_source_id", "left_semi").select("id", "video_source_id")


def license_gate(spark: SparkSession, d: str) -> DataFrame:
    return planning.licensed(S.videos(spark, d))


def library_overview(spark: SparkSession, d: str) -> DataFrame:
    return S.clips(spark, d).groupBy("video_source_id").agg(F.count("*").alias("n_clips"), F.count_distinct("campaign_id").alias("n_campaigns"), F.min("created_at").cast("date").cast("string").alias("first_day"))


def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by arrival; their place is counted within each day, so no task holds them all."""
    jobs = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return ordering.top(jobs, ["day"], [F.col("job_id")], 1 << 62)


def comments_by_clip(spark: SparkSession, d: str) -> DataFrame:
    comments = S.read(spark, d, "conversations").select(((F.col("conv_id") * 8 + 8 + F.col("turn") % 3)).alias("post_id"), "text")
    posts = S.posts(spark, d).groupBy("id", "clip_id").agg(F.count("*").alias("n")).select(F.col("id").alias("post_id"), "clip_id")
    return comments.join(posts, "post_id").groupBy("clip_id").agg(F.count("*").alias("n_comments"), F.sum(F.length("text")).alias("letters"))


def platform_plan(spark: SparkSession, d: str) -> DataFrame:
    profiles = spark.createDataFrame([("TikTok", 60_000, 1080, 1920), ("YT", 60_000, 1080, 1920), ("IG", 90_000, 1080, 1920), ("X", 140_000, 720, 1280)], "platform string, max_duration_ms long, width int, height int")
    clips = S.clips(spark, d).select(F.col("id").alias("clip_id"), (F.col("id") % 200 * 1000).alias("duration_ms"))
    return planning.platform_plan(clips, profiles).select("clip_id", "platform", "duration_ms", "fits")


def ab_variants(spark: SparkSession, d: str) -> DataFrame:
    return planning.variants(S.clips(spark, d).select(F.col("id").alias("clip_id")), ["plain", "bold", "neon"], ["question", "claim"])


def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    return planning.export_manifest(S.clips(spark, d).select(F.col("id").alias("clip_id")))


QUERIES = [campaign_report, post_earnings, earnings_audit, posts_by_status, budget_use, latest_post_state, active_campaigns, unposted_clips, licensed_clips, license_gate, library_overview, queue_order, comments_by_clip, platform_plan, ab_variants, export_manifest]

SQL = {
    "campaign_report": f"""{BASE},
rows AS (
  SELECT c.id AS campaign_id, k.id AS clip_id, p.platform, p.clip_id IS NOT NULL AS posted, p.status, p.views_count AS views, coalesce(p.views_count, 0) * coalesce(c.rate_per_1000_views, CAST(0 AS DECIMAL(18,4))) AS value
  FROM campaigns c LEFT JOIN clips k ON k.campaign_id = c.id LEFT JOIN posts p ON p.clip_id = k.id
)
SELECT CASE WHEN grouping(campaign_id) = 0 THEN 'campaign' WHEN grouping(clip_id) = 0 THEN 'clip' WHEN grouping(platform) = 0 THEN 'platform' ELSE 'total' END AS level,
  campaign_id, clip_id, platform, CAST(count(*) FILTER (posted) AS BIGINT) AS n_posts, CAST(coalesce(sum(views), 0) AS BIGINT) AS views,
  round(CAST(sum(value) AS DOUBLE) / 1000, 4) AS expected, coalesce(round(CAST(sum(value) FILTER (status = 'accepted') AS DOUBLE) / 1000, 4), 0.0) AS accepted
FROM rows GROUP BY GROUPING SETS ((campaign_id), (clip_id), (platform), ())""",
    "post_earnings": f"""{BASE}
SELECT p.id AS post_id, campaign_id, platform, p.status, views_count, round(CAST(views_count * coalesce(rate_per_1000_views, CAST(0 AS DECIMAL(18,4))) AS DOUBLE) / 1000, 4) AS expected
FROM posts p JOIN clips k ON p.clip_id = k.id JOIN campaigns c ON k.campaign_id = c.id""",
    "earnings_audit": f"""{BASE},
p AS (SELECT id, clip_id, max(views_count) AS views_count, min(status) AS status FROM posts GROUP BY id, clip_id),
e AS (SELECT id AS post_id, CAST(views_count * CAST(0.0015 AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS calculated_earning, CASE WHEN id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM p WHERE status <> 'pending'),
s AS (SELECT post_id, currency, CAST(sum(calculated_earning) AS DOUBLE) AS stored FROM e GROUP BY post_id, currency),
n AS (SELECT p.id AS post_id, round(CAST(views_count * coalesce(rate_per_1000_views, CAST(0 AS DECIMAL(18,4))) AS DOUBLE) / 1000, 4) AS computed FROM p JOIN clips k ON p.clip_id = k.id JOIN campaigns c ON k.campaign_id = c.id)
SELECT n.post_id, currency, stored, computed, stored IS DISTINCT FROM computed AS differs FROM n LEFT JOIN s ON n.post_id = s.post_id""",
    "posts_by_status": f"""WITH {S.POSTS} SELECT platform, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM posts GROUP BY platform""",
    "budget_use": f"""{BASE}
SELECT *, round(budget - expected, 4) AS "left" FROM (
  SELECT c.id AS campaign_id, CAST(any_value(budget) AS DOUBLE) AS budget, round(CAST(sum(coalesce(views_count, 0) * coalesce(rate_per_1000_views, CAST(0 AS DECIMAL(18,4)))) AS DOUBLE) / 1000, 4) AS expected
  FROM campaigns c LEFT JOIN clips k ON k.campaign_id = c.id LEFT JOIN posts p ON p.clip_id = k.id GROUP BY c.id)""",
    "latest_post_state": f"""WITH {S.POSTS}
SELECT id, clip_id, platform, views_count, status, CAST(CAST(last_checked_at AS DATE) AS VARCHAR) AS last_checked_on FROM posts
QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_checked_at DESC, views_count DESC, status) = 1""",
    "active_campaigns": f"""WITH {S.CAMPAIGNS}
SELECT id, name, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date FROM campaigns WHERE status = 'open' AND DATE '2024-06-01' BETWEEN start_date AND end_date""",
    "unposted_clips": f"WITH {S.CLIPS}, {S.POSTS} SELECT id, campaign_id, title FROM clips WHERE id NOT IN (SELECT clip_id FROM posts)",
    "licensed_clips": f"WITH {S.CLIPS}, {S.VIDEOS} SELECT id, video_source_id FROM clips WHERE video_source_id IN (SELECT id FROM videos WHERE license_source IS NOT NULL)",
    "license_gate": f"WITH {S.VIDEOS} SELECT * FROM videos WHERE license_source IS NOT NULL",
    "library_overview": f"WITH {S.CLIPS} SELECT video_source_id, count(*) AS n_clips, count(DISTINCT campaign_id) AS n_campaigns, CAST(CAST(min(created_at) AS DATE) AS VARCHAR) AS first_day FROM clips GROUP BY video_source_id",
    "queue_order": "SELECT o_orderkey AS job_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rank FROM orders",
    "comments_by_clip": f"""WITH {S.POSTS}, c AS (SELECT conv_id * 8 + 8 + turn % 3 AS post_id, text FROM conversations)
SELECT clip_id, count(*) AS n_comments, CAST(sum(length(text)) AS BIGINT) AS letters FROM c JOIN (SELECT DISTINCT id AS post_id, clip_id FROM posts) USING (post_id) GROUP BY clip_id""",
    "platform_plan": f"""WITH {S.CLIPS}, p(platform, most) AS (VALUES ('TikTok', 60000), ('YT', 60000), ('IG', 90000), ('X', 140000))
SELECT id AS clip_id, platform, id % 200 * 1000 AS duration_ms, id % 200 * 1000 <= most AS fits FROM clips CROSS JOIN p""",
    "ab_variants": f"""WITH {S.CLIPS}, t(k, template_id) AS (VALUES (0, 'plain'), (1, 'bold'), (2, 'neon')), h(j, hook_id) AS (VALUES (0, 'question'), (1, 'claim'))
SELECT id AS clip_id, template_id, hook_id, CAST(k * 2 + j + 1 AS BIGINT) AS variant_id FROM clips CROSS JOIN t CROSS JOIN h""",
    "export_manifest": f"""WITH {S.CLIPS}, f(format) AS (VALUES ('mp4'), ('srt'), ('vtt'), ('ass'))
SELECT id AS clip_id, format, 'clips/' || id || '.' || format AS path FROM clips CROSS JOIN f""",
}
