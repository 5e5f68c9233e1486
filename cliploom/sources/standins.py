"""Tables of the data model made from the driver's tables, and the same in SQL.

Times are made from running text length, speakers from roles; FIXTURES.md lists what stands in for what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import day_ms

#: Fixed rates per thousand views by market segment; none for the last.
RATES = {"AUTOMOBILE": "1.5000", "BUILDING": "2.2500", "FURNITURE": "0.7500", "HOUSEHOLD": "3.1000"}
HOUR = 3_600_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.lit(None).cast("decimal(18,4)")
    for segment, r in RATES.items():
        rate = F.when(F.col("c_mktsegment") == segment, F.lit(r).cast("decimal(18,4)")).otherwise(rate)
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int"))
    status = F.when(F.col("c_nationkey") % 5 == 0, "closed").otherwise("open")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(18,4)").alias("budget"), rate.alias("rate_per_1000_views"), start.alias("start_date"), F.date_add(start, 60).alias("end_date"), status.alias("status"))


CAMPAIGNS = f"""campaigns AS (
  SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS DECIMAL(18,4)) AS budget,
    CASE c_mktsegment {" ".join(f"WHEN '{s}' THEN CAST({r} AS DECIMAL(18,4))" for s, r in RATES.items())} END AS rate_per_1000_views,
    DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS start_date, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) + 60 AS end_date,
    CASE WHEN c_nationkey % 5 = 0 THEN 'closed' ELSE 'open' END AS status
  FROM customer
)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("video_source_id"), F.col("o_custkey").alias("campaign_id"), F.concat(F.lit("clip "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderdate").alias("created_at"))


CLIPS = """clips AS (
  SELECT o_orderkey AS id, o_orderkey % 100 AS video_source_id, o_custkey AS campaign_id, 'clip ' || o_orderkey AS title, o_orderdate AS created_at FROM orders
)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem has no key: id is (order, part, supplier, line) packed; rows that still agree are snapshots of one post."""
    line = F.col("l_linenumber")
    platform = F.when(line % 4 == 0, "TikTok").when(line % 4 == 1, "YT").when(line % 4 == 2, "IG").otherwise("X")
    status = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "N", "pending").otherwise("rejected")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + line).alias("id"), F.col("l_orderkey").alias("clip_id"), platform.alias("platform"), (F.col("l_quantity") * 1000).cast("long").alias("views_count"), status.alias("status"), F.col("l_shipdate").alias("last_checked_at"))


POSTS = """posts AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS clip_id,
    CASE l_linenumber % 4 WHEN 0 THEN 'TikTok' WHEN 1 THEN 'YT' WHEN 2 THEN 'IG' ELSE 'X' END AS platform, CAST(l_quantity * 1000 AS BIGINT) AS views_count,
    CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status, l_shipdate AS last_checked_at
  FROM lineitem
)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages; those under example.org have no recorded licence."""
    licence = F.when(F.contains("url", F.lit("example.org")), None).otherwise("owner consent")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url"), licence.alias("license_source"))


VIDEOS = """videos AS (
  SELECT page_id AS id, url AS source_url, CASE WHEN contains(url, 'example.org') THEN NULL ELSE 'owner consent' END AS license_source FROM pages
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word lasts 60 ms a letter; 100 ms go before each, 900 ms more before words of seven or fourteen letters."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("sent_idx"), F.col("role").alias("speaker"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word_idx", "word"))
    n = F.length("word")
    gap = F.when(n % 7 == 0, 1000).otherwise(100)
    end = F.sum((n * 60 + gap).cast("long")).over(W.partitionBy("video_id").orderBy("sent_idx", "word_idx"))
    return turns.select("video_id", "sent_idx", "speaker", F.col("word_idx").cast("long").alias("word_idx"), (end - n * 60).alias("start_ms"), end.alias("end_ms"), "word")


WORDS = """words AS (
  SELECT video_id, sent_idx, speaker, word_idx, CAST(e - length(word) * 60 AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, word FROM (
    SELECT *, sum(length(word) * 60 + CASE WHEN length(word) % 7 = 0 THEN 1000 ELSE 100 END) OVER (PARTITION BY video_id ORDER BY sent_idx, word_idx) AS e FROM (
      SELECT conv_id AS video_id, turn AS sent_idx, role AS speaker, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS word_idx
      FROM (SELECT *, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM conversations)))
)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled from words: ordered text, first start, last end."""
    from ..operators.transcripts import assemble

    return assemble(words(spark, sf_dir))


SENTENCES = """sentences AS (
  SELECT video_id, sent_idx, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY video_id, sent_idx, speaker
)"""


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as suggested moments."""
    kind = F.element_at(F.array(*map(F.lit, ("story", "strong opinion", "question", "surprising sentence"))), (F.col("sent_idx") % 4 + 1).cast("int"))
    return sentences(spark, sf_dir).select("video_id", F.col("sent_idx").alias("moment_id"), "start_ms", "end_ms", kind.alias("moment_type"), (F.length("text") % 101).cast("double").alias("score"))


MOMENTS = """moments AS (
  SELECT video_id, sent_idx AS moment_id, start_ms, end_ms, (['story', 'strong opinion', 'question', 'surprising sentence'])[sent_idx % 4 + 1] AS moment_type,
    CAST(length(text) % 101 AS DOUBLE) AS score FROM sentences
)"""


def spans(spark: SparkSession, sf_dir: str, kind: str, hours: int) -> DataFrame:
    """Events of one type as ranges: event_id, video_id, speaker, start_ms, end_ms."""
    ms = day_ms(F.col("ts"))
    return read(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", F.col("user_id").alias("video_id"), F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("speaker"), ms.alias("start_ms"), (ms + hours * HOUR).alias("end_ms"))


def spans_sql(name: str, kind: str, hours: int) -> str:
    return f"""{name} AS (
  SELECT event_id, user_id AS video_id, 'S' || (event_id % 3) AS speaker, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + {hours * HOUR} AS end_ms FROM events WHERE event_type = '{kind}'
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a face track: event_id, video_id, ts_ms, cx."""
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), day_ms(F.col("ts")).alias("ts_ms"), F.col("value").alias("cx"))


FRAMES = "frames AS (SELECT event_id, user_id AS video_id, epoch_us(ts) // 1000 AS ts_ms, value AS cx FROM events)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
