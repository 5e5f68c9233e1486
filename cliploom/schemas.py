"""Typed tables of the data model; media offsets are milliseconds in half-open ranges."""

from __future__ import annotations

MONEY = "decimal(18,4)"
CAMPAIGNS = f"id long, name string, platform_link string, budget {MONEY}, rate_per_1000_views {MONEY}, rules_notes string, start_date date, end_date date, status string"
CLIPS = "id long, video_source_id long, campaign_id long, file_path string, title string, hashtags array<string>, hook_text string, created_at timestamp"
POSTS = "id long, clip_id long, platform string, post_link string, views_count long, status string, last_checked_at timestamp"
EARNINGS = f"id long, post_id long, calculated_earning {MONEY}, currency string, notes string"
VIDEOS = "id long, source_url string, local_path string, license_source string, ingested_at timestamp"
WORD = "struct<word:string,start_ms:long,end_ms:long>"
SENTENCE = f"struct<sent_idx:int,start_ms:long,end_ms:long,text:string,words:array<{WORD}>>"
TRANSCRIPTS = f"video_id long, full_text string, sentences array<{SENTENCE}>"
SENTENCES = "video_id long, sent_idx int, speaker string, start_ms long, end_ms long, text string"
WORDS = "video_id long, sent_idx int, word_idx int, start_ms long, end_ms long, word string"
TRANSLATIONS = "video_id long, sent_idx int, lang string, text string"
TURNS = "video_id long, speaker string, start_ms long, end_ms long"
MOMENTS = "video_id long, moment_id long, start_ms long, end_ms long, moment_type string, score double"
FACE_TRACK = "video_id long, frame_idx long, ts_ms long, face_id int, cx double, cy double"
COMMENTS = "comment_id long, post_id long, text string"
CLIP_VARIANTS = "clip_id long, variant_id int, template_id string, hook_id string"
PLATFORM_PROFILES = "platform string, max_duration_ms long, width int, height int"
TEMPLATES = "name string, font struct<name:string,size:int,color:string>, logo_position string, caption struct<color:string,motion:string>, brand_colors array<string>"
CONTENT = "clip_id long, title string, description string, hashtags array<string>, hook string"
JOBS = "job_id long, source string, submitted_at timestamp"

#: Fixed values of the data model.
PLATFORMS = ("TikTok", "YT", "IG", "X")
POST_STATUS = ("pending", "accepted", "rejected")
MOMENT_TYPES = ("story", "strong opinion", "question", "surprising sentence")
