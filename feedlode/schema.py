"""Schemas of the tables, as DDL strings."""

from __future__ import annotations

RAW_SCHEMA = "source string, feed string, fetched_at timestamp, payload string"

POST_COLUMNS = [
    "id", "platform", "channel", "content_kind", "title", "content", "url", "author",
    "published_at", "matched_keywords",
]
POST_SCHEMA = (
    "id string, platform string, channel string, content_kind string, title string, "
    "content string, url string, author string, published_at timestamp, "
    "matched_keywords array<string>"
)
QUEUE_SCHEMA = POST_SCHEMA + ", ingested_at timestamp"

MODEL_SCHEMA = (
    "core_pain_point string, current_workaround string, commercial_potential int, "
    "saas_feasibility string, is_explicit_content boolean"
)

# Post columns that carry another name in the insights table.
INSIGHT_NAMES = {"id": "source_post_id", "url": "source_url", "content": "raw_content"}

INSIGHT_COLUMNS = [
    "id", "platform", "channel", "content_kind", "cluster_key", "cluster_label",
    "source_post_id", "title", "source_url", "author", "raw_content", "core_pain_point",
    "current_workaround", "commercial_potential", "saas_feasibility", "is_explicit_content",
    "matched_keywords", "analysis_model", "embedding_model", "embedding", "published_at",
    "created_at",
]
INSIGHT_SCHEMA = (
    "id bigint, platform string, channel string, content_kind string, cluster_key string, "
    "cluster_label string, source_post_id string, title string, source_url string, "
    "author string, raw_content string, core_pain_point string, current_workaround string, "
    "commercial_potential int, saas_feasibility string, is_explicit_content boolean, "
    "matched_keywords array<string>, analysis_model string, embedding_model string, "
    "embedding array<float>, published_at timestamp, created_at timestamp"
)
INSIGHT_KEYS = ["platform", "source_post_id"]
