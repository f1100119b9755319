"""Landed payloads and queue messages read into the post table."""
