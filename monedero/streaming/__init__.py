"""Incremental ingest of a folder of statement files."""

from monedero.streaming.upload_stream import ingest_stream

__all__ = ["ingest_stream"]
