"""The registered queries over the driver's tables."""

from . import audio_queries, container_queries, name_queries, packet_queries, player_queries, probe_queries, stream_queries, video_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
