"""Records from folders that files keep arriving in."""

from seqloom.streaming.fastx import dedup_stream, stream_fasta

__all__ = ["dedup_stream", "stream_fasta"]
