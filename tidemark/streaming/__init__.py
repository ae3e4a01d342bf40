from .ingest import fan_out_stream, ingest_stream, progress_stream, read_progress
from .watch import archive_lag, replica_liveness, watch_required

__all__ = [
    "archive_lag",
    "fan_out_stream",
    "ingest_stream",
    "progress_stream",
    "read_progress",
    "replica_liveness",
    "watch_required",
]
