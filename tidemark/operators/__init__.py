from .blocks import (
    block_range_check,
    changed_in_window,
    changed_in_windows,
    combine_chain,
    combine_chain_runs,
    page_check,
    page_fingerprint16,
    summary_gaps,
)
from .catalog import (
    build_catalog,
    distinct_backup_ids,
    filter_server,
    identity_check,
    label_collisions,
    latest_backups,
    manifest_header,
    server_inventory,
    update_annotation,
)
from .chains import orphans, resolve_chains
from .health import health_report
from .intervals import points_in_windows
from .prints import changes_by_prints
from .prune import prune_objects, prune_segments, prune_summary
from .replay import replay_to_target
from .replicate import replica_status, run_totals
from .resume import Gate, find_resumable, pending_files, reusable_objects, size_survivors, unfinished_backups
from .retention import Policy, kept_fulls, low_water, newest_chains, one_per_bucket, retention_plan
from .snapshot import incremental_snapshot, restore_chain, row_fingerprint
from .verify import mismatches, verify_files, verify_summary
from .wal import (
    classify_push,
    duplicate_segments,
    missing_runs,
    missing_segments,
    required_segments,
    segment_gaps,
    segment_records,
)

__all__ = [name for name in dir() if not name.startswith("_")]
