"""Column functions. All are built from Spark expressions; none is a Python UDF."""

from .digests import bytes_to_hex, label_start_lsn, label_timeline, manifest_checksum_ok, parse_backup_label, u32le
from .lsn import (
    SEGMENT_BYTES,
    format_lsn,
    int_div,
    last_segment_no,
    parse_lsn,
    segment_name,
    segment_no,
    segment_no_of_name,
    segments_between,
)
from .naming import (
    backup_id_of,
    basename,
    first_part,
    format_backup_id,
    is_archivable,
    is_backup_dir,
    is_backup_id,
    is_incremental_file,
    is_inline_wal,
    is_page_file,
    never_reuse,
    parent_from_id,
    segment_key,
    segment_kind,
    segment_prefix,
    sha_suffix,
    strip_sha_suffix,
    timeline_of,
    type_from_id,
    unsafe_path,
)
from .policy import codec_of, day_bucket, level_of, month_bucket, week_bucket, week_start
from .targets import Target, target_predicate

__all__ = [name for name in dir() if not name.startswith("_")]
