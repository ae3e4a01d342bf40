from .codecs import content_digests, decode_contents, detected_codec, dual_digest
from .metadata import (
    decode_sidecars,
    manifest_files,
    manifest_headers,
    scan_checkpoints,
    scan_manifests,
    scan_sidecars,
    wal_ranges,
)
from .objects import (
    filter_source_tree,
    read_bodies,
    scan_contents,
    scan_objects,
    scan_segments,
    split_backup_path,
    split_unsafe,
    stored_digests,
    visible_objects,
)
from .ordered import read_sorted, write_sorted
from .pages import PAGE_BYTES, combine_files, explode_blocks, fetch_pages, scan_incremental_files, scan_page_index

__all__ = [name for name in dir() if not name.startswith("_")]
