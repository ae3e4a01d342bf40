"""Writes a small repository tree: backups, sidecars, manifests and log segments."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import os
from datetime import datetime, timedelta, timezone

import pyarrow as pa

SERVER = "main"


def segment(seg_no: int, tli: int = 1) -> str:
    return f"{tli:08X}{seg_no // 256:08X}{seg_no % 256:08X}"


def lsn_text(x: int) -> str:
    return f"{x >> 32:X}/{x & 0xFFFFFFFF:X}"


def compress(body: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.compress(body)
    if codec == "bzip2":
        return bz2.compress(body)
    if codec in ("zstd", "lz4"):
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, codec) as stream:
            stream.write(body)
        return sink.getvalue().to_pybytes()
    return body


class Builder:
    def __init__(self, root: str):
        self.root = root
        self.next_lsn = 0x3000028

    def put(self, path: str, body: bytes) -> str:
        full = os.path.join(self.root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(body)
        return full

    def full(self, ts: datetime, **options) -> str:
        return self._backup(f"{ts:%Y%m%dT%H%M%S}F", ts, "full", "", **options)

    def incremental(self, parent: str, ts: datetime, **options) -> str:
        return self._backup(f"{parent}_{ts:%Y%m%dT%H%M%S}I", ts, "incremental", parent, **options)

    def orphan(self, ts: datetime) -> str:
        return self.incremental("20200101T000000F", ts)

    def wal(self, seg_no: int, tli: int = 1, body: bytes | None = None, bare: bool = False) -> str:
        body = body if body is not None else f"segment {seg_no}".encode()
        name = segment(seg_no, tli)
        suffix = "" if bare else "-" + hashlib.sha256(body).hexdigest()
        return self.put(f"wal/{tli:08X}/{name}{suffix}", body)

    def _backup(self, backup_id, ts, kind, parent, codec="none", files=None, recipients=None, sidecar_type=True, system_id=1234567890):
        files = files or {"PG_VERSION": b"18\n"}
        start, stop = self.next_lsn, self.next_lsn + 0x100000
        self.next_lsn += 0x100000
        entries = []
        for path, body in files.items():
            self.put(f"{backup_id}/{path}", compress(body, codec))
            entries.append(
                '{ "Path": "%s", "Size": %d, "Last-Modified": "%s GMT", "Checksum-Algorithm": "SHA256", "Checksum": "%s" }'
                % (path, len(body), ts.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), hashlib.sha256(body).hexdigest())
            )
        head = (
            '{ "PostgreSQL-Backup-Manifest-Version": 2,\n"System-Identifier": %d,\n"Files": [\n%s\n],\n"WAL-Ranges": [\n'
            '{ "Timeline": 1, "Start-LSN": "%s", "End-LSN": "%s" }\n],\n' % (system_id, ",\n".join(entries), lsn_text(start), lsn_text(stop))
        ).encode()
        self.put(f"{backup_id}/backup_manifest", head + b'"Manifest-Checksum": "' + hashlib.sha256(head).hexdigest().encode() + b'"}\n')
        sidecar = {
            "version": 3, "server": SERVER, "encryption_recipients": recipients, "compression": codec, "storage_layout_version": 1,
            "wal_segments": None, "system_identifier": system_id, "directories": [], "annotation": "note",
        }
        if sidecar_type:
            sidecar |= {"type": kind}
        if parent:
            sidecar["parent_backup_id"] = parent
        self.put(f"{backup_id}/Storage-Metadata.json", json.dumps(sidecar, indent=2).encode())
        return backup_id


def flip_middle(path: str) -> None:
    with open(path, "r+b") as f:
        body = bytearray(f.read())
        body[len(body) // 2] ^= 0xFF
        f.seek(0)
        f.write(body)


def day(n: float) -> datetime:
    return datetime(2026, 3, 1, 12, tzinfo=timezone.utc) + timedelta(days=n)
