"""Repositories as trees of files, written from the provided tables by the tasks that hold their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_path
from tidemark.sources.objects import _open_store

from .views import S

#: Codec of each of the six backups; the fourth has a wrong manifest print, the fifth is encrypted, the sixth has no sidecar.
CODECS = ("none", "gzip", "zstd", "none", "gzip", "zstd")


def _backup(number):
    return F.concat(F.lit("2026010"), number.cast("string"), F.lit("T000000F"))


def _write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes rows (path, content, codec, cut); a cut file loses its second half."""
    open_store = _open_store()

    def write(batches):
        import gzip
        import os

        import pyarrow as pa

        _, base = open_store(root)
        made = set()
        for rows in batches:
            for path, body, codec, cut in zip(*(rows.column(c).to_pylist() for c in ("path", "content", "codec", "cut")), strict=True):
                if codec == "gzip":
                    body = gzip.compress(body, mtime=0)
                elif codec == "zstd":
                    sink = pa.BufferOutputStream()
                    with pa.CompressedOutputStream(sink, codec) as stream:
                        stream.write(body)
                    body = sink.getvalue().to_pybytes()
                target = os.path.join(base, path)
                folder = os.path.dirname(target)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(target, "wb") as out:
                    out.write(body[: len(body) // 2] if cut else body)
            yield rows.select(["path"])

    return files.select("path", "content", "codec", "cut").mapInArrow(write, "path string")


def _write_manifests(entries: DataFrame, root: str) -> DataFrame:
    """Writes each backup's manifest as its entries stream by, in order of their paths."""
    open_store = _open_store()

    def write(batches):
        import hashlib
        import os

        import pyarrow as pa

        _, base = open_store(root)
        out, current = None, None

        def put(text):
            body = text.encode()
            out.write(body)
            print_.update(body)

        def finish():
            put('\n],\n"WAL-Ranges": [\n{ "Timeline": 1, "Start-LSN": "0/3000028", "End-LSN": "0/3100028" }\n],\n')
            digest = print_.hexdigest() if current[7] != "4" else "0" * 64
            out.write(f'"Manifest-Checksum": "{digest}"}}\n'.encode())
            out.close()

        for rows in batches:
            for backup, entry in zip(rows.column("backup_id").to_pylist(), rows.column("entry").to_pylist(), strict=True):
                if backup != current:
                    if out:
                        finish()
                    folder = os.path.join(base, backup)
                    os.makedirs(folder, exist_ok=True)
                    out, current, print_ = open(os.path.join(folder, "backup_manifest"), "wb"), backup, hashlib.sha256()
                    put('{ "PostgreSQL-Backup-Manifest-Version": 2,\n"System-Identifier": 5,\n"Files": [\n' + entry)
                else:
                    put(",\n" + entry)
            yield pa.RecordBatch.from_arrays([rows.column("backup_id")], names=["path"])
        if out:
            finish()

    return entries.repartition("backup_id").sortWithinPartitions("backup_id", "path").select("backup_id", "entry").mapInArrow(write, "path string")


def documents_tree(v: S) -> str:
    """Six backups that hold the documents as files: some are damaged, cut off, missing, of another size than stated, or extra."""
    root, d = scratch_path(v.spark, "tree"), F.col("doc_id")
    number = d % 6 + 1
    codec = F.element_at(F.array(*map(F.lit, CODECS)), number.cast("int"))
    text = F.coalesce("text", F.lit(""))
    docs = materialize(v.table("documents").select(d, text.alias("text"), _backup(number).alias("backup_id"), codec.alias("codec")))
    body = F.when(d % 37 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = F.concat_ws("/", "backup_id", F.lit("base"), d)
    files = docs.where(d % 41 != 0).select(path.alias("path"), F.encode(body, "UTF-8").alias("content"), "codec", (d % 47 == 0).alias("cut"))
    extra = docs.where(d % 43 == 0).select(F.concat(path, F.lit("x")).alias("path"), F.encode("text", "UTF-8").alias("content"), "codec", F.lit(False).alias("cut"))
    sidecar = F.format_string(
        '{"version": 3, "server": "s", "encryption_recipients": %s, "compression": "%s", "storage_layout_version": 1, "wal_segments": null, '
        '"system_identifier": 5, "directories": [], "type": "full"}', F.when(F.col("n") == 5, '["a"]').otherwise("null"),
        F.element_at(F.array(*map(F.lit, CODECS)), F.col("n").cast("int")),
    )
    present = docs.select(number.alias("n")).distinct().where("n <> 6")
    sidecars = present.select(F.concat_ws("/", _backup(F.col("n")), F.lit("Storage-Metadata.json")).alias("path"), F.encode(sidecar, "UTF-8").alias("content"), F.lit("none").alias("codec"), F.lit(False).alias("cut"))
    size = F.octet_length("text") + F.when(d % 53 == 0, 1).otherwise(0)
    entry = F.format_string('{ "Path": "base/%s", "Size": %s, "Last-Modified": "2026-01-01 00:00:00 GMT", "Checksum-Algorithm": "SHA256", "Checksum": "%s" }', d.cast("string"), size.cast("string"), F.sha2("text", 256))
    manifests = _write_manifests(docs.select("backup_id", F.concat(F.lit("base/"), d).alias("path"), entry.alias("entry")), root)
    for written in (files, extra, sidecars):
        _write_files(written, root).write.format("noop").mode("overwrite").save()
    manifests.write.format("noop").mode("overwrite").save()
    return root


TREE_SQL = """
    SELECT doc_id AS d, '2026010' || (doc_id % 6 + 1) || 'T000000F' AS backup_id, doc_id % 6 + 1 AS n,
           CASE WHEN doc_id % 41 = 0 THEN 'MISSING' WHEN doc_id % 6 = 4 THEN 'ENCRYPTED'
                WHEN doc_id % 47 = 0 AND doc_id % 6 NOT IN (0, 3) THEN 'UNDECODABLE'
                WHEN doc_id % 37 = 0 OR (doc_id % 47 = 0 AND strlen(text) > 0) THEN 'MISMATCH'
                WHEN doc_id % 53 = 0 THEN 'SIZE' ELSE 'OK' END AS status
    FROM documents WHERE doc_id % 6 <> 5
    UNION ALL SELECT doc_id, '2026010' || (doc_id % 6 + 1) || 'T000000F', doc_id % 6 + 1, 'EXTRA' FROM documents WHERE doc_id % 43 = 0 AND doc_id % 6 <> 5"""


# --- a full backup and two increments, as files of pages -----------------------------

PAGE = 512


def _le32(number):
    h = F.lpad(F.hex(number.cast("bigint")), 8, "0")
    return F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])


def _increment(doc_id, pos: int, numbers: tuple[int, ...], limit, magic):
    head = F.concat(_le32(magic), _le32(F.lit(len(numbers))), _le32(limit), *[_le32(F.lit(n)) for n in numbers])
    pages = [F.rpad(F.md5(F.concat_ws(":", doc_id, F.lit(pos), F.lit(n))), PAGE, "z") for n in numbers]
    return F.concat(F.unhex(head), *[F.encode(p, "UTF-8") for p in pages])


def pages_tree(v: S) -> tuple[str, DataFrame]:
    """``(root, files)``: documents as files of 512-byte pages, and increments of a third and of a half of them, the second gzipped."""
    root, d = scratch_path(v.spark, "chain"), F.col("doc_id")
    docs = v.table("documents").select(d, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    magic = F.when(d % 29 == 0, F.lit(0x11223344)).otherwise(F.lit(0x494E4352))
    limit = F.when(d % 4 == 0, 2).otherwise(100)
    parts = [
        docs.select(F.lit("none").alias("codec"), F.concat(F.lit("base/"), d).alias("path"), F.lit(0).alias("chain_pos"), F.col("body").alias("content")),
        docs.where(d % 3 == 0).select(F.lit("none").alias("codec"), F.concat(F.lit("base/INCREMENTAL."), d).alias("path"), F.lit(1).alias("chain_pos"), _increment(d, 1, (0, 2), F.lit(3), magic).alias("content")),
        docs.where(d % 2 == 0).select(F.lit("gzip").alias("codec"), F.concat(F.lit("base/INCREMENTAL."), d).alias("path"), F.lit(2).alias("chain_pos"), _increment(d, 2, (1,), limit, F.lit(0x494E4352)).alias("content")),
    ]
    files = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    location = F.concat_ws("/", "chain_pos", "path")
    _write_files(files.select(location.alias("path"), "content", "codec", F.lit(False).alias("cut")), root).write.format("noop").mode("overwrite").save()
    return root, files.select("path", "chain_pos", location.alias("location"), "codec", F.octet_length("content").cast("bigint").alias("size"))


PAGES_SQL = """
    SELECT doc_id, 0 AS chain_pos, b AS block_no, sha256(array_slice(body, b * 512 + 1, least(b * 512 + 512, octet_length(body)))) AS sha256
    FROM (SELECT doc_id, body, unnest(range((octet_length(body) + 511) // 512)) AS b FROM (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents))
    UNION ALL SELECT doc_id, 1, n, sha256(rpad(md5(doc_id || ':1:' || n), 512, 'z')) FROM documents, (VALUES (0), (2)) t(n) WHERE doc_id % 3 = 0 AND doc_id % 29 <> 0
    UNION ALL SELECT doc_id, 2, 1, sha256(rpad(md5(doc_id || ':2:1'), 512, 'z')) FROM documents WHERE doc_id % 2 = 0"""
