"""Compressed bodies: decoding and digests.

Arrow batches go to the tasks that hold the bodies; no body is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codec name to the leading bytes (hex) of its stream format: fixed values.
MAGIC = {
    "gzip": "1F8B",
    "bzip2": "425A68",
    "zstd": "28B52FFD",
    "lz4": "04224D18",
}


def detected_codec(content: Column | str) -> Column:
    """Codec suggested by the first bytes; ``none`` when nothing is recognised."""
    start = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 4))
    out = None
    for name, magic in MAGIC.items():
        test = start.startswith(magic)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("none")


DIGEST_FIELDS = [
    T.StructField("stored_size", T.LongType()),
    T.StructField("stored_sha256", T.StringType()),
    T.StructField("plain_size", T.LongType()),
    T.StructField("plain_sha256", T.StringType()),
    T.StructField("error", T.StringType()),
]


def _decoder():
    """Opens a decoding stream; a closure, so that tasks need no package import."""
    import pyarrow as pa

    arrow_name = {"gzip": "gzip", "bzip2": "bz2", "zstd": "zstd", "lz4": "lz4"}

    def decoded(codec, source):
        return pa.CompressedInputStream(source, arrow_name[codec])

    return decoded


def digest_function():
    """``digest(stream, codec)``: both digests of one body in one pass, chunk by chunk."""
    decoded = _decoder()

    def digest(stream, codec, chunk=4 << 20):
        import hashlib

        import pyarrow as pa

        stored, stored_size = hashlib.sha256(), 0

        class Tap:
            """Hashes the stored bytes on their way into the decoder."""

            closed = False

            def read(self, n=-1):
                nonlocal stored_size
                part = stream.read(chunk if n is None or n < 0 else n)
                stored.update(part)
                stored_size += len(part)
                return part

            def readable(self):
                return True

            def close(self):
                pass

        tap, plain, plain_size, error = Tap(), None, 0, None
        if codec not in (None, "", "none"):
            plain = hashlib.sha256()
            try:
                with decoded(codec, pa.PythonFile(tap, mode="r")) as body:
                    while part := body.read(chunk):
                        plain.update(part)
                        plain_size += len(part)
            except KeyError:
                error = f"unknown codec {codec}"
            except (OSError, pa.ArrowInvalid) as exc:
                error = f"decompress: {exc}"
        while tap.read(chunk):
            pass
        if error:
            return stored_size, stored.hexdigest(), None, None, error
        if plain is None:
            plain, plain_size = stored, stored_size
        return stored_size, stored.hexdigest(), plain_size, plain.hexdigest(), None

    return digest


#: Decoded bytes that are handed on together, about; a body is never cut.
SENT_BYTES = 4 << 20


def decode_contents(contents: DataFrame, codec: str = "codec") -> DataFrame:
    """Replace ``content`` by its decoded form; ``error`` tells why it is NULL.

    Bodies leave a task as they are decoded, so it holds one batch of stored
    bodies and about ``SENT_BYTES`` of decoded ones, or one body if that is larger.
    """
    most = SENT_BYTES
    keep = [f for f in contents.schema.fields if f.name != "content"]
    schema = T.StructType([*keep, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    decoded = _decoder()

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            bodies, errors, held, first = [], [], 0, 0
            column, codecs = batch.column("content"), batch.column(codec)
            for i in range(batch.num_rows):
                name, value, body, error = codecs[i].as_py(), column[i], None, None
                try:
                    if value.is_valid and name in (None, "", "none"):
                        body = value.as_py()
                    elif value.is_valid:
                        with decoded(name, pa.BufferReader(value.as_buffer())) as stream:
                            body = stream.read()
                except KeyError:
                    error = f"unknown codec {name}"
                except (OSError, pa.ArrowInvalid) as exc:
                    error = f"decompress: {exc}"
                bodies.append(body)
                errors.append(error)
                held += len(body or b"")
                if held < most and i + 1 < batch.num_rows:
                    continue
                columns = [batch.column(f.name).slice(first, len(bodies)) for f in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(bodies, pa.binary()), pa.array(errors, pa.string())],
                    names=[f.name for f in schema.fields],
                )
                bodies, errors, held, first = [], [], 0, i + 1

    return contents.mapInArrow(decode, schema)


def dual_digest(contents: DataFrame, codec: str = "codec") -> DataFrame:
    """Stored and plain size and SHA-256 of each body, in one pass.

    Decoded bytes are hashed chunk by chunk where they are produced and are
    never handed back, so a row leaves as a few hundred bytes.
    """
    keep = [f for f in contents.schema.fields if f.name != "content"]
    schema = T.StructType([*keep, *DIGEST_FIELDS])
    digest_stream = digest_function()

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            column, codecs = batch.column("content"), batch.column(codec)
            for i in range(batch.num_rows):
                if column[i].is_valid:
                    found.append(digest_stream(pa.BufferReader(column[i].as_buffer()), codecs[i].as_py()))
                else:
                    found.append((None, None, None, None, "no content"))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            cells = [pa.array([row[k] for row in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + cells, names=schema.names)

    return contents.mapInArrow(digest, schema)


def content_digests(contents: DataFrame, compressed: bool = True) -> DataFrame:
    """``dual_digest`` with the codec read from each body's first bytes.

    Without compressed bodies in the repository the JVM hashes alone and no
    Python worker starts.
    """
    if compressed:
        return dual_digest(contents.withColumn("codec", detected_codec("content")))
    keep = [c for c in contents.columns if c != "content"]
    sha, size = F.sha2("content", 256), F.octet_length("content").cast("bigint")
    return contents.select(
        *keep,
        F.lit("none").alias("codec"),
        size.alias("stored_size"),
        sha.alias("stored_sha256"),
        size.alias("plain_size"),
        sha.alias("plain_sha256"),
        F.lit(None).cast("string").alias("error"),
    )
