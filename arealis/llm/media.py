"""Media columns: content-addressed payloads in tar shards, read back by byte range.

Rows of a table carry (digest, shard, offset, length) instead of bytes. A payload is kept
once however many rows have it. Metadata columns come from range reads of the stored
form's first 33 bytes, without the payload; features come from a read of the whole.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, new_path

WIDTH = 64
HEADER = 33  # signature and IHDR of the stored form


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of the text, zero-filled to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def payload_column(text: Column) -> Column:
    """``payload_of`` as a column."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    fill = F.greatest(F.lit(1), F.ceil(size / WIDTH)) * WIDTH - size
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), fill.cast("int"))))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """The payload as one line of an 8-bit greyscale PNG; lossless, and equal payloads give
    equal bytes."""
    body = zlib.compress(b"\0" + payload, 6)
    head = struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", head[16:25])


def from_image(image: bytes) -> bytes:
    """The payload of a stored form; checks every chunk's CRC."""
    width, height, bits = image_header(image[:HEADER])
    at, body = 8, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        part = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("stored payload is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * bits // 8 + 1)
    return lines[:, 1:].tobytes()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(payloads: DataFrame, root: str, shard_bytes: int = 256 << 20, pack_bytes: int = 1 << 20) -> DataFrame:
    """Store ``payloads(digest string, media binary)`` in tar shards under ``root``.

    Returns (digest, shard, offset, length), a row a distinct digest. Equal digests meet
    in one partition, sorted, and the first is stored. A shard is written under its
    attempt's own name and then moved, so that a task which runs again after the loss of
    an executor replaces what the first attempt left. Payloads share tar members of about
    ``pack_bytes``, named by their first digest: a member of its own would cost a small
    payload more than its size in tar's headers and padding. Memory: one pack, one
    payload and a buffer of 8 MB.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyspark import TaskContext

        part, fs, base = TaskContext.get().partitionId(), *_filesystem(root)
        fs.create_dir(base, recursive=True)
        tar, raw, at, n, last, attempt = None, None, 0, -1, None, uuid.uuid4().hex
        pack: list[tuple[str, bytes]] = []

        def close():
            if tar is not None:
                tar.close()
                raw.close()
                fs.move(f"{base}/.{attempt}-{n}", f"{base}/{part:06d}-{n:04d}.tar")

        def add():
            nonlocal tar, raw, at, n
            if tar is None or at > shard_bytes:
                close()
                n += 1
                raw, at = fs.open_output_stream(f"{base}/.{attempt}-{n}", buffer_size=8 << 20), 0
                tar = tarfile.open(fileobj=raw, mode="w|", bufsize=1 << 20)
            body = b"".join(m for _, m in pack)
            info = tarfile.TarInfo(pack[0][0])
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
            starts = at + 512 + np.cumsum([0, *(len(m) for _, m in pack)])
            at += 512 + -(-len(body) // 512) * 512
            out = pd.DataFrame({"digest": [d for d, _ in pack], "shard": f"{part:06d}-{n:04d}.tar", "offset": starts[:-1], "length": np.diff(starts)})
            pack.clear()
            return out

        size = 0
        for batch in batches:
            for digest, media in zip(batch["digest"], batch["media"], strict=True):
                if digest == last:
                    continue
                last = digest
                pack.append((digest, media))
                size += len(media)
                if size >= pack_bytes:
                    yield add()
                    size = 0
        if pack:
            yield add()
        close()

    kept = payloads.select("digest", "media")
    return kept.repartition("digest").sortWithinPartitions("digest").mapInPandas(write, "digest string, shard string, offset long, length long")


def read_metadata(index: DataFrame, root: str) -> DataFrame:
    """Add width, height and bits to (digest, shard, offset, length) from range reads of
    HEADER bytes; the payloads are not read."""

    def read(batches):
        fs, base = _filesystem(root)
        name, file = None, None
        for batch in batches:
            got = []
            for shard, offset in zip(batch["shard"], batch["offset"], strict=True):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{base}/{shard}")
                got.append(image_header(file.read_at(HEADER, offset)))
            yield batch.assign(**dict(zip(("width", "height", "bits"), np.array(got, dtype=np.int64).reshape(-1, 3).T, strict=True)))

    return index.mapInPandas(read, "digest string, shard string, offset long, length long, width long, height long, bits long")


def read_features(index: DataFrame, root: str) -> DataFrame:
    """Read stored payloads back and compute what needs their bytes. ``index`` has the
    columns of ``read_metadata``. Raises if bytes do not match their digest."""

    def read(batches):
        fs, base = _filesystem(root)
        name, file = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.shard != name:
                    name, file = row.shard, fs.open_input_file(f"{base}/{row.shard}")
                media = file.read_at(row.length, row.offset)
                payload = from_image(media)
                digest = hashlib.sha256(payload).hexdigest()
                if digest != row.digest:
                    raise ValueError(f"{row.shard} at {row.offset}: content does not match its address")
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                p = counts[counts > 0] / len(payload)
                feature = f"{row.width}x{row.height}x{row.bits}:distinct={len(p)}:mean={np.dot(counts, np.arange(256)) / len(payload):.4f}:entropy={abs(-(p * np.log2(p)).sum()):.4f}"
                out.append((row.digest, len(payload), digest, zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(out, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return index.mapInPandas(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, root: str) -> DataFrame:
    """Store the text of each row of ``docs(doc_id, text)`` as a media payload and return
    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, shard, offset), one row per input row.

    A null text is empty and has 64 zero bytes as its payload. Repeated rows give repeated
    rows; rows of equal text share one stored payload. Other columns are ignored. An empty
    table gives an empty result. Copies are dropped inside each map task before anything
    is shuffled, so a text that a third of all rows have reaches its shard once a task.
    """

    def encode(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text in batch["text"]:
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if len(seen) >= 1_000_000:  # bounds memory; what comes again is dropped at the shard
                        seen.clear()
                    seen.add(digest)
                    out.append((digest.hex(), to_image(payload)))
            yield pd.DataFrame(out, columns=["digest", "media"])

    index = cut(write_shards(docs.select("text").mapInPandas(encode, "digest string, media binary"), root), "media-index")
    found = read_features(read_metadata(index.repartition("shard").sortWithinPartitions("shard", "offset"), root), root)
    found = cut(found.join(index.select("digest", "shard", "offset"), "digest"), "media-features")
    rows = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(payload_column(F.col("text")), 256).alias("digest"),
    )
    return rows.join(found, "digest", "left").drop("digest")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir), new_path(spark, "media")).withColumnsRenamed({"shard": "media_shard", "offset": "media_offset"})
