"""Media columns: payloads in archives, read through a Spark data source.

The source writes members into zip archives of bounded size, one run of archives per task, and names the
archives of finished tasks in a manifest when all have ended; what a lost or repeated task left is never
read. To read, it plans byte ranges over the archives of the manifest. A task reads the archive's own
directory, takes the members that begin in its range, and streams them out in Arrow batches of bounded
size. Each member is fetched by its offset, checked against its checksum and retried alone, on a freshly
opened file, so that one bad read doesn't repeat the others.

A payload is stored as a WAV file of 8-bit mono samples, one sample a byte, so nothing is lost. Members are
deflated in the archive. The folder must be one that all executors reach: a path, a ``file:`` URI, or any URI
that pyarrow opens.

Defined cases: null texts are empty; the payload is padded with zero bytes to a positive multiple of 64;
equal texts have equal payloads, media and features; repeated rows are repeated members; a null id stays
null. A member that can't be read after all attempts fails the task. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemark.llm.base import column, steps
from tidemark.llm.registry import query
from tidemark.session import stage_folder

FORMAT = "wav_archive"
UNIT = 64
RATE = 8000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
MANIFEST = "manifest.json"


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(-(-len(raw) // UNIT), 1) * UNIT, b"\0")


def to_wav(samples: bytes) -> bytes:
    """RIFF file of unsigned 8-bit mono samples."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk, wherever it stands."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature(samples: bytes) -> str:
    """Mean, root mean square and peak about the middle level, crossings of it, and an envelope of eight parts."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    sign = x >= 0
    parts = [int(np.abs(p).sum() // len(p)) for p in np.array_split(x, 8)]
    return (
        f"mean={x.sum() / len(x):.4f} rms={np.sqrt((x * x).sum() / len(x)):.4f} peak={int(np.abs(x).max())} "
        f"crossings={int((sign[1:] != sign[:-1]).sum())} envelope={'-'.join(map(str, parts))}"
    )


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int

    def __post_init__(self):
        self.value = (self.archive, self.start, self.end)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.folder)
        store.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        done: list[tuple[str, int]] = []
        stream = archive = None
        n = 0

        def finish():
            archive.close()
            size = stream.tell()
            stream.close()
            done.append((name, size))

        for batch in iterator:
            for part in steps(batch, "text", BATCH_BYTES):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if archive is None:
                        name = f"{attempt}-{len(done):05d}.zip"
                        stream = store.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                    size, samples = payload(text)
                    entry = zipfile.ZipInfo(f"{n:09d}_{'' if key is None else key}.wav", (1980, 1, 1, 0, 0, 0))
                    entry.compress_type = zipfile.ZIP_DEFLATED
                    entry.comment = str(size).encode()
                    archive.writestr(entry, to_wav(samples))
                    n += 1
                    if stream.tell() > ARCHIVE_BYTES:
                        finish()
                        archive = None
        if archive is not None:
            finish()
        return Written(done)

    def commit(self, messages) -> None:
        store, root = _open(self.folder)
        archives = sorted(a for m in messages if m is not None for a in m.archives)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(archives).encode())

    def abort(self, messages) -> None:
        """Without a manifest nothing that was written is read."""


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Range]:
        store, root = _open(self.folder)
        with store.open_input_file(f"{root}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        ranges = [
            Range(name, at, min(at + RANGE_BYTES, size)) for name, size in archives for at in range(0, max(size, 1), RANGE_BYTES)
        ]
        return ranges or [Range("", 0, 0)]  # Spark wants one partition at least

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = _open(self.folder)
        path = f"{root}/{partition.archive}"
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as directory:
            members = [m for m in directory.infolist() if partition.start <= m.header_offset < partition.end]
        keys, sizes, media, held = [], [], [], 0
        with Members(store, path) as source:
            for m in members:
                body = source.read(m)
                key = m.filename.removesuffix(".wav").partition("_")[2]
                keys.append(int(key) if key else None)
                sizes.append(int(m.comment))
                media.append(body)
                held += len(body)
                if held >= BATCH_BYTES:
                    yield _batch(keys, sizes, media)
                    keys, sizes, media, held = [], [], [], 0
        if keys:
            yield _batch(keys, sizes, media)


def _batch(keys, sizes, media) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"]
    )


class Members:
    """Reads members by offset; a failed or damaged read is repeated for that member on a fresh handle."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path, self.file = store, path, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.file is not None:
            self.file.close()

    def read(self, m: zipfile.ZipInfo) -> bytes:
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                if self.file is None:
                    self.file = self.store.open_input_file(self.path)
                return self._once(m)
            except (OSError, ValueError, zlib.error, struct.error):
                self.file = None
                if not left:
                    raise
        raise AssertionError

    def _once(self, m: zipfile.ZipInfo) -> bytes:
        head = self.file.read_at(30, m.header_offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{self.path}: no member at {m.header_offset}")
        name, extra = struct.unpack_from("<HH", head, 26)
        body = self.file.read_at(m.compress_size, m.header_offset + 30 + name + extra)
        if m.compress_type == zipfile.ZIP_DEFLATED:
            body = zlib.decompress(body, -15)
        if len(body) != m.file_size or zlib.crc32(body) != m.CRC:
            raise ValueError(f"{self.path}: damaged member at {m.header_offset}")
        return body


class WavArchive(DataSource):
    """``format("wav_archive")``, option ``path``: writes (key, text), reads (key, n_bytes, media)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def store_media(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as a member of archives in ``folder``, and give the table that reads them back."""
    spark = df.sparkSession
    spark.dataSource.register(WavArchive)
    rows = df.select(column(id_col).cast("long").alias("key"), column(text_col).cast("string").alias("text"))
    rows.write.format(FORMAT).mode("append").option("path", folder).save()
    return spark.read.format(FORMAT).option("path", folder).load()


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of the stored bytes of (key, n_bytes, media)."""
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column(2):
                m = item.as_py()
                x = from_wav(m)
                rows.append((
                    len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(x)
                ))
            if rows:
                size, sha, tail, n, whole, feat = zip(*rows)
                cols = [pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(n, pa.int64()), pa.array(whole), pa.array(feat)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    kinds = ["long", "long", "long", "string", "long", "long", "string", "string"]
    out = media.mapInArrow(work, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return out.withColumnRenamed("key", id_col)


@query("op5_media")
def media(t):
    folder = f"{stage_folder(t.spark)}/media-{uuid.uuid4().hex}"
    return media_features(store_media(t.documents, folder))
