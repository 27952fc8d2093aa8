"""Media columns: samples kept in archives, written and read by a data source of byte ranges."""

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from hourgrid.llm.common import shared_folder, table

#: Samples in a row of a picture, and the unit of the payload's length.
ROW = 64
#: Bytes of an archive after which a writer begins the next, of a planned range, and of a streamed batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 4 << 20
#: Times one member is read again, at its offset, before its read fails.
RETRIES = 3

#: Begins the names of the lists of archives.
LIST = "_archives-"
# Fixed values of the archive format: the mark of a member's own header, and its bytes before name and extra field.
HEADER_MARK, HEADER_BYTES = b"PK\x03\x04", 30
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of ROW."""
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b"\0")


def to_picture(data: bytes) -> bytes:
    """An 8-bit grey PNG, ROW samples wide, whose samples are the padded data; a text chunk keeps the length."""
    samples = padded(data)
    height = len(samples) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, ROW)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0))
    size = _chunk(b"tEXt", b"n_bytes\0" + str(len(data)).encode())
    return _PNG + head + size + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_picture(stored: bytes) -> tuple[bytes, int]:
    """The samples, and the number of bytes before padding."""
    if stored[:8] != _PNG:
        raise ValueError("not a PNG")
    at, size, height, parts = 8, 0, 0, []
    while at < len(stored):
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", data, 4)[0]
        elif kind == b"tEXt":
            size = int(data.split(b"\0")[1])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, ROW + 1)
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), size


def feature_of(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a bit for each column that is brighter than the mean."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    share = np.bincount(grid.ravel(), minlength=256) / grid.size
    level = share @ np.arange(256)
    deviation = np.sqrt(share @ (np.arange(256) - level) ** 2)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    bits = np.packbits(grid.mean(axis=0) > level).tobytes().hex()
    return f"{level:.3f}|{deviation:.3f}|{abs(entropy):.3f}|{bits}"


class _Committed(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(start)
        self.path, self.start, self.stop = path, start, stop


class ArchiveSource(DataSource):
    """format("archives"): a folder of ZIP archives with a row (name, payload) for each member.

    The folder may be in any store that pyarrow.fs opens (file, hdfs, s3, gcs) and that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "name string, payload binary"

    def reader(self, schema) -> "ArchiveReader":
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> "ArchiveWriter":
        return ArchiveWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)), overwrite)


class ArchiveWriter(DataSourceArrowWriter):
    """Every task attempt writes archives under names of its own; only those of committed tasks get into a list of
    the job, so an attempt that is lost or repeated leaves nothing that a reader sees. Each job has a list of its own:
    a folder that is written again holds the archives of all jobs, or with overwrite those of the last one."""

    def __init__(self, path: str, archive_bytes: int, overwrite: bool = False):
        self.path, self.archive_bytes, self.overwrite = path, archive_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        files: list[str] = []
        memory = io.BytesIO()
        archive = zipfile.ZipFile(memory, "w", zipfile.ZIP_STORED)

        def finish() -> None:
            archive.close()
            if archive.infolist():
                files.append(f"{uuid.uuid4().hex}.zip")
                with store.open_output_stream(f"{folder}/{files[-1]}") as out:
                    out.write(memory.getbuffer())

        for batch in iterator:
            for name, payload in zip(batch.column("name").to_pylist(), batch.column("payload")):
                archive.writestr(zipfile.ZipInfo(name), payload.as_py())
                if memory.tell() >= self.archive_bytes:
                    finish()
                    memory = io.BytesIO()
                    archive = zipfile.ZipFile(memory, "w", zipfile.ZIP_STORED)
        finish()
        return _Committed(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        earlier = _lists(store, folder) if self.overwrite else []
        with store.open_output_stream(f"{folder}/{LIST}{uuid.uuid4().hex}") as out:
            out.write("\n".join(f for m in messages if m for f in m.files).encode())
        for old in earlier:
            store.delete_file(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{folder}/{f}")


def _lists(store: fs.FileSystem, folder: str) -> list[str]:
    """The lists of the jobs that wrote to the folder; a folder that is not there is an error."""
    return [i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith(LIST)]


class ArchiveReader(DataSourceReader):
    """Plans ranges of bytes over the archives; a range reads the members whose headers begin in it."""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.path)
        names: set[str] = set()
        for path in _lists(store, folder):
            with store.open_input_stream(path) as listed:
                names |= set(listed.read().decode().split())
        out: list[InputPartition] = []
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.base_name in names:
                out += [_Range(info.path, a, min(a + self.range_bytes, info.size)) for a in range(0, info.size, self.range_bytes)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as source, zipfile.ZipFile(source) as archive:
            names, payloads, held = [], [], 0
            for member in archive.infolist():  # the directory at the archive's end
                if partition.start <= member.header_offset < partition.stop:
                    names.append(member.filename)
                    payloads.append(self._member(store, partition.path, archive, member))
                    held += len(payloads[-1])
                    if held >= BATCH_BYTES:
                        yield self._batch(names, payloads)
                        names, payloads, held = [], [], 0
            if names:
                yield self._batch(names, payloads)

    @staticmethod
    def _batch(names: list[str], payloads: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(payloads, pa.binary())], ["name", "payload"])

    @staticmethod
    def _member(store: fs.FileSystem, path: str, archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> bytes:
        """One member's bytes, checked; a failed read is repeated for this member alone, at its offset in the archive
        opened anew: what stands there is the member, whatever other members have its name."""
        for attempt in range(RETRIES + 1):
            try:
                if not attempt:
                    return archive.read(member)
                with store.open_input_file(path) as again:
                    return _at(again, member)
            except (OSError, zipfile.BadZipFile, zlib.error) as error:
                last = error
        raise OSError(f"{path}, member at {member.header_offset}: {last}")


def _at(source: pa.NativeFile, member: zipfile.ZipInfo) -> bytes:
    """The member whose local header is at header_offset, by the sizes and the checksum of the directory."""
    source.seek(member.header_offset)
    header = source.read(HEADER_BYTES)
    if len(header) < HEADER_BYTES or header[:4] != HEADER_MARK:
        raise zipfile.BadZipFile(f"no member at {member.header_offset}")
    name, extra = struct.unpack_from("<HH", header, HEADER_BYTES - 4)
    source.seek(member.header_offset + HEADER_BYTES + name + extra)
    held = source.read(member.compress_size)
    payload = zlib.decompress(held, -15) if member.compress_type == zipfile.ZIP_DEFLATED else held
    if len(payload) != member.file_size or zlib.crc32(payload) != member.CRC:
        raise zipfile.BadZipFile(f"the member at {member.header_offset} is damaged")
    return payload


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, texts = batch.column("name"), batch.column("text")
        for i in range(0, len(names), 256):
            pictures = [to_picture(t.as_py().encode()) for t in texts[i : i + 256]]
            yield pa.RecordBatch.from_arrays([names[i : i + 256], pa.array(pictures, pa.binary())], ["name", "payload"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, payload in zip(batch.column("name").to_pylist(), batch.column("payload")):
            stored = payload.as_py()
            samples, n = from_picture(stored)
            rows.append(
                {
                    "doc_id": int(name) if name else None,
                    "n_bytes": n,
                    "payload_bytes": len(samples),
                    "payload_sha256": hashlib.sha256(samples).hexdigest(),
                    "tail_crc32": zlib.crc32(samples[-ROW:]),
                    "media_bytes": len(stored),
                    "media_sha256": hashlib.sha256(stored).hexdigest(),
                    "feature": feature_of(samples),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, _FEATURE_FIELDS)


_FEATURE_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
     ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
_FEATURE_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def write_archives(docs: DataFrame, path: str) -> None:
    """Every row's text as a picture in archives below path; the member's name is doc_id ('' if null).

    A null text is stored as an empty one. Repeated rows are repeated members; other columns are not kept."""
    docs.sparkSession.dataSource.register(ArchiveSource)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(_stored, "name string, payload binary").write.format("archives").mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, payload) of every member below path; no row for an empty folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").load(path)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored pictures (name, payload), by the samples read back."""
    return media.mapInArrow(_features, _FEATURE_SCHEMA)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, read back; null texts are empty, equal texts give equal values."""
    path = shared_folder(spark)
    write_archives(table(spark, sf_dir, "documents"), path)
    return media_features(read_archives(spark, path))
