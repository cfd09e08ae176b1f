"""Operator 5, media columns: a Spark data source over directories of archives.

write_archives() stores each payload as a media file, an 8-bit greyscale PNG 64 samples wide, and files the members
one after another in tar archives of about ARCHIVE_BYTES, a set for each task. Beside each archive stands a small
index of member offsets. A set counts only once its manifest is committed, so what a lost task left behind is never
read and its retry writes under names of its own.

The source `archives` plans byte ranges: the driver lists archives and their sizes, never members, and cuts them into
ranges of range_bytes. A range owns the members that begin in it; its task reads the archive's index, seeks to its
first member, and streams Arrow batches of about BATCH_BYTES of payload. A member that can't be read or whose
checksum differs is read again on its own, from a fresh handle at its offset, up to `retries` times, and then comes
out as a row with its error and without payload; other members are not touched.

features() decodes the media and returns the contract's columns.

Edge cases: null text is empty, which makes one row of 64 zero samples; null doc_id is kept; repeated rows are members
of their own; texts of any length have as many rows of samples as they need; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlark.llm.shared import fresh_path, table

WIDTH = 64
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
PNG = b"\x89PNG\r\n\x1a\n"

READ_SCHEMA = "doc_id long, n_bytes long, offset long, media binary, error string"
#: An index entry: doc_id (and whether there is one), unpadded size, offset and size of the media, its CRC-32.
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("n_bytes", "<i8"), ("offset", "<i8"), ("size", "<i8"), ("crc", "<i8")])


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def encode(payload: bytes) -> bytes:
    """The payload as the samples of a greyscale PNG without row filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [PNG]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    for kind, body in ((b"IHDR", header), (b"IDAT", zlib.compress(rows.tobytes(), 3)), (b"IEND", b"")):
        parts += [struct.pack(">I", len(body)), kind, body, struct.pack(">I", zlib.crc32(kind + body))]
    return b"".join(parts)


def decode(media: bytes) -> bytes:
    """The samples of what encode() made; ValueError if a chunk is damaged."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("other samples than 64 x 8 bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Stores docs(doc_id, text) as media in archives under folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        out, index, at, names = None, [], 0, []
        run = uuid.uuid4().hex

        def close() -> None:
            out.write(b"\0" * 1024)
            out.close()
            with store.open_output_stream(f"{names[-1]}.idx") as idx:
                idx.write(np.array(index, ENTRY).tobytes())

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    names.append(f"{root}/{run}-{len(names)}.tar")
                    out, index, at = store.open_output_stream(names[-1]), [], 0
                raw = (text or "").encode("utf-8", "replace")
                media = encode(padded(raw))
                info = tarfile.TarInfo(f"{len(index)}.png")
                info.size = len(media)
                head = info.tobuf(tarfile.GNU_FORMAT)
                out.write(head)
                out.write(media.ljust(-(-len(media) // 512) * 512, b"\0"))
                index.append((doc or 0, doc is not None, len(raw), at + len(head), len(media), zlib.crc32(media)))
                at += len(head) + -(-len(media) // 512) * 512
                if at >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        sizes = [store.get_file_info(n).size for n in names]
        yield pa.RecordBatch.from_pydict({"archive": names, "size": sizes}, pa.schema([("archive", "string"), ("size", "int64")]))

    manifest = docs.select("doc_id", "text").mapInArrow(write, "archive string, size long")
    manifest.write.parquet(f"{folder}/manifest")


class Range(InputPartition):
    def __init__(self, archive: str, begin: int, end: int) -> None:
        self.archive, self.begin, self.end = archive, begin, end


def read_member(store: fs.FileSystem, name: str, entry: np.void, retries: int) -> tuple[bytes | None, str | None]:
    """The media of one member, from a fresh handle at its offset each time, or what went wrong."""
    problem = None
    for _ in range(retries + 1):
        try:
            with store.open_input_file(name) as source:
                source.seek(int(entry["offset"]))
                media = source.read(int(entry["size"]))
            if zlib.crc32(media) == entry["crc"]:
                return media, None
            problem = "checksum differs"
        except OSError as e:
            problem = str(e)[:200]
    return None, problem


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 2))

    def partitions(self) -> list[Range]:
        import pyarrow.parquet as pq

        store, root = filesystem(self.folder)
        ranges = []
        for found in store.get_file_info(fs.FileSelector(f"{root}/manifest")):
            if found.path.endswith(".parquet"):
                with store.open_input_file(found.path) as f:
                    listed = pq.read_table(f)
                for archive, size in zip(*(listed[c].to_pylist() for c in ("archive", "size")), strict=True):
                    ranges += [
                        Range(archive, at, min(size, at + self.range_bytes)) for at in range(0, size, self.range_bytes)
                    ]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", "int64"), ("n_bytes", "int64"), ("offset", "int64"), ("media", "binary"), ("error", "string")]
        )
        if not partition.archive:
            return
        store, _ = filesystem(self.folder)
        with store.open_input_file(f"{partition.archive}.idx") as f:
            index = np.frombuffer(f.read(), ENTRY)
        own = index[(index["offset"] >= partition.begin) & (index["offset"] < partition.end)]
        rows: list[tuple] = []
        waiting = 0
        source = None
        for entry in own:
            try:
                if source is None:
                    source = store.open_input_file(partition.archive)
                source.seek(int(entry["offset"]))
                media, problem = source.read(int(entry["size"])), None
                if zlib.crc32(media) != entry["crc"]:
                    raise OSError("checksum differs")
            except OSError:
                source = None
                media, problem = read_member(store, partition.archive, entry, self.retries)
            doc = int(entry["doc_id"]) if entry["has_id"] else None
            rows.append((doc, int(entry["n_bytes"]), int(entry["offset"]), media, problem))
            waiting += int(entry["size"])
            if waiting >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)
                rows, waiting = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)


class Archives(DataSource):
    """spark.read.format("archives").load(folder); options range_bytes, batch_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and an 8 x 8 average hash of the picture, whose rows are pooled into eight bands."""
    rows = samples.reshape(-1, WIDTH).astype(np.float64)
    total = rows.sum(axis=0).reshape(8, 8).sum(axis=1)
    bands = [b.reshape(-1, 8, 8).sum(axis=(0, 2)) if len(b) else total * 0 for b in np.array_split(rows, 8)]
    pool = np.array(bands)
    bits = np.packbits((pool > pool.mean()).ravel())
    return f"{samples.mean():.4f}:{samples.std():.4f}:{bits.tobytes().hex()}"


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, error string"
)


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, decoded again; members that could not be read have only their error."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in FEATURES.split(",")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(x.strip().split()[0], kinds[x.strip().split()[1]]) for x in FEATURES.split(",")])
        for batch in batches:
            rows = []
            for doc, n, data, error in zip(*(batch[c] for c in ("doc_id", "n_bytes", "media", "error")), strict=True):
                row = dict.fromkeys(names) | {"doc_id": doc.as_py(), "n_bytes": n.as_py(), "error": error.as_py()}
                if row["error"] is None:
                    stored = data.as_py()
                    payload = decode(stored)
                    row |= {
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-WIDTH:]),
                        "media_bytes": len(stored),
                        "media_sha256": hashlib.sha256(stored).hexdigest(),
                        "feature": feature_of(np.frombuffer(payload, np.uint8)),
                    }
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return media.select("doc_id", "n_bytes", "media", "error").mapInArrow(of, FEATURES)


def stored(docs: DataFrame, folder: str | None = None, **options: int) -> DataFrame:
    """docs(doc_id, text) written as archives into the shared folder and read back."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "archives")
    write_archives(docs, folder)
    spark.dataSource.register(Archives)
    return spark.read.format("archives").options(**options).load(folder)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """error is null for every member that was read; one that could not be has nothing else but doc_id and n_bytes."""
    return features(stored(table(spark, sf_dir, "documents")))
