"""Files written and read by tasks: any file system that the path's scheme names, one file or member at a time."""
from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_system(path: str):
    """The file system of a path or address, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _replaced(files, path: str, body: bytes) -> None:
    """The file is written aside and then moved, so a repeated task leaves one whole file."""
    import uuid

    aside = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(aside) as out:
        out.write(body)
    files.move(aside, path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write `content` of every row to `path` below the folder; paths are unique. The number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{root}/{path.lstrip('/')}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                _replaced(files, target, content or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    written = rows.select("path", "content").mapInArrow(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def png(height: int, width: int, channels: int, pixels: bytes) -> bytes:
    """A lossless picture of 8-bit pixels; three channels are in B, G, R order, as image rows have them."""
    px = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    if channels == 3:
        px = px[:, :, ::-1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), px.reshape(height, -1)], axis=1)  # a filter byte of 0 for each line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = {1: 0, 3: 2, 4: 6}[channels]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(images: DataFrame, folder: str) -> int:
    """Write every image row to its `path` as PNG. A row with fewer bytes than its size says is written as it is: a broken file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for height, width, channels, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                whole = data is not None and len(data) == height * width * channels
                bodies.append(png(height, width, channels, data) if whole else data or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["path", "content"])

    rows = images.select("path", "height", "width", "nChannels", "data")
    return write_files(rows.mapInArrow(run, "path string, content binary"), folder)


# --- archives -----------------------------------------------------------------------------


def write_archives(rows: DataFrame, folder: str) -> int:
    """One zip file `<archive>.zip` for each value of `archive`, of its rows' `content` under their `member` names.

    An archive is written by one task, member by member as its rows come in order; nothing but the member at hand is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        name, aside, out, archive = None, "", None, None

        def close() -> None:
            if archive is not None:
                archive.close()
                out.close()
                files.move(aside, f"{root}/{name}.zip")

        for batch in batches:
            done = []
            for own, member, content in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    close()
                    done.append(own)
                    name, aside = own, f"{root}/{own}.{uuid.uuid4().hex}.part"
                    out = files.open_output_stream(aside)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED)
            yield pa.RecordBatch.from_pydict({"archive": pa.array(done, pa.string())})
        close()

    ordered = rows.select(F.col("archive").cast("string").alias("archive"), "member", F.col("content").cast("binary").alias("content"))
    return ordered.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(run, "archive string").count()


class Ranges(InputPartition):
    """Members of archives whose places lie in ranges of their bytes: (archive, start, stop)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


TASKS = 200
TASK_BYTES = 16 << 20


def packed(zips: list[tuple[str, int]], range_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of `range_bytes` of the archives (path, size), those of a task together; what is next to each other is one range.

    A task has one range while there are no more than `TASKS`. With more it has a share of all bytes, `TASK_BYTES` at most, so that
    small ranges don't cost a task each.
    """
    most = max(range_bytes, min(TASK_BYTES, sum(size for _, size in zips) // TASKS))
    tasks, held = [[]], 0
    for path, size in zips:
        for start in range(0, max(1, size), range_bytes):
            own = min(range_bytes, max(1, size - start))
            if tasks[-1] and held + own > most:
                tasks.append([])
                held = 0
            held += own
            last = tasks[-1][-1] if tasks[-1] else None
            if last and last[0] == path:
                tasks[-1][-1] = (path, last[1], start + range_bytes)
            else:
                tasks[-1].append((path, start, start + range_bytes))
    return [t for t in tasks if t]


class ZipMembers(DataSource):
    """`spark.read.format("zip_members").load(folder)`: the members of all zip archives below a folder, or of one.

    An archive is split by byte ranges, so a large one is many tasks: each reads the archive's directory, which is at its end, and then
    only the members that start in its own range. Small ranges are packed to tasks, and a task opens an archive once for what it has
    of it. The driver lists files and sizes, and opens none. Options: `range_bytes`
    (16 MB), `suffixes` (comma-separated; other members are not read), `content` (false: names and sizes only).
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, length long, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.suffixes = tuple("." + s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.content = options.get("content", "true").lower() != "false"

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        files, root = file_system(self.path)
        if root.lower().endswith(".zip"):
            found = [files.get_file_info(root)]
        else:
            found = files.get_file_info(fs.FileSelector(root, recursive=True))
        zips = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
        return [Ranges(own) for own in packed(zips, self.range_bytes)]

    def read(self, part: Ranges) -> Iterator[tuple]:
        files, _ = file_system(self.path)
        for path, start, stop in part.ranges:
            with files.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
                for info in archive.infolist():
                    if info.is_dir() or not start <= info.header_offset < stop:
                        continue
                    if self.suffixes and not info.filename.lower().endswith(self.suffixes):
                        continue
                    yield path, info.filename, info.file_size, archive.read(info) if self.content else None


def archive_members(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """archive, member, length and content of the members of all archives below a folder."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(**options).load(folder)
