"""FASTA of any length as ordered pieces: a data source that splits by byte ranges, and one that writes.

``read_parts`` cuts every file into ranges of bytes, whatever the lengths of its lines and records, so
a chromosome of many gigabytes, even on a single line, is read by many tasks and never is one cell.
A range knows its own headers; what record its first bytes belong to, whether they still are part of a
header, and at which base they start is carried along the ranges, one small row each.

``write_parts`` wraps pieces into lines.  Where a line breaks follows from the place of a piece in its
record, so records and lines may straddle tasks.  The part files of an assembly, read by name one
after the other, are byte for byte the file that a single writer would give.
"""

from __future__ import annotations

import os
import re
import urllib.parse
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandmill.functions.bases import FASTA_WIDTH
from strandmill.functions.names import assembly_of
from strandmill.operators.spread import spread_join

RANGE = 16 << 20  # bytes of a file that one task reads at a time
PIECE = 4 << 20  # bases of a row at most
TASK = 16 << 20  # bytes of all ranges that one task reads, if they are smaller than that
_LOOK = 4_096
_NAME = re.compile(rb"^>([^ \t\r]*)")
_BLANKS = re.compile(rb"[ \r]+(?=\n)")
_WORK = "_work"


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class _Range:
    stream: str
    file: str
    base: int  # bytes of the stream before this file
    low: int
    high: int
    before: str | None  # the file that this one goes on from


@dataclass
class _Ranges(InputPartition):
    ranges: list[_Range]


def _until_line_end(source) -> bytes:
    """What is left of the line at the source's place, its line break excluded."""
    found = b""
    while b"\n" not in found and (more := source.read(_LOOK)):
        found += more
    return found.partition(b"\n")[0]


def _ends_in_blanks_only(source) -> bool:
    """Whether only blanks come before the next line break or the end."""
    while more := source.read(_LOOK):
        rest = more.lstrip(b" \r")
        if rest:
            return rest.startswith(b"\n")
    return True


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.piece = options["path"], int(options.get("range", RANGE)), int(options.get("piece", PIECE))
        self.tasks = max(1, int(options.get("tasks", 1)))
        self.joined, self.brief = options.get("joined", "false") == "true", options.get("brief", "false") == "true"

    def partitions(self):
        system, root = _system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        shown = [f for f in found if f.is_file and f.size and not any(p[:1] in "_." for p in f.path[len(root):].split("/") if p)]
        out, now, base, before = [], None, 0, None
        for f in sorted(shown, key=lambda f: (f.path.rpartition("/")[0], f.base_name)):
            stream = f.path.rpartition("/")[0] if self.joined else f.path
            if stream != now:
                now, base, before = stream, 0, None
            for low in range(0, f.size, self.size):
                out.append(_Range(stream, f.path, base, low, min(low + self.size, f.size), before))
            base, before = base + f.size, f.path
        # Small ranges share a task: starting one costs more than reading a range.
        whole = sum(r.high - r.low for r in out)
        fill = max(self.size, min(TASK, whole // self.tasks))
        tasks, room = [_Ranges([])], 0
        for r in out:
            if room and room + r.high - r.low > fill:
                tasks.append(_Ranges([]))
                room = 0
            tasks[-1].ranges.append(r)
            room += r.high - r.low
        return tasks

    def _load(self, part: _Range) -> tuple[bool, bytes, bool]:
        """(starts a line, bytes with the rest of a header at their end, ends inside a header)."""
        system, _ = _system(self.path)
        first = b"\n"
        if not part.low and part.before:
            with system.open_input_file(part.before) as source:
                source.seek(source.size() - 1)
                first = source.read(1)
        with system.open_input_file(part.file) as source:
            if part.low:
                source.seek(part.low - 1)
                first = source.read(1)
            body = source.read(part.high - part.low)
            at_line = first == b"\n"
            line = body.rfind(b"\n") + 1
            header = body[line : line + 1] == b">" and (line > 0 or at_line)
            if header:
                body += _until_line_end(source)
            elif body[-1:] in (b" ", b"\r") and _ends_in_blanks_only(source):
                body = body.rstrip(b" \r")
        return at_line, body, header

    def read(self, partition: _Ranges):
        for one in partition.ranges:
            yield from self._rows(one)

    def _rows(self, partition: _Range):
        at_line, body, header = self._load(partition)
        seen = np.frombuffer(body, np.uint8)
        marks = np.flatnonzero(seen == ord(">"))
        marks = marks[(seen[marks - 1] == ord("\n")) | (marks == 0)]
        if not at_line:
            marks = marks[marks > 0]
        lead = body[: marks[0]] if len(marks) else body
        # The rest of the line that the range before began may be sequence or header.
        open_, cut, lead = (b"", b"", lead) if at_line else lead.partition(b"\n")
        place = partition.base + partition.low
        ends = header if at_line or b"\n" in body or len(marks) else None
        parts = [(None, None, True, open_ + cut), (None, None, False, lead)]
        bounds = [*marks.tolist(), len(body)]
        for one, stop in zip(bounds[:-1], bounds[1:], strict=True):
            head, _, data = body[one:stop].partition(b"\n")
            parts.append((place + one, _NAME.match(head)[1].decode("utf-8", "replace"), False, data))
        for n, (record, chrom, rest, data) in enumerate(parts):
            data = _BLANKS.sub(b"", data).replace(b"\n", b"").upper()
            if n == 1 and not data:
                continue
            for at in range(0, max(1, len(data)), self.piece):
                piece = b"" if self.brief else data[at : at + self.piece]
                if at and self.brief:
                    break
                yield (partition.stream, place, n, record, chrom, rest, ends, len(data), at, piece)


class FastaParts(DataSource):
    """Ranges of FASTA files; ``read_parts`` gives its rows their records."""

    @classmethod
    def name(cls):
        return "strandmill_fasta"

    def schema(self):
        return ("stream string, place long, n int, record long, chrom string, rest boolean, ends boolean, size long, at long, data binary")

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_parts(spark: SparkSession, path: str, joined: bool = False, size: int = RANGE, piece: int = PIECE) -> DataFrame:
    """(assembly, chrom_idx, chrom, at, data): pieces of every record in ``path``, a file or a folder.

    ``chrom_idx`` is the place of the header in its file and ``at`` the first base of the piece in its
    record; a record without bases has one empty piece.  Names, blanks at line ends, upper case and what
    comes before the first header are as in ``read_fasta``; bytes that are not ASCII stay as they are.  With
    ``joined`` the files of a folder, by name, are one stream, as ``write_parts`` leaves them, and the
    folder names the assembly; a file may then end anywhere but inside a header.

    The files are read twice: first for a few numbers per range, then for the bases.
    """
    spark.dataSource.register(FastaParts)

    def scan(brief: bool) -> DataFrame:
        options = {"joined": str(joined).lower(), "brief": str(brief).lower(), "range": size, "piece": piece,
                   "tasks": spark.sparkContext.defaultParallelism}
        return spark.read.format(FastaParts.name()).options(**options).load(path)

    # One row per range and record, so a window over them is small even for the largest file.
    brief = scan(True)
    along = Window.partitionBy("stream").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    spans = brief.withColumn("in_header", F.last("ends", True).over(along)).where(~F.col("rest") | ~F.coalesce("in_header", F.lit(False)))
    upto = Window.partitionBy("stream").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumns({"own": F.last("record", True).over(upto), "name": F.last("chrom", True).over(upto)}).where("own IS NOT NULL")
    earlier = Window.partitionBy("stream", "own").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("stream", "place", "n", F.col("own").alias("chrom_idx"), "name", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
                          F.sum("size").over(Window.partitionBy("stream", "own")).alias("total"))
    assembly = F.url_decode(F.regexp_extract("stream", "([^/=]*)$", 1)) if joined else assembly_of(F.col("stream"))
    found = scan(False).drop("chrom", "record").join(starts, ["stream", "place", "n"])
    return found.where("size > 0 OR (n > 1 AND total = 0)").select(
        assembly.alias("assembly"), "chrom_idx", F.col("name").alias("chrom"), (F.col("start") + F.col("at")).alias("at"), "data")


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options["width"])

    def _work(self) -> str:
        return f"{_system(self.path)[1]}/{_WORK}"

    def write(self, iterator):
        system, root = _system(self.path)
        task = TaskContext.get()
        now, out, files = None, None, []
        for row in iterator:
            if row.assembly != now:
                if out:
                    out.close()
                now = row.assembly
                folder = f"assembly={urllib.parse.quote(now, safe='')}"
                system.create_dir(f"{self._work()}/{folder}", recursive=True)
                # Every attempt has its own file; only those of the attempts that count are published.
                name = f"part-{task.partitionId():06d}"
                files.append((f"{self._work()}/{folder}/{name}-{task.taskAttemptId()}", f"{root}/{folder}", f"{name}.fa"))
                out = system.open_output_stream(files[-1][0])
            data = bytes(row.data)
            if row.at == 0:
                out.write(f">{row.chrom}\n".encode())
            first = (self.width - row.at % self.width) % self.width
            if row.at % self.width == 0 and row.at:
                out.write(b"\n")
            out.write(_wrapped(data, first, self.width))
            if row.last and (data or row.at):
                out.write(b"\n")
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages):
        system, root = _system(self.path)
        for message in messages:
            for own, folder, name in message.files if message else ():
                system.create_dir(folder, recursive=True)
                system.move(own, f"{folder}/{name}")
        self.abort(messages)
        system.create_dir(root, recursive=True)
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages):
        system, _ = _system(self.path)
        if system.get_file_info(self._work()).type != pafs.FileType.NotFound:
            system.delete_dir(self._work())


def _wrapped(data: bytes, first: int, width: int) -> bytes:
    """``data`` with a line break before byte ``first`` and every ``width`` bytes after it, none at the start."""
    first = first or width
    if len(data) <= first:
        return data
    rest = np.frombuffer(data, np.uint8)[first:]
    whole = len(rest) // width * width
    lines = np.full((whole // width, width + 1), ord("\n"), np.uint8)
    lines[:, 1:] = rest[:whole].reshape(-1, width)
    tail = rest[whole:].tobytes()
    return data[:first] + lines.tobytes() + (b"\n" + tail if tail else b"")


def write_parts(parts: DataFrame, path: str, width: int = FASTA_WIDTH) -> None:
    """Write (assembly, chrom_idx, chrom, at, data) as FASTA, one folder per assembly.

    Pieces are without gaps, one at 0 for every record, empty if the record is.  Pieces are range-partitioned in genome order, a record
    over as many tasks as it takes.  Files appear when all are whole; those of lost or repeated attempts never do.
    A folder that holds something already is an error.
    """
    spark = parts.sparkSession
    system, root = _system(path)
    if system.get_file_info(root).type != pafs.FileType.NotFound and system.get_file_info(pafs.FileSelector(root)):
        raise FileExistsError(path)
    spark.dataSource.register(FastaParts)
    key = ["assembly", "chrom_idx"]
    ends = parts.groupBy(*key).agg(F.max("at").alias("end"), F.count(F.lit(1)).alias("copies"))
    rows = spread_join(parts, ends, key, "copies", ["at"])
    (
        rows.select(F.col("assembly").cast("string").alias("assembly"), "chrom_idx", F.col("chrom").cast("string").alias("chrom"), "at",
                    (F.col("at") == F.col("end")).alias("last"), F.col("data").cast("binary").alias("data"))
        .repartitionByRange("assembly", "chrom_idx", "at")
        .sortWithinPartitions("assembly", "chrom_idx", "at")
        .write.format(FastaParts.name()).option("width", width).mode("append").save(path)
    )
