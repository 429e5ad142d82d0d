"""Files that rows name themselves: a data source that writes each row's content to a path of its own, and what
reads such trees back. Spark's own writers choose the names of files; media and report trees are told by theirs."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import deque
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "named_files"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class NamedFilesWriter(DataSourceArrowWriter):
    """Every file is written under a temporary name and moved to its own, so a task that fails or runs twice
    leaves no half of a file. Of rows with one path some one's content stays."""

    def __init__(self, base: str):
        self.base = base

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = fs.FileSystem.from_uri(self.base)
        made, files, size = set(), 0, 0
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                steps = (path or "").split("/")
                if steps[0] == "." and len(steps) > 1:
                    steps = steps[1:]
                if not steps[-1] or any(x in ("", ".", "..") for x in steps):
                    raise ValueError(f"not a path below the folder: {path!r}")
                target, content = "/".join([base, *steps]), content or b""
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                attempt = f"{folder}/._{uuid.uuid4().hex}"  # a hidden name: no reader sees it
                with system.open_output_stream(attempt) as out:
                    out.write(content)
                system.move(attempt, target)
                files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class NamedFiles(DataSource):
    """Format ``named_files``; columns path (below the folder that is saved to) and content."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("named files are only added to a folder")
        return NamedFilesWriter(self.options["path"])


def write_files(df: DataFrame, folder: str) -> None:
    """A file for each row of df (path, content) below folder. A null content is an empty file; a path that is null,
    empty, absolute or leads out of the folder is an error. An empty table writes nothing."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").save(folder)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Path (below folder), md5 and size of every file. The digest is taken where the file is read; its
    content goes no further than the scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.split("path", f"\\Q/{folder.rstrip('/').rsplit('/', 1)[-1]}/\\E", 2)[1].alias("path"), F.md5("content").alias("md5"), F.col("length").alias("size"))


#: What Java's paths write as escapes.
ESCAPED = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\u00a1-\U0010ffff]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: So many folders are enough to deal out; a folder of more folders than the second number is dealt out as a whole.
FOLDERS, WIDE = 1000, 10_000


def entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder that Spark would not leave out as hidden, and whether each is a folder."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:  # one by one, however many
            yield from ((e.name, e.is_dir()) for e in found if not _hidden(e.name))
    else:
        yield from ((i.base_name, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(folder)) if not _hidden(i.base_name))


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _opened(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str, str] | None:
    """The file system of path, its folder there and the same as Spark names it; None where only Spark can list it."""
    if re.search(r"[*?\[{\\]", path):
        return None
    local = re.fullmatch(r"(file:(?://)?)?(/[^/].*|/)", path)
    if local and (local[1] or spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:")):
        system, base = fs.LocalFileSystem(), re.sub("/+", "/", local[2]).rstrip("/")
        root = f"file:{ESCAPED.sub(lambda m: quote(m[0]), base)}"
    elif re.fullmatch(r"[a-z][a-z0-9+.-]*://[\w.:/@=-]+", path) and not path.startswith("file:"):
        try:
            system, base = fs.FileSystem.from_uri(path.rstrip("/"))
        except (pa.ArrowInvalid, OSError, ImportError, NotImplementedError):
            return None
        root = path.rstrip("/")
    else:
        return None
    return (system, base, root) if system.get_file_info(base or "/").type == fs.FileType.Directory else None


def read_texts(spark: SparkSession, folder: str, suffix: str, pattern: str) -> DataFrame | None:
    """path (as Spark names files) and content (text; null where it can't be decoded) of the files below folder that
    end in suffix and whose path holds pattern. None where only Spark can list the folder.

    The driver of a Spark file source holds a record of every file, and a task opens files by way of such records. Here
    the driver finds some thousand folders, tasks walk what is below them, and files are dealt anew to be read."""
    opened = _opened(spark, folder)
    if opened is None:
        return None
    system, base, root = opened
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    waiting, dealt = deque([""]), []
    while waiting and len(waiting) + len(dealt) < FOLDERS:
        at = waiting.popleft()
        below = list(islice((f"{at}/{name}" for name, is_folder in entries(system, base + at or "/") if is_folder), WIDE + 1))
        waiting.extend(below if len(below) <= WIDE else [])
        dealt.append((at, len(below) > WIDE))
    folders = spark.createDataFrame([*dealt, *((at, True) for at in waiting)], "at string, whole boolean").repartition(tasks, "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[str]:
            for batch in batches:
                for at, whole in zip(batch.column("at").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                    left = [at]
                    while left:
                        at = left.pop()
                        for name, is_folder in entries(system, base + at or "/"):
                            if is_folder and whole:
                                left.append(f"{at}/{name}")
                            elif not is_folder and name.endswith(suffix):
                                yield f"{at}/{name}"

        found = files()
        while some := list(islice(found, 10_000)):
            yield pa.record_batch({"at": some, "path": [root + ESCAPED.sub(lambda m: quote(m[0]), x) for x in some]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, texts, size = [], [], 0
        for batch in batches:
            for at, path in zip(batch.column("at").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with system.open_input_stream(base + at, compression=None) as f:
                    content = f.read()
                try:
                    text = content.decode(json.detect_encoding(content))
                except UnicodeDecodeError:
                    text = None
                paths.append(path)
                texts.append(text)
                size += len(content)
                if size > 8 << 20 or len(paths) >= 10_000:
                    yield pa.record_batch({"path": pa.array(paths, pa.string()), "content": pa.array(texts, pa.string())})
                    paths, texts, size = [], [], 0
        yield pa.record_batch({"path": pa.array(paths, pa.string()), "content": pa.array(texts, pa.string())})

    found = folders.mapInArrow(walk, "at string, path string").where(F.col("path").rlike(pattern))
    return found.repartition(tasks, "path").mapInArrow(read, "path string, content string")


def report_paths(reports: DataFrame, layout: str = "real") -> DataFrame:
    """Path and content (JSON) of report files in one of the layouts that ``read_reports`` tells apart.

    real: dir, task_id, base_timeline, is_candidate, name; synthesis: dir, task_id, segment, operation, name; and
    functional_score, visual_score, homepage_score, no_action in both."""
    if layout == "real":
        place = F.concat(F.col("base_timeline"), F.when(F.col("is_candidate"), "_candidate").otherwise(""))
    else:
        place = F.concat(F.lit("segment_"), F.col("segment").cast("string"), F.lit("/operation_"), F.col("operation").cast("string"))
    body = F.struct(F.struct("no_action").alias("summary"), F.struct("visual_score", "functional_score").alias("global_verification"), F.struct(F.col("homepage_score").alias("visual_score")).alias("homepage_similarity"))
    return reports.select(F.concat(F.col("dir"), F.lit("/task_"), F.col("task_id").cast("string"), F.lit("/"), place, F.lit("/"), F.col("name"), F.lit(".json")).alias("path"), F.to_json(body).alias("content"))
