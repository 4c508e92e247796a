"""Trees of named files (K3, K8): one file for each row, under a name the row
gives, written through a commit protocol.

1. Every task attempt writes into folders of its own below a hidden staging
   folder of the tree (readers skip names that start with ``_``), ``FILES``
   files into each.
2. When all tasks are done, the driver commits: one small manifest lists the
   attempts' folders that count. Attempts lost with an executor are not listed.
   Unless equal names have met in one task, a job then compares all names; two
   files of one name drop the write.
3. A second job moves the listed files to their places, one task for each
   folder. A move that is done already is skipped, so any part of this step
   may run again: ``recover_tree`` finishes a tree whose job died after the
   commit and drops staging folders that were never committed.

A keyed write (``replace=False``) replaces the files it names and leaves all
others; ``replace=True`` clears the old tree first, after the commit.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs as afs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "codecorpus_tree"
STAGING = "_tree-"
#: Files of one staging folder: what a task lists at once.
FILES = 4096
#: Bytes of text that a reading task gathers for a batch.
BYTES = 4 << 20
#: Levels of folders that are dealt out to be listed.
LEVELS = 2
#: Endings of packed files: those that Arrow unpacks, and others that only Spark's readers unpack.
PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
UNREAD = ("deflate", "lz4", "snappy")


def open_store(path: str) -> tuple[afs.FileSystem, str]:
    """File system and path of a plain path or a URI (file, hdfs, s3, gs)."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return afs.FileSystem.from_uri(path)


def checked_name(name: str | None) -> str:
    """A relative file name inside the tree; anything else is an error."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or parts[0].startswith(STAGING):
        raise ValueError(f"not a file name inside the tree: {name!r}")
    return name


@dataclass
class Attempt(WriterCommitMessage):
    folder: str  # the first one; the others are numbered after it
    files: int
    folders: int = 1

    def all_folders(self) -> list[str]:
        return [self.folder, *[f"{self.folder}-{i}" for i in range(1, self.folders)]]


def packed(text: str) -> Column:
    """A column of texts as ``write_tree`` takes them ``packed``: when they are
    dealt, they are two thirds of what a shuffle's own packing leaves."""
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else zlib.compress(t, 1))
    return F.pandas_udf(pack, BinaryType())(F.col(text).cast("binary"))


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, job: str, replace: bool, met: bool = True):
        """``met``: rows for one file are in one task."""
        self.root, self.job, self.replace, self.met = root, job, replace, met

    def write(self, rows: Iterator[Row]) -> Attempt:
        """Rows come in the order of their names: equal ones are neighbours."""
        store, root = open_store(self.root)
        attempt = Attempt(uuid.uuid4().hex, 0)
        folder = f"{root}/{STAGING}{self.job}/{attempt.folder}"
        store.create_dir(folder)
        last = made = None
        for name, text, *_ in rows:
            if checked_name(name) == last:
                raise ValueError(f"two rows for the file {name!r}")
            last = name
            if attempt.files == attempt.folders * FILES:
                folder = f"{root}/{STAGING}{self.job}/{attempt.folder}-{attempt.folders}"
                attempt.folders += 1
            parent = f"{folder}/{name}".rsplit("/", 1)[0]
            if parent != made:
                store.create_dir(parent)
                made = parent
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(zlib.decompress(text) if isinstance(text, bytes | bytearray)
                          else (text or "").encode("utf-8", "surrogatepass"))
            attempt.files += 1
        return attempt

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = open_store(self.root)
        staging = f"{root}/{STAGING}{self.job}"
        store.create_dir(staging)
        told = {"attempts": sorted(f for m in messages if m is not None for f in m.all_folders()), "replace": self.replace,
                "met": self.met}
        with store.open_output_stream(f"{staging}/manifest.tmp") as out:
            out.write(json.dumps(told).encode())
        store.move(f"{staging}/manifest.tmp", f"{staging}/manifest.json")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = open_store(self.root)
        if store.get_file_info(f"{root}/{STAGING}{self.job}").type == afs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}{self.job}")


class TreeSource(DataSource):
    """Columns: the file's name below the root, its text, and perhaps one that
    rows met by."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self.options["job"], self.options["replace"] == "true",
                          self.options["met"] == "true")


def _move_files(root: str, staging: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The files of each attempt to their places; done ones are gone from
        the attempt's folder and need nothing."""
        store, base = open_store(root)
        for batch in batches:
            for attempt in batch["attempt"]:
                folder = f"{base}/{staging}/{attempt}"
                made = set()
                for info in store.get_file_info(afs.FileSelector(folder, allow_not_found=True, recursive=True)):
                    if info.type != afs.FileType.File:
                        continue
                    place = f"{base}/{info.path[len(folder) + 1:]}"
                    parent = place.rsplit("/", 1)[0]
                    if parent not in made:
                        store.create_dir(parent)
                        made.add(parent)
                    try:
                        store.move(info.path, place)
                    except FileNotFoundError:
                        pass  # another run of this task was faster
            yield batch[["attempt"]]
    return run


def _staged_names(root: str, staging: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The names in each attempt's folder."""
        store, base = open_store(root)
        for batch in batches:
            for attempt in batch["attempt"]:
                folder = f"{base}/{staging}/{attempt}"
                if store.get_file_info(folder).type != afs.FileType.Directory:
                    continue
                if names := [path[len(folder) + 1:] for path, _ in _sizes(store, folder)]:
                    yield pd.DataFrame({"name": names})
    return run


def _publish(spark: SparkSession, root: str, staging: str) -> None:
    store, base = open_store(root)
    folder = f"{base}/{staging}"
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        told = json.loads(f.read())
    rows = spark.createDataFrame([(a,) for a in told["attempts"]], "attempt string")
    rows = rows.repartitionByRange(max(1, len(told["attempts"])), "attempt")
    if not told.get("met", True):
        names = rows.mapInPandas(_staged_names(root, staging), "name string")
        if twice := names.groupBy("name").count().where("count > 1").first():
            store.delete_dir(folder)
            raise ValueError(f"two rows for the file {twice['name']!r}")
    if told["replace"] and store.get_file_info(f"{folder}/cleared").type == afs.FileType.NotFound:
        for info in store.get_file_info(afs.FileSelector(base)):
            if not info.base_name.startswith(STAGING):
                (store.delete_dir if info.type == afs.FileType.Directory else store.delete_file)(info.path)
        with store.open_output_stream(f"{folder}/cleared"):
            pass
    if told["attempts"]:
        rows.mapInPandas(_move_files(root, staging), "attempt string").write.format("noop").mode("overwrite").save()
    store.delete_dir(folder)


def dealt_rows(df: DataFrame, name: str | Column, text: str | Column, meet: str | None, packed: bool = False) -> DataFrame:
    """(path, text) as the writer takes them; and what they met by if it isn't
    the name, as Spark forgets by what rows are dealt once that is dropped."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (name, text)]
    rows = df.select(cols[0].cast("string").alias("path"), cols[1].cast("binary" if packed else "string").alias("text"),
                     *([] if meet is None else [F.col(meet).alias("meet")]))
    return rows.repartition("path" if meet is None else "meet").sortWithinPartitions("path")


def write_tree(df: DataFrame, root: str, name: str | Column = "path", text: str | Column = "text",
               replace: bool = True, meet: str | None = None, packed: bool = False) -> None:
    """One file for each row. Rows meet by name first, so that two rows for
    one file are an error (and not a race); null texts are empty files, a null
    name or one that leaves the tree is an error. An error leaves the tree as
    it was.

    ``meet`` is a column that rows for one file should share: rows meet by it
    instead, and those that a join has brought together by it are not dealt
    once more with their texts. As two rows could yet have one name, the names
    of all are compared before any takes its place. Texts may come ``packed``."""
    spark = df.sparkSession
    spark.dataSource.register(TreeSource)
    job = uuid.uuid4().hex
    (dealt_rows(df, name, text, meet, packed).write.format(FORMAT).mode("append").option("path", root).option("job", job)
     .option("replace", str(replace).lower()).option("met", str(meet is None).lower()).save())
    _publish(spark, root, STAGING + job)


def recover_tree(spark: SparkSession, root: str) -> int:
    """Finish committed writes that were not fully published and drop the
    remains of others; the number of writes finished. Not to be called while
    another job writes to the tree."""
    store, base = open_store(root)
    done = 0
    for info in store.get_file_info(afs.FileSelector(base, allow_not_found=True)):
        if not info.base_name.startswith(STAGING):
            continue
        if store.get_file_info(f"{info.path}/manifest.json").type == afs.FileType.File:
            _publish(spark, root, info.base_name)
            done += 1
        else:
            store.delete_dir(info.path)
    return done


def _choices(glob: str) -> list[str]:
    """A glob with at most one ``{a,b}`` choice as globs without."""
    head, brace, rest = glob.partition("{")
    choice, _, tail = rest.partition("}")
    return [head + c + tail for c in choice.split(",")] if brace else [glob]


def _name_test(glob: str):
    """Test of a file name against a glob with at most one ``{a,b}`` choice."""
    globs = _choices(glob)
    return lambda name: not name.startswith(("_", ".")) and any(fnmatchcase(name, g) for g in globs)


def _sizes(store: afs.FileSystem, place: str, below: bool = True) -> Iterator[tuple[str, int]]:
    """(path, size) of the files in a folder, and ``below`` it. A local folder
    is read entry by entry, one of another store is listed without those below
    it."""
    if isinstance(store, afs.LocalFileSystem):
        with os.scandir(place) as entries:
            for e in entries:
                if e.is_dir():
                    if below:
                        yield from _sizes(store, e.path)
                elif e.is_file():
                    yield e.path, e.stat().st_size
        return
    folders = []
    for f in store.get_file_info(afs.FileSelector(place)):
        if f.type == afs.FileType.File:
            yield f.path, f.size
        elif f.type == afs.FileType.Directory:
            folders.append(f.path)
    for folder in folders if below else ():
        yield from _sizes(store, folder)


def _folders(store: afs.FileSystem, place: str) -> Iterator[str]:
    """The folders right in a folder."""
    if isinstance(store, afs.LocalFileSystem):
        with os.scandir(place) as entries:
            yield from (e.path for e in entries if e.is_dir())
    else:
        yield from (f.path for f in store.get_file_info(afs.FileSelector(place)) if f.type == afs.FileType.Directory)


def _unfold(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each whole folder as its own files and the folders right in it."""
        store, _ = open_store(root)

        def found() -> Iterator[tuple[str, bool]]:
            for batch in batches:
                for place, folder in zip(batch["place"], batch["folder"], strict=True):
                    yield place, False
                    if folder:
                        yield from ((p, True) for p in _folders(store, place) if not p.rsplit("/", 1)[1].startswith(STAGING))

        places = found()
        while part := list(islice(places, FILES)):
            yield pd.DataFrame(part, columns=["place", "folder"])
    return run


def _places(spark: SparkSession, root: str) -> DataFrame:
    """What to list: (place, folder), a folder with all below it or only the
    files right in it. The folders of the first levels get a task each; their
    files are not gathered, and the driver lists nothing."""
    store, base = open_store(root)
    if store.get_file_info(base).type == afs.FileType.NotFound:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    rows = spark.range(0, 1, 1, 1).select(F.lit(base).alias("place"), F.lit(True).alias("folder"))
    for _ in range(LEVELS):
        rows = rows.mapInPandas(_unfold(root), "place string, folder boolean").repartition(_tasks(spark), "place")
    return rows


def _tasks(spark: SparkSession) -> int:
    """Names are few bytes, by which Spark would gather them into few tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _empty_below(root: str, glob: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        scheme = "file://" if root.startswith(("/", "file:")) else root[:len(root.rstrip("/")) - len(base.rstrip("/"))]
        fits = _name_test(glob)

        def found() -> Iterator[str]:
            for batch in batches:
                for place, folder in zip(batch["place"], batch["folder"], strict=True):
                    yield from (path for path, size in _sizes(store, place, folder) if size == 0 and fits(path.rsplit("/", 1)[1])
                                and not any(p.startswith(("_", ".")) for p in path[len(base):].split("/")))

        empty = found()
        while part := list(islice(empty, FILES)):
            yield pd.DataFrame({"path": [scheme + quote(f, safe="/=+,;:@&~!$'()*") for f in part],
                                "file_name": [f.rsplit("/", 1)[1] for f in part]})
    return run


def empty_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, file_name) of the files of length 0 below ``root``, which Spark's
    own readers leave out."""
    return _places(spark, root).mapInPandas(_empty_below(root, glob), "path string, file_name string")


def _spark_shows(name: str, file: bool) -> bool:
    """Spark's readers pass over the others."""
    if name.startswith(".") or name.startswith("_") and "=" not in name:
        return not file and name.startswith(("_metadata", "_common_metadata"))
    return not name.endswith("._COPYING_")


def _uri_quote(path: str) -> str:
    """The path as java.net.URI quotes it: letters of any script stay."""
    return "".join(c if c > "\x7f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
                   else quote(c, safe="/=+,;:@&~!$'()*") for c in path)


def _full_below(root: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        fits = re.compile(pattern, re.DOTALL).fullmatch

        def found() -> Iterator[str]:
            for batch in batches:
                for place, folder in zip(batch["place"], batch["folder"], strict=True):
                    for path, size in _sizes(store, place, folder):
                        *folders, name = path[len(base):].strip("/").split("/")
                        if size and fits(name) and _spark_shows(name, True) and all(_spark_shows(p, False) for p in folders):
                            yield path

        full = found()
        while part := list(islice(full, FILES)):
            yield pd.DataFrame({"place": part})
    return run


def _unpacked(store: afs.FileSystem, place: str) -> bytes:
    """The bytes of a file; as Spark's readers do, a packed one is unpacked."""
    with store.open_input_stream(place, compression=PACKED.get(os.path.splitext(place)[1])) as f:
        return f.read()


def _texts(root: str, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each file's text, ``BYTES`` or one file at a time."""
        store, base = open_store(root)

        def part(places: list[str], texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([f"{uri}/{_uri_quote(p[len(base):].lstrip('/'))}" for p in places], pa.string()),
                pa.array([p.rsplit("/", 1)[1] for p in places], pa.string()), pa.array(texts, pa.binary())],
                ["path", "file_name", "text"])

        places, texts, size = [], [], 0
        for batch in batches:
            for place in batch.column(0).to_pylist():
                places.append(place)
                texts.append(_unpacked(store, place))
                size += len(texts[-1])
                if size >= BYTES or len(places) == FILES:
                    yield part(places, texts)
                    places, texts, size = [], [], 0
        if places:
            yield part(places, texts)
    return run


def unread(name: str) -> Column:
    """Whether the file of a name is left to Spark's own reader."""
    return F.col(name).rlike(rf"\.({'|'.join(UNREAD)})$")


def _full_names(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(place) of the files that Spark's own reader gives."""
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()
    return _places(spark, root).mapInPandas(_full_below(root, pattern), "place string")


def has_unread(spark: SparkSession, root: str, glob: str) -> bool:
    """Only for a glob that such names may fit, tasks look for one."""
    tails = [re.split(r"[]*?}]", g.replace("\\", ""))[-1] for g in _choices(glob)]
    return any(t.endswith(f".{e}") or f".{e}".endswith(t) for t in tails for e in UNREAD) and bool(
        _full_names(spark, root, glob).where(unread("place")).head(1))


def full_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, file_name, text) of the files below ``root`` that Spark's own
    whole-text reader gives, without ``unread`` ones. That one keeps the status
    of every file in the driver; here tasks list the folders, and the names are
    dealt to the tasks that read them, whenever the rows are asked for."""
    names = _full_names(spark, root, glob).where(~unread("place"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    uri = hadoop.Path(folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()).toUri().toString()
    read = names.repartition(_tasks(spark), "place").mapInArrow(_texts(root, uri), "path string, file_name string, text binary")
    return read.withColumn("text", F.col("text").cast("string"))


def result_file(by: Sequence[str], index: str = "index", opt: str = "opt", language: str = "language") -> Column:
    """K3 name of a result: ``{by}/../{index}_{opt}.{language}``."""
    last = F.concat(F.col(index).cast("string"), F.lit("_"), F.col(opt), F.lit("."), F.col(language))
    return F.concat_ws("/", *by, last)
