"""Readers (S1-S8): JSON arrays, JSONL, directory sets, source and
prediction trees, tokenised datasets, a dataset registry, keyword lists.

Every reader takes an explicit schema where the format has one, so no job
is spent on inference and types are stable.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.regex import py_strip
from . import trees
from .json_arrays import read_json_array  # noqa: F401


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed
    line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_dirs(spark: SparkSession, dirs: str | Sequence[str], schema: StructType,
                    glob: str = "*.jsonl") -> DataFrame:
    """S3: comma-separated (or listed) directories, their ``*.jsonl`` files
    only, not recursive; a missing directory fails the read."""
    if isinstance(dirs, str):
        dirs = [x for x in dirs.split(",") if x]
    return (spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "false").json(list(dirs)))


def _files(spark: SparkSession, root: str, glob: str, empty: bool) -> DataFrame:
    """(path, file_name, text) of the matching files below ``root``.

    Tasks list and read the tree (Arrow must know the store), so the driver
    holds no names. Without ``empty``, and for packed files that Arrow cannot
    unpack, Spark's own reader does, in any store: it leaves out files of length
    0 and keeps the list of the others in the driver. Its ``wholetext`` must be
    an argument of ``text()``; as an option it would be overridden and yield one
    row per line.
    """
    def by_spark() -> DataFrame:
        return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))

    if not empty:
        return by_spark()
    files = trees.full_files(spark, root, glob).unionByName(trees.empty_files(spark, root, glob).withColumn("text", F.lit("")))
    return files.unionByName(by_spark().where(trees.unread("file_name"))) if trees.has_unread(spark, root, glob) else files


def read_source_tree(spark: SparkSession, root: str, glob: str = "*.c", empty: bool = True) -> DataFrame:
    """Every matching file below ``root`` as one row (name = path, text),
    empty files too unless ``empty`` is false."""
    return _files(spark, root, glob, empty).select(F.col("path").alias("name"), "text")


#: Fixed value: number, label, language.
PREDICTION_FILE = r"^(\d+)_(.*)\.(c|cpp)$"


def read_prediction_tree(spark: SparkSession, root: str, last_wins: bool = False, empty: bool = True) -> DataFrame:
    """``{decompiler}/{opt}/{index}_{opt}.{c,cpp}`` files -> (index, opt,
    language, decompiler, prediction), one row per file; bodies stripped. The
    index is the number before the first underscore, the opt whatever follows
    it; files without such a number are skipped. ``last_wins`` keeps one row per (decompiler,
    index), the one with the greatest path, as one scoring script does."""
    files = _files(spark, root, "*.{c,cpp}", empty).select("path", "file_name", py_strip(F.col("text")).alias("prediction"))
    name = F.col("file_name")
    parsed = files.where(name.rlike(PREDICTION_FILE)).select("path", F.struct(
        F.regexp_extract(name, PREDICTION_FILE, 1).cast("long").alias("index"),
        *[F.regexp_extract(name, PREDICTION_FILE, i).alias(n) for i, n in ((2, "opt"), (3, "language"))]).alias("f"),
        F.element_at(F.split(F.col("path"), "/"), -3).alias("decompiler"), "prediction")
    if not last_wins:
        return parsed.select("f.index", "f.opt", "f.language", "decompiler", "prediction")
    return parsed.groupBy(F.col("f.index").alias("index"), "decompiler").agg(
        F.max_by("f.opt", "path").alias("opt"), F.max_by("f.language", "path").alias("language"),
        F.max_by("prediction", "path").alias("prediction"))


SPLITS = {"train": "train", "dev": "validation", "test": "test"}


def load_tokenized(spark: SparkSession, paths: str | Sequence[str], mode: str = "train") -> DataFrame | None:
    """Tokenised Parquet datasets; ``dev`` reads the ``validation``
    split. A dataset without a ``split`` column is one unsplit set and is
    appended in any mode; paths without the split add nothing; no rows at all
    gives ``None`` (the only job run here looks for a first row)."""
    if mode not in SPLITS:
        raise ValueError(f"unsupported mode {mode}, must be one of {tuple(SPLITS)}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        df = df.where(F.col("split") == SPLITS[mode]) if "split" in df.columns else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return None if out is None or out.isEmpty() else out


def register_datasets(spark: SparkSession, registry: Mapping[str, DataFrame]) -> list[str]:
    """Name -> DataFrame registry as temporary views."""
    for name, df in registry.items():
        df.createOrReplaceTempView(name)
    return sorted(registry)


def load_registry(spark: SparkSession, path: str, schemas: Mapping[str, StructType],
                  wanted: Sequence[str] | None = None) -> list[str]:
    """A registry file ``{name: {"file_name": ..}}`` -> its data sets as
    temporary views, all of them or the ``wanted`` ones. File names are
    relative to the registry's folder: ``.json`` is one array, ``.jsonl`` lines,
    ``.parquet`` columns. A name that is not in the registry, an entry without
    a file and a JSON set without a schema are errors. The registry itself is
    configuration, a few lines read by the driver."""
    entries = json.loads(spark.read.text(path, wholetext=True).first()[0])
    root = path.rstrip("/").rsplit("/", 1)[0]
    found = {}
    for name in wanted or entries:
        if name not in entries or not entries[name].get("file_name"):
            raise ValueError(f"no data set {name!r} with a file in the registry")
        file = f"{root}/{entries[name]['file_name']}"
        if file.endswith(".parquet"):
            found[name] = spark.read.parquet(file)
        elif name not in schemas:
            raise ValueError(f"no schema for the data set {name!r}")
        else:
            found[name] = (read_jsonl if file.endswith(".jsonl") else read_json_array)(spark, file, schemas[name])
    return register_datasets(spark, found)


def read_keyword_list(spark: SparkSession, path: str) -> DataFrame:
    """One comma-separated line -> distinct trimmed names (one column)."""
    return (spark.read.text(path)
            .select(F.explode(F.split("value", ",")).alias("name"))
            .select(py_strip(F.col("name")).alias("name"))
            .where(F.col("name") != "").distinct())
