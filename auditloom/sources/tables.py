"""Inputs as tables of paths and contents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.format import format_bytes
from auditloom.operators import classify


NOT_FOUND = "File not found"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{folder}/{name}.parquet"))


def balanced(df: DataFrame) -> DataFrame:
    """Dealt over all cores if the source has fewer splits, as one small file has; large inputs are left as they are, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def corpus(documents: DataFrame) -> DataFrame:
    """(doc_id, source, path, content) of a documents table."""
    return documents.select("doc_id", "source", F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


def read_files(spark: SparkSession, root: str, most: int = K.MAX_FILE_BYTES) -> DataFrame:
    """(path, content, size, skip_reason) of all files below a folder. The source filters by length before it opens a file, so nothing over the cap is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.filter(F.col("length") <= most).select("path", F.col("content").alias("data"), F.col("length").alias("size"))
    large = files.filter(F.col("length") > most).select("path", F.lit(None).cast("binary").alias("data"), F.col("length").alias("size"))
    return size_capped(small.unionByName(large), F.decode("data", "UTF-8"), most).drop("data")


def size_capped(df: DataFrame, content: Column, most: int = K.MAX_FILE_BYTES, size: str = "size") -> DataFrame:
    """Adds skip_reason and content; null size means that a file isn't there."""
    reason = F.when(F.col(size).isNull(), NOT_FOUND).when(F.col(size) > most, F.concat(F.lit("File too large ("), format_bytes(F.col(size)), F.lit(")")))
    return df.withColumn("skip_reason", reason).withColumn("content", F.when(reason.isNull(), content))


#: Contents that a task gathers before it passes them on.
READ_BYTES = 16 << 20


def _read(uri: str, size: int | None, most: int) -> tuple[bytes | None, int | None, str | None]:
    """(content, size, reason) of one file; nothing over ``most`` bytes is opened, and nothing raised."""
    try:
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        if size is None:
            info = files.get_file_info(path)
            if info.type == pyarrow.fs.FileType.NotFound:
                return None, None, NOT_FOUND
            size = info.size or 0
        if size > most:
            return None, size, None
        with files.open_input_stream(path) as f:
            data = f.read(most + 1)
        # A file may have grown since it was listed.
        return (data, len(data), None) if len(data) <= most else (None, len(data), None)
    except FileNotFoundError:
        return None, None, NOT_FOUND
    except (OSError, pa.ArrowException) as e:
        return None, size, str(e) or "Read error"


def read_listed(paths: DataFrame, most: int = K.MAX_FILE_BYTES, root: str = "", path: str = "path") -> DataFrame:
    """Adds content, size and skip_reason to rows of paths, which may be relative to ``root``: a file that can't be read never fails the others.

    With a column ``size``, as ``walk`` gives it, files aren't asked for their sizes again. A file over ``most`` bytes isn't opened. Reasons are, in this order,
    that a file isn't there, that it is too large, or what the file system says. Contents are decoded as UTF-8, with marks for what isn't. All other columns stay,
    so input order can be kept by a column of positions. Rows are dealt over the cores, one read after the other in each task.
    """
    names = [c for c in paths.columns if c not in ("size", "content", "skip_reason")]
    listed = F.col("size").cast("long") if "size" in paths.columns else F.lit(None).cast("long")
    rows = paths.select(*names, listed.alias("size"))
    shape = rows.select("*", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("fault")).schema
    at = names.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, made = 0, 0, []

            def flush(stop: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                contents, sizes, faults = zip(*made, strict=True)
                part = batch.slice(start, stop - start)
                texts = [c if c is None else c.decode("utf-8", "replace") for c in contents]
                return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), pa.array(faults, pa.string())], names=shape.names)

            for i, (name, size) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True), 1):
                made.append((None, None, NOT_FOUND) if name is None else _read(_uri(name if not root or name.startswith("/") or "://" in name else f"{root.rstrip('/')}/{name}"), size, most))
                held += len(made[-1][0] or b"")
                if held >= READ_BYTES or i == batch.num_rows:
                    yield flush(i)
                    start, held, made = i, 0, []

    read = balanced(rows).mapInArrow(run, shape)
    too_large = F.concat(F.lit("File too large ("), format_bytes(F.col("size")), F.lit(")"))
    reason = F.when(F.col("fault") == NOT_FOUND, F.col("fault")).when(F.col("size") > most, too_large).otherwise(F.col("fault"))
    return read.withColumn("skip_reason", reason).drop("fault")


IGNORE_FILES = (".gitignore", ".archignore")


def _uri(root: str) -> str:
    return root if "://" in root else f"file://{os.path.abspath(root)}"


def _listed(folder: str, local: bool, files: pyarrow.fs.FileSystem) -> Iterator[tuple[str, int, bool]]:
    """(path, size, is a folder) of a folder's entries; links and what can't be read are left out."""
    try:
        entries = files.get_file_info(pyarrow.fs.FileSelector(folder))
    except OSError:
        return
    for e in entries:
        if not (local and os.path.islink(e.path)) and e.type in (pyarrow.fs.FileType.File, pyarrow.fs.FileType.Directory):
            yield e.path, e.size or 0, e.type == pyarrow.fs.FileType.Directory


def walk(spark: SparkSession, root: str, blocked: tuple[str, ...] = K.BLOCKED_DIRECTORIES) -> DataFrame:
    """(path, size) of all files below a folder that driver and workers reach, relative to it, hidden ones included; blocked folders aren't entered.

    The driver lists only until there is a folder for each core, the workers walk the rest and stream what they find.
    """
    uri = _uri(root)
    files, base = pyarrow.fs.FileSystem.from_uri(uri)
    local, cut = uri.startswith("file:"), len(base.rstrip("/")) + 1
    wanted = spark.sparkContext.defaultParallelism
    shallow, deep = [], [base]
    while deep and len(deep) < wanted:
        below = [p for d in deep for p, _, folder in _listed(d, local, files) if folder and os.path.basename(p) not in blocked]
        shallow, deep = shallow + deep, below
    todo = spark.createDataFrame([(d, False) for d in shallow] + [(d, True) for d in deep], "folder string, deep boolean").repartition(max(1, len(shallow) + len(deep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pyarrow.fs.FileSystem.from_uri(uri)
        made: list[tuple[str, int]] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["path", "size"])
        for batch in batches:
            for first, enter in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stack = [first]
                while stack:
                    for path, size, folder in _listed(stack.pop(), local, where):
                        if not folder:
                            made.append((path[cut:], size))
                        elif enter and os.path.basename(path) not in blocked:
                            stack.append(path)
                    if len(made) >= 10_000:
                        yield flush()
                        made.clear()
        yield flush()

    return todo.mapInArrow(run, "path string, size bigint")


def load_rules(root: str, names: tuple[str, ...] = IGNORE_FILES) -> list[tuple[str, bool]]:
    """The rules of a folder's ignore files, one file after the other; a file that isn't there or can't be read has none."""
    files, base = pyarrow.fs.FileSystem.from_uri(_uri(root))
    rules: list[tuple[str, bool]] = []
    for name in names:
        try:
            with files.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
                rules += classify.ignore_rules(f.read().decode("utf-8", "replace"))
        except OSError:
            continue
    return rules


def discover(spark: SparkSession, root: str, git_ignore: bool = True, arch_ignore: bool = True, **options) -> DataFrame:
    """(path, size, reason): a folder's files, classified with its own ignore files."""
    names = tuple(n for n, on in zip(IGNORE_FILES, (git_ignore, arch_ignore), strict=True) if on)
    return classify.classify(walk(spark, root), rules=load_rules(root, names), **options)


def filter_paths(paths: DataFrame, root: str, git_ignore: bool = True, arch_ignore: bool = True, path: str = "path", **options) -> DataFrame:
    """Adds reason to given paths, absolute or relative, which are told from ``root`` first."""
    names = tuple(n for n, on in zip(IGNORE_FILES, (git_ignore, arch_ignore), strict=True) if on)
    return classify.classify(paths.withColumn(path, classify.relative(F.col(path), os.path.abspath(root) if "://" not in root else root)), path, rules=load_rules(root, names), **options)
