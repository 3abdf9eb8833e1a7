"""Comments posted once each, through Spark's writer of Python data sources.

Tasks only stage their comments in files of their own below the target folder. When all tasks have ended, the driver takes the files
of the attempts that Spark committed: it moves them to the folder or hands their comments on to a callable, so what failed or repeated
attempts staged is never delivered. A job that fails delivers nothing. A callable that raises ends the delivery: what it took before stays
delivered, and is named in the error.

The folder must be one that driver and executors share. Rows pass the driver one at a time; there are as many as findings that a person will read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from auditloom.operators.report import commentable, issue_rows

Send = Callable[[dict], None]


@dataclass
class Staged(WriterCommitMessage):
    """What a committed attempt staged."""

    file: str
    rows: int


class DeliveryError(RuntimeError):
    """The callable failed; says how many comments it had taken."""


class CommentWriter(DataSourceWriter):
    def __init__(self, uri: str, send: Send | None):
        self.uri, self.send, self.job = uri.rstrip("/"), send, uuid.uuid4().hex

    def _files(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, base = self._files()
        folder, rows = f"{base}/_staged-{self.job}", 0
        files.create_dir(folder, recursive=True)
        file = f"{folder}/{uuid.uuid4().hex}.json"  # each attempt has a file of its own
        with files.open_output_stream(file) as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
                rows += 1
        return Staged(file, rows)

    def commit(self, messages: list) -> None:
        files, base = self._files()
        done = 0
        try:
            for part, message in enumerate(m for m in messages if m is not None and m.rows):
                if self.send is None:
                    files.move(message.file, f"{base}/comments-{self.job}-{part:05}.json")
                    continue
                with files.open_input_stream(message.file) as stream:
                    for line in _lines(stream):
                        try:
                            self.send(json.loads(line))
                        except Exception as e:
                            raise DeliveryError(f"{done} comments were delivered, then: {e}") from e
                        done += 1
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        files, base = self._files()
        folder = f"{base}/_staged-{self.job}"
        if files.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            files.delete_dir(folder)


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *lines, rest = (rest + block).split(b"\n")
        yield from lines


def comment_source(send: Send | None = None) -> type[DataSource]:
    """A data source ``comments`` to register: its option ``path`` names the folder; ``send`` takes each comment, without it they stay there as lines of JSON."""

    class Comments(DataSource):
        @classmethod
        def name(cls) -> str:
            return "comments"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            path = self.options["path"]
            return CommentWriter(path if "://" in path else f"file://{path}", send)

    return Comments


def comment_body() -> Column:
    """A comment's text: severity and message, then the suggestion, if there is one, as a quote."""
    return F.concat_ws("\n\n", F.concat(F.lit("**"), F.col("severity"), F.lit("** "), F.col("message")), F.when(F.col("suggestion") != "", F.concat(F.lit("> "), F.col("suggestion"))))


def comments(results: DataFrame) -> DataFrame:
    """(path, line, body): a comment for each issue of a failed result."""
    return issue_rows(commentable(results)).select("path", F.col("line"), comment_body().alias("body"))


def post(results: DataFrame, path: str, send: Send | None = None) -> None:
    """Posts the comments of ``results`` once each: to ``send``, or as files below ``path``."""
    rows = comments(results)
    rows.sparkSession.dataSource.register(comment_source(send))
    rows.write.format("comments").mode("append").option("path", path).save()
