"""Delivery of results with a commit protocol: a job's record goes only once all of its results are in place.

`register(spark)` makes the format "deliveries" known. Rows (request_id, payload) of a write are put aside by each
task; only when all tasks are done are they moved under `path`, and then the records of their jobs under `jobs` are
removed. A task or write that fails leaves the records where they are, so the jobs are delivered again. Files are named
by job, write and task, and a job whose record is gone is not delivered again: a replay delivers once. Both folders must
be on a file system that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Staged(WriterCommitMessage):
    """What a task put aside: files by job."""

    files: list[tuple[str, str]]


class DeliveryWriter(DataSourceWriter):
    def __init__(self, path: str, jobs: str):
        self.path, self.jobs, self.write_id = path.rstrip("/"), jobs.rstrip("/"), uuid.uuid4().hex

    @property
    def _aside(self) -> str:
        return f"{self.path}/.staged-{self.write_id}"

    def write(self, rows: Iterator[Row]) -> Staged:
        """Runs in a task: appends each row's payload to a file of its job; jobs without a record are delivered already."""
        system, aside = _place(self._aside)
        _, jobs = _place(self.jobs)
        system.create_dir(aside, recursive=True)
        context = TaskContext.get()
        task, open_files, due = f"{context.partitionId()}-{context.taskAttemptId()}", {}, {}
        try:
            for row in rows:
                job = str(row["request_id"])
                if job not in due:
                    due[job] = system.get_file_info(f"{jobs}/{job}.json").type == fs.FileType.File
                if due[job]:
                    if job not in open_files:
                        open_files[job] = system.open_output_stream(f"{aside}/{job}-{task}.jsonl")
                    open_files[job].write(f"{row['payload']}\n".encode())
        finally:
            for f in open_files.values():
                f.close()
        return Staged([(job, f"{aside}/{job}-{task}.jsonl") for job in open_files])

    def commit(self, messages: list[Staged | None]) -> None:
        """Runs on the driver, with one message a task: names of files only."""
        system, path = _place(self.path)
        _, jobs = _place(self.jobs)
        files = sorted(f for m in messages if m is not None for f in m.files)
        for job in dict.fromkeys(job for job, _ in files):
            system.create_dir(f"{path}/{job}", recursive=True)
        for n, (job, file) in enumerate(files):
            system.move(file, f"{path}/{job}/part-{n:05d}.jsonl")
        for job in dict.fromkeys(job for job, _ in files):  # all results are in place
            system.delete_file(f"{jobs}/{job}.json")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, aside = _place(self._aside)
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


class DeliverySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deliveries"

    def schema(self) -> str:
        return "request_id long, payload string"

    def writer(self, schema, overwrite: bool) -> DeliveryWriter:
        return DeliveryWriter(self.options["path"], self.options["jobs"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeliverySource)
