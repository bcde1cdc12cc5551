"""Reports as files of their own names, written as a Spark data source with commit and abort."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from groundwork.functions.workers import ship
from groundwork.sources.trees import opened

MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    """Where one task attempt has put its files."""

    folder: str


class ReportWriter(DataSourceWriter):
    """Task attempts write into staging folders of their own; the commit moves the files of those that Spark took."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex
        opened(path)[0].create_dir(self.staging)

    @property
    def staging(self) -> str:
        return f"{opened(self.path)[1]}/.staging-{self.job}"

    def write(self, iterator: Iterator) -> Staged:
        where, _ = opened(self.path)
        context = TaskContext.get()
        mine = f"{self.staging}/{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        where.create_dir(mine, recursive=False)  # an attempt that outlives its job finds no staging folder
        for row in iterator:
            if not row.file_name or "/" in row.file_name or row.file_name.startswith("."):
                raise ValueError(f"not a report's file name: {row.file_name!r}")
            with where.open_output_stream(f"{mine}/{row.file_name}") as f:
                f.write((row.body or "").encode())
        return Staged(mine)

    def commit(self, messages: list[Staged | None]) -> None:
        where, target = opened(self.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in filter(None, messages):
                names = [x.base_name for x in where.get_file_info(fs.FileSelector(m.folder))]
                list(pool.map(lambda name, m=m: where.move(f"{m.folder}/{name}", f"{target}/{name}"), names))
        self._clear(where)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(opened(self.path)[0])

    def _clear(self, where: fs.FileSystem) -> None:
        for _ in range(50):
            if where.get_file_info(self.staging).type != fs.FileType.Directory:
                return
            try:
                where.delete_dir(self.staging)
            except OSError:  # an attempt that is being cancelled has just added a file
                time.sleep(0.1)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "file_name string, body string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])


def write_reports(reports: DataFrame, folder: str) -> None:
    """One file for each report (file_name, body), in one folder that driver and executors share; further columns are left out.

    Nothing is in the folder before all tasks are done, and a failed job leaves nothing. A task that ran twice
    counts once. A file that is there already under the same name is replaced; of two reports of one name in
    a job one stays, as names are made of what they hold. A null body is an empty file; a name that is null,
    empty, a path or begins with a dot fails the job.
    """
    ship(reports.sparkSession)
    reports.sparkSession.dataSource.register(ReportSink)
    where, path = opened(folder)
    where.create_dir(path)
    reports.select("file_name", "body").write.format("reports").mode("append").save(folder)
