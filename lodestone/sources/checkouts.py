"""Python data sources over checkouts: their files and the lines of their logs, one partition for each checkout.

spark.dataSource.register(CheckoutFiles); spark.read.format("checkout_files").option("a-name", "/shared/a").load(): each
option names a checkout and gives its folder, which executors must be able to see. Spark's own file listing leaves out
names that begin with a dot or an underscore, which are part of a checkout; hence a source of our own.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Header of a commit in the log; operators.commits reads it.
FORMAT = "--pretty=format:%H%x1f%h%x1f%an%x1f%ae%x1f%aI%x1f%s"
SECONDS = 600


class _Checkout(InputPartition):
    def __init__(self, repo_id: str, root: str):
        self.repo_id, self.root = repo_id, root


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = sorted((k, v) for k, v in options.items() if k != "path")

    def partitions(self) -> list[InputPartition]:
        return [_Checkout(*r) for r in self.roots]


class _FilesReader(_Reader):
    def read(self, partition: _Checkout) -> Iterator[tuple]:
        for folder, dirs, names in os.walk(partition.root):
            dirs[:] = sorted(d for d in dirs if d != ".git" and not os.path.islink(os.path.join(folder, d)))
            for name in sorted(names):
                full = os.path.join(folder, name)
                if os.path.islink(full) or not os.path.isfile(full):
                    continue
                try:
                    with open(full, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield partition.repo_id, os.path.relpath(full, partition.root).replace(os.sep, "/"), None if content is None else len(content), content


class CheckoutFiles(DataSource):
    """(repo_id, path, size, content) of every regular file but those of .git; an unreadable one has null size and content."""

    @classmethod
    def name(cls) -> str:
        return "checkout_files"

    def schema(self) -> str:
        return "repo_id string, path string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader(self.options)


class _LogReader(_Reader):
    def read(self, partition: _Checkout) -> Iterator[tuple]:
        command = ["git", "-C", partition.root, "log", FORMAT, "--numstat", "--no-merges", "HEAD"]
        try:
            done = subprocess.run(command, capture_output=True, timeout=SECONDS, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return
        if done.returncode == 0:
            for k, line in enumerate(done.stdout.decode("utf-8", "replace").split("\n")):
                yield partition.repo_id, k, line


class CheckoutLog(DataSource):
    """(repo_id, line_no, text) of the log without merges, newest first; a checkout whose log fails has no lines."""

    @classmethod
    def name(cls) -> str:
        return "checkout_log"

    def schema(self) -> str:
        return "repo_id string, line_no bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)
