"""Directory trees as a Spark data source, one row per file, hidden and underscored names included.

Spark's own file sources leave out names that begin with a dot or an underscore; this one prunes only what it is told to.
The driver lists the first levels, each task walks subtrees of its own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship_code

# Directories that are never entered.
SKIPPED = (".git", "__pycache__", "node_modules", ".venv", "venv", ".hf_cache", ".playwright-mcp", "$Recycle.Bin", "System Volume Information", "Windows")

SCHEMA = "path string, filename string, extension string, size_bytes long, created_at string, modified_at string, accessed_at string, drive string, parent_dir string, depth int"


class Part(InputPartition):
    """Subtrees (path, levels below the root) to walk, and single files."""

    def __init__(self, trees: list[tuple[str, int]], files: list[str]):
        super().__init__(None)
        self.trees, self.files = trees, files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.abspath(p) for p in json.loads(options["roots"])]
        self.include = set(json.loads(options.get("include", "[]")))
        self.exclude = set(json.loads(options.get("exclude", "[]")))
        self.protected = [os.path.normpath(p) for p in json.loads(options.get("protected", "[]"))]
        self.most_bytes = int(options.get("max_file_size", 0))
        self.most_depth = int(options.get("max_depth", 0))
        self.tasks = max(1, int(options.get("tasks", 64)))

    def enters(self, path: str) -> bool:
        name = os.path.basename(path)
        if name in SKIPPED or name.startswith("."):
            return False
        return not any(path == p or path.startswith(p + os.sep) for p in self.protected)

    def wants(self, path: str) -> bool:
        ext = PurePath(path).suffix.lower()
        return (not self.include or ext in self.include) and ext not in self.exclude

    def partitions(self) -> list[Part]:
        """Roots are opened level by level until there are enough subtrees for all tasks."""
        files = [r for r in self.roots if os.path.isfile(r)]
        trees = [(r, 0) for r in self.roots if os.path.isdir(r)]
        single: list[str] = []
        for _ in range(4):
            if len(trees) >= self.tasks or not trees:
                break
            below: list[tuple[str, int]] = []
            for root, level in trees:
                if self.most_depth and level > self.most_depth:
                    continue
                for entry in self.entries(root):
                    if entry.is_dir(follow_symlinks=False):
                        if self.enters(entry.path):
                            below.append((entry.path, level + 1))
                    else:
                        single.append(entry.path)
            trees = below
        parts = [Part(trees[i :: self.tasks], single[i :: self.tasks]) for i in range(self.tasks)]
        parts = [p for p in parts if p.trees or p.files]
        # a root that is a file is taken as it is
        return [*parts, *([Part([], ["=" + f for f in files])] if files else [])] or [Part([], [])]

    @staticmethod
    def entries(path: str) -> list[os.DirEntry]:
        try:
            with os.scandir(path) as it:
                return sorted(it, key=lambda e: e.name)
        except OSError:
            return []

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.files:
            yield from self.row(path.removeprefix("="), path.startswith("="))
        todo = list(partition.trees)
        while todo:
            root, level = todo.pop()
            if self.most_depth and level > self.most_depth:
                continue
            for entry in self.entries(root):
                if entry.is_dir(follow_symlinks=False):
                    if self.enters(entry.path):
                        todo.append((entry.path, level + 1))
                else:
                    yield from self.row(entry.path)

    def row(self, path: str, always: bool = False) -> Iterator[tuple]:
        try:
            stat = os.stat(path)
        except OSError:
            return
        if not os.path.isfile(path) or not always and (stat.st_size == 0 or self.most_bytes and stat.st_size > self.most_bytes or not self.wants(path)):
            return
        p = PurePath(path)
        when = lambda t: datetime.fromtimestamp(t, tz=UTC).isoformat()
        yield (path, p.name, p.suffix.lower(), stat.st_size, when(stat.st_ctime), when(stat.st_mtime), when(stat.st_atime), p.drive or p.parts[0], str(p.parent), len(p.parts))


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, roots: list[str], *, include: list[str] = (), exclude: list[str] = (), protected: list[str] = (), max_file_size: int = 0, max_depth: int = 0, tasks: int = 64) -> DataFrame:
    """Files below ``roots`` (each once). Empty files, skipped, hidden and protected directories are left out; a root that is a file is taken as it is.

    A path outside what exists gives no rows. All executors must see the tree under the same paths.
    """
    ship_code(spark)
    spark.dataSource.register(FileTree)
    options = {"roots": json.dumps(list(dict.fromkeys(roots))), "include": json.dumps(list(include)), "exclude": json.dumps(list(exclude)), "protected": json.dumps(list(protected))}
    return spark.read.format("filetree").options(**options, max_file_size=max_file_size, max_depth=max_depth, tasks=tasks).load()


def validated_roots(paths: list[str]) -> list[str]:
    """The paths of a request: 1 to 32, trimmed, at most 1,024 characters, each once whatever its letter case, the first spelling kept."""
    kept: dict[str, str] = {}
    for p in (p.strip() for p in paths):
        if p:
            if len(p) > 1024:
                raise ValueError("a path has more than 1,024 characters")
            kept.setdefault(p.lower(), p)
    if not 1 <= len(kept) <= 32:
        raise ValueError("1 to 32 paths are needed")
    return list(kept.values())
