"""Directory trees of source files as ``files(project, path, text, size)`` rows
(A1, A2).

Spark's built-in file sources silently skip names starting with ``_`` or
``.`` (so ``__init__.py`` would vanish); these read them. Files must live on
storage every executor can read (a shared mount).

:func:`read_tree` lists level by level: directories are rows, dealt over the
cluster, and what a level holds is written before the next one is listed, so
each directory is listed once and a deep or wide tree is nobody's own. Files
are then dealt by path and read. A missing root is an error; other directories
and files that cannot be read are rows of :func:`tree_errors`.

``source_tree`` is a Python DataSource for ``spark.read.format``, with the same
options; a task walks one top-level folder.

Options: ``project`` (default: root folder name), ``suffixes`` (default
``.py,.pyi``), ``exclude`` (globs; when given, hidden entries are skipped too),
``max_depth`` (root = 0), ``target_partitions`` (default 64: read tasks),
``chunk_bytes`` (0 = whole files, the default, which parsing needs). With
``chunk_bytes`` set, a larger file is cut at line boundaries into several
rows with ``chunk`` and ``line_offset`` (lines before the chunk), so one huge
log or text file spreads over tasks instead of becoming one oversized row;
text search adds ``line_offset`` to its line numbers.
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "project string, path string, text string, size long, chunk int, line_offset long"


class _Part(InputPartition):
    def __init__(self, rel: str, is_dir: bool):
        self.rel = rel
        self.is_dir = is_dir


def _excluded(rel: str, name: str, patterns: list[str]) -> bool:
    if not patterns:
        return False
    if name.startswith("."):
        return True
    return any(fnmatch.fnmatch(rel, p) or fnmatch.fnmatch(name, p) for p in patterns)


class TreeOptions:
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.project = options.get("project") or os.path.basename(self.root.rstrip("/"))
        self.suffixes = tuple(x.strip() for x in options.get("suffixes", ".py,.pyi").split(",") if x.strip())
        self.exclude = [p.strip() for p in options.get("exclude", "").split(",") if p.strip()]
        self.max_depth = int(options["max_depth"]) if options.get("max_depth") not in (None, "") else None
        self.chunk_bytes = int(options.get("chunk_bytes") or 0)
        self.target_partitions = int(options.get("target_partitions") or 64)

    def entries(self, rel_dir: str) -> list[tuple[str, str, int]]:
        """(kind, path, size) of what a directory holds; an OSError is the
        caller's."""
        out = []
        with os.scandir(os.path.join(self.root, rel_dir) if rel_dir else self.root) as found:
            for e in sorted(found, key=lambda e: e.name):
                rel = f"{rel_dir}/{e.name}" if rel_dir else e.name
                if _excluded(rel, e.name, self.exclude):
                    continue
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith("__"):
                        out.append(("dir", rel, 0))
                elif e.name.endswith(self.suffixes):
                    try:
                        out.append(("file", rel, e.stat().st_size))
                    except OSError:
                        out.append(("file", rel, 0))
        return out

    def rows(self, rel: str):
        """The rows of a file; OSError and UnicodeDecodeError are the caller's."""
        with open(os.path.join(self.root, rel), "rb") as fh:
            raw = fh.read()
        text = raw.decode("utf-8")
        if not self.chunk_bytes or len(raw) <= self.chunk_bytes:
            yield (self.project, rel, text, len(raw), 0, 0)
            return
        start, chunk, offset, n = 0, 0, 0, len(text)
        while start < n:  # pieces of about chunk_bytes characters, cut at line ends
            end = min(n, start + self.chunk_bytes)
            if end < n:
                nl = text.rfind("\n", start, end)
                end = nl + 1 if nl >= start else (text.find("\n", end) + 1 or n)
            piece = text[start:end]
            yield (self.project, rel, piece, len(raw), chunk, offset)
            offset += piece.count("\n")
            chunk += 1
            start = end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.tree = TreeOptions(options)

    def partitions(self):
        """The files of the root, and each of its directories."""
        return [_Part("", False)] + [_Part(rel, True) for kind, rel, _ in self.tree.entries("") if kind == "dir"]

    def read(self, partition: _Part):
        most = self.tree.max_depth
        todo = [(partition.rel, int(partition.is_dir))]
        while todo:
            rel_dir, depth = todo.pop()
            if most is not None and depth > most:
                continue
            try:
                found = self.tree.entries(rel_dir)
            except OSError:
                continue  # rows of tree_errors
            for kind, rel, _ in found:
                if kind == "dir":
                    if partition.is_dir:
                        todo.append((rel, depth + 1))
                    continue
                try:
                    yield from self.tree.rows(rel)
                except (OSError, UnicodeDecodeError):
                    continue  # unreadable or not UTF-8: skipped, as the reference does


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)


def _options(root: str, options: dict) -> TreeOptions:
    given = {k: "" if v is None else (",".join(v) if isinstance(v, (list, tuple)) else str(v)) for k, v in options.items()}
    return TreeOptions({**given, "path": root})


LISTED = "kind string, path string, size long, error string"


def list_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """``(kind, path, size, error)``: directories and files below ``root``, and
    an ``error`` row for each directory that could not be listed."""
    from ..session import checkpoint_dir

    tree = _options(root, options)
    if not os.path.isdir(tree.root):
        raise FileNotFoundError(f"no directory {tree.root}")
    checkpoint_dir(spark)

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for rel in batch.column(0).to_pylist():
                try:
                    rows += [(kind, path, size, None) for kind, path, size in tree.entries(rel)]
                except OSError as e:
                    rows.append(("error", rel, None, f"{type(e).__name__}: {e.strerror}"))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["kind", "path", "size", "error"])

    found = spark.createDataFrame([("dir", "", 0, None)], LISTED)
    levels, depth = [found], 0
    while tree.max_depth is None or depth <= tree.max_depth:
        open_ = levels[-1].where("kind = 'dir'").select("path")
        if open_.isEmpty():
            break
        dealt = open_.repartition(tree.target_partitions, "path") if depth else open_
        levels.append(dealt.mapInArrow(listed, LISTED).checkpoint())  # listed once, in the shared folder
        depth += 1
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("path != '' or kind = 'error'")


def _contents(files: DataFrame, tree: TreeOptions, errors: bool) -> DataFrame:
    kinds = "path string, size long, error string" if errors else SCHEMA

    def read(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.string()] if errors else [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in kinds.split(", ")]
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                try:
                    rows = list(tree.rows(rel)) if not errors else [None for _ in tree.rows(rel)][:0]
                except (OSError, UnicodeDecodeError) as e:
                    rows = [(rel, None, f"{type(e).__name__}: {getattr(e, 'strerror', None) or e.reason}")] if errors else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("path").repartition(tree.target_partitions, "path").mapInArrow(read, kinds)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files below ``root`` as ``(project, path, text, size, chunk,
    line_offset)``; files that are no UTF-8 or cannot be read are left out."""
    return _contents(list_tree(spark, root, **options).where("kind = 'file'"), _options(root, options), errors=False)


def tree_errors(spark: SparkSession, root: str, **options) -> DataFrame:
    """``(path, error)`` of the directories that could not be listed and the
    files that could not be read or are no UTF-8."""
    listed = list_tree(spark, root, **options)
    unread = _contents(listed.where("kind = 'file'"), _options(root, options), errors=True).select("path", "error")
    return listed.where("kind = 'error'").select("path", "error").unionByName(unread)
