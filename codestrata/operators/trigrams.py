"""Trigram postings (D1, D7): an index that tells which files can match a
regular expression, so that a search reads only those.

``build_index`` writes two tables: the files, dealt into buckets (one folder
each), and the postings ``(gram, bucket, file)`` sorted by gram, so that a
lookup skips most of the table by its statistics. A gram is three neighbouring
characters of the folded text, a file the hash of its project and path: files
that share one are read together, and the search itself tells them apart.

A pattern gives clauses that every match satisfies: literal runs must be there
whole, of an alternation some branch. What cannot be told (classes, options,
lookarounds, syntax that is not understood) asks for nothing, so the answer is
always that of a scan; a pattern without clauses reads all files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search as S

BUCKETS = 256
#: Postings that a task hands on together.
TOGETHER = 100_000
#: An alternation with more ways than this asks for nothing.
WAYS = 16


def _grams(text: str):
    import numpy as np

    c = np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def grams_of(text: str) -> list[int]:
    """The distinct trigrams of a folded text, as numbers."""
    return _grams(text).tolist()


def _file() -> Column:
    return F.xxhash64("project", "path")


# ------------------------------------------------------------ what a pattern asks
Ways = list[frozenset[int]]  # one of these sets of grams must be there


def _run_grams(run: list[int], ignore_case: bool) -> frozenset[int]:
    out: set[int] = set()
    part = ""
    for c in [*run, None]:
        # letters with more than two case forms end a run when case is ignored
        if c is None or (ignore_case and (c > 127 or chr(c) in "iIkKsS")):
            out.update(grams_of(part))
            part = ""
        else:
            part += chr(c)
    return frozenset(out)


def _clauses(items, ignore_case: bool) -> list[Ways]:
    """Clauses of a sequence of parsed items."""
    from re import _constants as K

    out: list[Ways] = []
    run: list[int] = []

    def end() -> None:
        if grams := _run_grams(run, ignore_case):
            out.append([grams])
        run.clear()

    for op, arg in items:
        if op is K.LITERAL:
            run.append(arg)
        elif op is K.SUBPATTERN:
            _, on, off, inner = arg
            if on or off:
                end()
            elif all(o is K.LITERAL for o, _ in inner):
                run.extend(a for _, a in inner)
            else:
                end()
                out += _clauses(inner, ignore_case)
        elif op is K.BRANCH:
            end()
            ways: Ways = []
            for branch in arg[1]:
                own = _clauses(branch, ignore_case)
                single = [c[0] for c in own if len(c) == 1]
                if not single:
                    ways = []
                    break
                ways.append(frozenset().union(*single))
            if ways and len(ways) <= WAYS:
                out.append(ways)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            end()
            if arg[0] >= 1:
                out += _clauses(arg[2], ignore_case)
        else:
            end()
    end()
    return out


def required(pattern: str, case_sensitive: bool = True) -> list[Ways]:
    """Clauses (each a choice of gram sets) that a match of ``pattern`` needs."""
    if literal := S.literal_of(pattern):
        grams = _run_grams(list(map(ord, literal)), not case_sensitive)
        return [[grams]] if grams else []
    # forms that other regular expressions read differently
    if re.search(r"\\[vVhHRXpPQEGkKeco0-9N]|\(\?(?!:|=|!|<=|<!)|[*+?}]\+|&&|\(\*", pattern):
        return []
    try:
        from re import _parser

        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    return _clauses(list(parsed), not case_sensitive or bool(parsed.state.flags & re.IGNORECASE))


# ---------------------------------------------------------------------- the index
def build_index(files: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``files(project, path, text)`` below ``path``."""
    files.withColumn("bucket", F.pmod(_file(), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/files")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(held):
            size = [len(g) for _, g in held]
            columns = [np.concatenate([g for _, g in held]), np.repeat(np.array([f for f, _ in held], np.int64), size)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "file"])

        held, size = [], 0
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((file, _grams(text or "")))
                size += len(held[-1][1])
                if size > TOGETHER:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    postings = files.select(_file().alias("file"), "text").mapInArrow(run, "gram long, file long")
    # a frequent gram has a row for each file: the file keeps its rows apart
    dealt = postings.repartitionByRange("gram", "file").withColumn("bucket", F.pmod("file", F.lit(buckets)).cast("int"))
    dealt.sortWithinPartitions("gram", "bucket").write.parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, pattern: str, case_sensitive: bool = True) -> DataFrame | None:
    """``(bucket, file)`` of the files that can match; None if the pattern asks
    for nothing."""
    clauses = required(pattern, case_sensitive)
    if not clauses:
        return None
    grams = sorted(set().union(*(way for c in clauses for way in c)))
    met = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(grams))
    per = met.groupBy("bucket", "file").agg(F.collect_set("gram").alias("held"))  # at most the pattern's grams

    def has(way: frozenset[int]) -> Column:
        return F.size(F.array_intersect("held", F.array(*[F.lit(g) for g in sorted(way)]))) == len(way)

    good = F.lit(True)
    for ways in clauses:
        some = F.lit(False)
        for way in ways:
            some = some | has(way)
        good = good & some
    return per.where(good).select("bucket", "file")


def indexed_files(spark: SparkSession, path: str, pattern: str, case_sensitive: bool = True) -> DataFrame:
    """The files that can match. Only buckets that hold some are read: there are
    ``BUCKETS`` of them at most, so the driver may know them."""
    files = spark.read.parquet(f"{path}/files")
    found = candidates(spark, path, pattern, case_sensitive)
    if found is None:
        return files.drop("bucket")
    buckets = [r.bucket for r in found.select("bucket").distinct().collect()]
    return files.where(F.col("bucket").isin(buckets)).withColumn("file", _file()).join(found, ["bucket", "file"], "left_semi").drop("bucket", "file")


def search_index(spark: SparkSession, path: str, pattern: str, case_sensitive: bool = True, **how) -> DataFrame:
    """``search.search_text`` over the files that can match."""
    return S.search_text(indexed_files(spark, path, pattern, case_sensitive), pattern, case_sensitive=case_sensitive, **how)
