"""Project analytics and the import graph.

Edges come from the ``all_imports`` column of the extraction pass (every
import in the file, class bodies included). Locality is decided with two
left-semi joins against the module table, so nothing is collected to the
driver. Cycle detection walks a project's edges in one Python group; projects
too large for that are peeled of what reaches no cycle and cut into weakly
connected components (checkpointed rounds of joins) first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .extract import KEY_COLS, stdlib_array, top
from .joins import by_merge


def module_name(path: Column) -> Column:
    """``pkg/sub/mod.py`` -> ``pkg.sub.mod``; ``pkg/__init__.py`` -> ``pkg``.
    ``.pyi`` stubs map like ``.py`` (the reference turns them into ``...i``)."""
    no_ext = F.regexp_replace(path, r"\.pyi?$", "")
    no_init = F.regexp_replace(no_ext, r"(^|/)__init__$", "")
    return F.regexp_replace(no_init, "/", ".")


def modules(files: DataFrame) -> DataFrame:
    """``(project, path, module)`` of every Python file."""
    return files.select("project", "path", module_name(F.col("path")).alias("module"))


def local_modules(files: DataFrame) -> DataFrame:
    """C4: module names plus every ancestor package prefix, per project."""
    parts = F.split(module_name(F.col("path")), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return files.select("project", F.explode(prefixes).alias("module")).distinct()


def file_imports(analysis: DataFrame) -> DataFrame:
    """``(project, path, module, level, line)`` for every import anywhere in
    the file; from-imports without a module are dropped."""
    return analysis.select(*KEY_COLS, F.explode("all_imports").alias("i")).select(
        *KEY_COLS, "i.module", F.col("i.level").cast("long").alias("level"), F.col("i.line").cast("long").alias("line")
    )


def resolve_relative(path: Column, module: Column, level: Column) -> Column:
    """Absolute name of ``from <level dots><module> import ...`` in the file
    at ``path``: the file's package (the module itself for ``__init__``),
    minus ``level - 1`` trailing components, plus ``module``."""
    # the package of a file is its folder, for __init__ too
    folder = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    kept = F.slice(folder, 1, F.greatest(F.size(folder) - (level - 1), F.lit(0)).cast("int"))
    return F.array_join(F.filter(F.concat(kept, F.array(module)), lambda part: part != ""), ".")


def import_edges(analysis: DataFrame, resolve_relative_imports: bool = False) -> DataFrame:
    """Distinct ``(project, src, dst)`` module edges.

    An absolute import is kept when its first component or its full name is a
    local module (two left-semi joins, unioned); a relative import is always
    kept, with its module text unresolved unless ``resolve_relative_imports``
    turns it into the absolute module name.
    """
    local = local_modules(analysis.select(*KEY_COLS))
    imps = file_imports(analysis)
    if resolve_relative_imports:
        imps = imps.withColumn("module", F.when(F.col("level") > 0, resolve_relative(F.col("path"), F.col("module"), F.col("level"))).otherwise(F.col("module")))
    imps = imps.select("project", module_name(F.col("path")).alias("src"), F.col("module").alias("dst"), "level")
    absolute = imps.where(F.col("level") == 0)
    by_top = absolute.withColumn("t", top(F.col("dst"))).join(
        by_merge(local.withColumnRenamed("module", "t")), ["project", "t"], "left_semi"
    ).drop("t")
    by_full = absolute.join(by_merge(local.withColumnRenamed("module", "dst")), ["project", "dst"], "left_semi")
    relative = imps.where(F.col("level") > 0)
    return by_top.unionByName(by_full).unionByName(relative).select("project", "src", "dst").distinct()


def import_adjacency(analysis: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(project, module, deps array<string>)``: sorted distinct targets; every
    parsed-or-not readable module is a node, isolated ones get ``[]``."""
    edges = edges if edges is not None else import_edges(analysis)
    nodes = analysis.select("project", module_name(F.col("path")).alias("module")).distinct()
    agg = edges.groupBy("project", F.col("src").alias("module")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    return nodes.join(by_merge(agg), ["project", "module"], "left").select(
        "project", "module", F.coalesce("deps", F.array().cast("array<string>")).alias("deps")
    )


# ---------------------------------------------------------------------------
# C7 cycles
# ---------------------------------------------------------------------------

CYCLE_SCHEMA = T.StructType(
    [T.StructField("project", T.StringType()), T.StructField("cycle", T.ArrayType(T.StringType())), T.StructField("length", T.LongType())]
)


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (reliable, survives
    executor loss)."""
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _dfs_cycles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Back-edge cycles of one group's edges, DFS over sorted nodes and sorted
    neighbours; each cycle rotated to start at its smallest member and closed;
    duplicates dropped; self-loop -> ``[a, a]``."""
    import sys

    graph: dict[str, list[str]] = {}
    for s, d in zip(pdf["src"], pdf["dst"]):
        graph.setdefault(s, []).append(d)
    for s in graph:
        graph[s] = sorted(set(graph[s]))
    project = pdf["project"].iloc[0] if len(pdf) else None
    visited: set[str] = set()
    on_stack: dict[str, int] = {}
    path: list[str] = []
    seen: set[tuple] = set()
    out: list[list[str]] = []
    sys.setrecursionlimit(max(10000, sys.getrecursionlimit()))
    for root in sorted(graph):
        if root in visited:
            continue
        # iterative DFS: stack of (node, neighbour iterator)
        stack = [(root, iter(graph.get(root, [])))]
        visited.add(root)
        on_stack[root] = 0
        path.append(root)
        while stack:
            node, it = stack[-1]
            advanced = False
            for nb in it:
                if nb not in visited:
                    visited.add(nb)
                    on_stack[nb] = len(path)
                    path.append(nb)
                    stack.append((nb, iter(graph.get(nb, []))))
                    advanced = True
                    break
                if nb in on_stack:
                    cyc = path[on_stack[nb]:]
                    i = cyc.index(min(cyc))
                    norm = cyc[i:] + cyc[:i] + [cyc[i]]
                    key = tuple(norm)
                    if key not in seen:
                        seen.add(key)
                        out.append(norm)
            if not advanced:
                stack.pop()
                on_stack.pop(path.pop(), None)
    return pd.DataFrame(
        {
            "project": pd.Series([project] * len(out), dtype=object),
            "cycle": pd.Series(out, dtype=object),
            "length": pd.Series([len(c) - 1 for c in out], dtype="int64"),
        }
    )


def weak_components(edges: DataFrame) -> DataFrame:
    """``(project, node, root)``: the smallest module that a module hangs
    together with, whatever the direction of the imports. Large-star and
    small-star rounds (logarithmic in the longest chain), checkpointed."""
    cur = _checkpoint(edges.where("src != dst").select("project", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    state = None
    while True:
        both = cur.union(cur.select("project", F.col("b"), F.col("a")))
        low = both.groupBy("project", "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(by_merge(low), ["project", "a"]).where("b > a and b != m").select("project", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(by_merge(large.groupBy("project", "a").agg(F.min("b").alias("m"))), ["project", "a"])
        cur = _checkpoint(small.select("project", "a", F.col("m").alias("b")).union(small.where("b != m").select("project", F.col("b"), F.col("m"))).distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("project", "a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = cur.groupBy("project", "a").agg(F.min("b").alias("root"))
    return roots.union(cur.select("project", F.col("b"), F.col("b")).distinct()).toDF("project", "node", "root")


#: Edges that a project may have to be walked as one group.
WALKED = 200_000


def peel_sinks(edges: DataFrame, share: float = 0.1) -> DataFrame:
    """``edges`` without those into modules that import nothing (left), round
    by round: such modules reach no cycle, so a depth-first walk over the
    others meets the same back edges in the same order. A round is a semi-join;
    they end when one takes less than ``share`` of what is left, so a long chain
    does not cost a round a link."""
    cur = _checkpoint(edges.select("project", "src", "dst").distinct())
    n = cur.count()
    while n:
        kept = _checkpoint(cur.join(by_merge(cur.select("project", F.col("src").alias("dst")).distinct()), ["project", "dst"], "left_semi").select("project", "src", "dst"))
        left = kept.count()
        few = n - left < share * n
        cur, n = kept, left
        if few:
            break
    return cur


def circular_dependencies(edges: DataFrame, by_component: bool | None = False, component_buckets: int = 4096) -> DataFrame:
    """``(project, cycle array<string>, length)``, a depth-first walk over
    the sorted modules of each project.

    A project is a Python group of its (narrow) edges. With ``by_component``
    modules that reach no cycle are peeled off first and the rest is cut into
    weakly connected components, hashed into buckets: for very large projects.
    The walk never leaves a weak component, so the answer is the same either
    way, and no project's answer depends on another's size. With None, the
    projects of over ``WALKED`` edges go that way.
    """
    e = edges.select("project", "src", "dst").distinct()
    if by_component is None:
        e = _checkpoint(e)
        large = _checkpoint(e.groupBy("project").count().where(F.col("count") > WALKED).select("project"))
        if large.isEmpty():
            return circular_dependencies(e)
        return circular_dependencies(e.join(large, "project", "left_anti")).unionByName(circular_dependencies(e.join(large, "project", "left_semi"), True, component_buckets))
    if not by_component:
        return e.groupBy("project").applyInPandas(_dfs_cycles, CYCLE_SCHEMA)
    e = peel_sinks(e)
    roots = weak_components(e).withColumnsRenamed({"node": "src"})
    lab = e.join(by_merge(roots), ["project", "src"], "left")
    bucket = F.pmod(F.xxhash64(F.coalesce("root", "src")), F.lit(component_buckets)).alias("_b")
    return lab.groupBy("project", bucket).applyInPandas(lambda p: _dfs_cycles(p[["project", "src", "dst"]]), CYCLE_SCHEMA)


# ---------------------------------------------------------------------------
# C1, C2, C8, C9
# ---------------------------------------------------------------------------


def line_count(text: Column) -> Column:
    """Newline count + 1."""
    return (F.length(text) - F.length(F.regexp_replace(text, "\n", "")) + 1).cast("long")


def dependency_rows(analysis: DataFrame, with_local: bool = False) -> DataFrame:
    """C8 as rows: distinct ``(project, class, name)`` over level-0 import tops
    with class ``stdlib`` or ``third_party`` (local modules count as third
    party, as the reference does); ``with_local`` adds a ``local`` class."""
    imps = file_imports(analysis).where(F.col("level") == 0).select("project", top(F.col("module")).alias("name")).where(F.col("name") != "").distinct()
    std = F.array_contains(stdlib_array(), F.col("name"))
    cls = F.when(std, "stdlib").otherwise("third_party")
    if with_local:
        local = local_modules(analysis.select(*KEY_COLS)).withColumn("is_local", F.lit(True))
        imps = imps.join(by_merge(local.withColumnRenamed("module", "name")), ["project", "name"], "left")
        cls = F.when(std, "stdlib").when(F.col("is_local"), "local").otherwise("third_party")
    return imps.select("project", cls.alias("class"), "name")


def dependency_classes(analysis: DataFrame, with_local: bool = False) -> DataFrame:
    """C8 report form: ``(project, class, modules array<string>)``, sorted.
    The list per project is bounded by the distinct top-level module names
    it imports; use :func:`dependency_rows` to stay in row form."""
    return dependency_rows(analysis, with_local).groupBy("project", "class").agg(F.array_sort(F.collect_list("name")).alias("modules"))


def file_rows(files: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per-file report row. ``analysis`` must carry ``n_lines``."""
    from .extract import file_summary

    return file_summary(analysis, extra=("n_lines",))


def project_rollup(files: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per project: files discovered, parsed files, functions, classes,
    imports, lines (error files included) and dependency counts."""
    per_file = analysis.select(
        *KEY_COLS,
        "n_lines",
        F.col("error").isNotNull().alias("is_error"),
        F.size("functions").alias("nf"),
        F.size("classes").alias("nc"),
        (F.size("imports") + F.size("from_imports")).alias("ni"),
    )
    discovered = files.groupBy("project").agg(F.count("*").cast("long").alias("total_files"))
    stats = per_file.groupBy("project").agg(
        F.count_if(~F.col("is_error")).cast("long").alias("parsed_files"),
        F.count_if(F.col("is_error")).cast("long").alias("error_files"),
        F.sum("nf").cast("long").alias("total_functions"),
        F.sum("nc").cast("long").alias("total_classes"),
        F.sum("ni").cast("long").alias("total_imports"),
        F.sum("n_lines").cast("long").alias("total_lines"),
    )
    deps = dependency_rows(analysis).groupBy("project").agg(
        F.count_if(F.col("class") == "stdlib").cast("long").alias("stdlib_deps"),
        F.count_if(F.col("class") == "third_party").cast("long").alias("third_party_deps"),
    )
    return discovered.join(by_merge(stats), "project", "left").join(by_merge(deps), "project", "left").fillna(0, ["stdlib_deps", "third_party_deps"])


def cross_references(analysis: DataFrame, max_hits: int | None = None) -> DataFrame:
    """For every public module-level function/class name, the project's
    module-level symbols of that name (definitions and imports) as
    ``(project, name, module, line, type)``; a report may ask for the first
    ``max_hits`` per name in ``(module, line)`` order (the reference shows 20),
    by a skew-safe two-phase top-k."""
    from ..plans.topk import top_k_per_group

    syms = analysis.select("project", module_name(F.col("path")).alias("module"), F.explode("bindings").alias("b")).where(
        (F.col("b.scope_id") == 0) & F.col("b.kind").isin("function", "class", "import", "assign")
    ).select(
        "project", F.col("b.name").alias("name"), "module", F.col("b.line").cast("long").alias("line"), F.col("b.kind").alias("type")
    ).distinct()
    defs = syms.where(F.col("type").isin("function", "class") & ~F.col("name").startswith("_")).select("project", "name").distinct()
    hits = syms.join(by_merge(defs), ["project", "name"], "left_semi")
    return hits if max_hits is None else top_k_per_group(hits, ["project", "name"], ["module", "line", "type"], max_hits).drop("rank")
