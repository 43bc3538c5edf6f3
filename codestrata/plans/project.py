"""Whole-project analysis (C10) and code-generation context.

Both return DataFrames (or a dict of them) -- nothing is collected. The
parsed corpus is persisted once because every report reads it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import docs as H
from ..operators import extract as X
from ..operators import graph as G
from ..operators import packages as P
from ..operators.joins import by_merge


def analyze_project(
    files: DataFrame,
    exclude_patterns: list[str] | None = None,
    max_depth: int | None = None,
    include_graph: bool = True,
    include_cycles: bool = True,
    include_cross_refs: bool = False,
    rules=None,
) -> dict[str, DataFrame]:
    """``{files, summary, dependencies[, edges][, adjacency][, cycles][, cross_references]}``.

    ``files(project, path, text)``; exclusion globs match any path component
    (hidden components are then skipped too); ``max_depth`` counts
    directories below the project root. ``rules`` (e.g. ``"default"``)
    adds lint ``findings`` computed in the same parse."""
    f = files
    if exclude_patterns:
        from ..functions.text import glob_to_regex

        rx = "|".join(f"(?:{glob_to_regex(p)})" for p in exclude_patterns)
        f = f.where(~F.exists(F.split("path", "/"), lambda c: c.rlike(rx) | c.startswith(".")))
    if max_depth is not None:
        f = f.where(F.size(F.split("path", "/")) - 1 <= max_depth)
    f = f.where(F.col("path").endswith(".py") | F.col("path").endswith(".pyi"))
    a = X.analyze_files(f.withColumn("n_lines", G.line_count(F.col("text"))), carry=["n_lines"], rules=rules).persist(StorageLevel.MEMORY_AND_DISK)
    out = {
        "files": G.file_rows(f, a),
        "summary": G.project_rollup(f, a),
        "dependencies": G.dependency_classes(a),
        "analysis": a,
    }
    if include_graph or include_cycles:
        edges = G.import_edges(a)
        if include_graph:
            out["edges"] = edges
            out["adjacency"] = G.import_adjacency(a, edges)
        if include_cycles:
            out["cycles"] = G.circular_dependencies(edges, by_component=None)
    if include_cross_refs:
        out["cross_references"] = G.cross_references(a, max_hits=20)
    if rules is not None:
        out["findings"] = X.findings(a)
    return out


# List lengths kept per budget.
BUDGET_LISTS = {
    "short": {"parameters": 5, "examples": 1, "related": 3},
    "medium": {"parameters": 15, "examples": 2, "raises": 5, "related": 5, "methods": 15, "attributes": 10},
}
GOALS = tuple(sorted(H.GOAL_FIELDS))
BUDGETS = ("short", "medium", "full")


def _mode(value, name: str, allowed: tuple[str, ...]):
    """Lower-cased and trimmed; anything not allowed is an error."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(F.raise_error(F.lit(f"{name} must be one of: {', '.join(allowed)}")))


def _focus(docs: DataFrame, goal, budget):
    """The record's fields that the goal keeps, lists cut as the budget says."""
    fields = []
    for c in docs.columns:
        value = F.col(f"doc.{c}")
        for mode, lists in BUDGET_LISTS.items():
            if c in lists:
                value = F.when(budget == mode, F.slice(F.col(f"doc.{c}"), 1, lists[c])).otherwise(value)
        kept = [g for g, names in H.GOAL_FIELDS.items() if c in names]
        keep = goal.isin(*kept) if kept else F.lit(False)
        if c in ("source_file", "methods", "attributes"):
            keep = keep & (budget != "short")
        fields.append(F.when(keep, value).alias(c))
    return F.when(F.col("doc").isNotNull(), F.struct(*fields))


def codegen_context(requests: DataFrame, docs: DataFrame, packages: DataFrame, current_python: str = "3.13") -> DataFrame:
    """One row per request, with the object's documentation (H1) as budget
    and goal keep it, its package (I2), version check (I10), import resolution
    (I6), Python check (I11), install command (I13), warnings and
    recommendations; ``is_compatible`` means no warnings.

    ``requests(request_id, env, object_name)`` may have ``project`` (whose
    index answers; without it the first project that knows the name),
    ``package_name``, ``import_name``, ``manager`` (of I12), ``min_python``,
    ``package_version_spec``, ``budget`` (medium) and ``task_goal``
    (implementation). Other budgets or goals are errors."""
    given = set(requests.columns)

    def option(name, default=None):
        asked = F.col(name) if name in given else F.lit(None).cast("string")
        return (F.coalesce(asked, F.lit(default)) if default else asked).alias(name)

    own = ["project"] if "project" in given else []
    options = [option("package_name"), option("import_name"), option("manager", "pip"), option("min_python"), option("package_version_spec")]
    r = requests.select(
        "request_id", "env", "object_name", *own, *options,
        _mode(option("budget", "medium"), "budget", BUDGETS).alias("budget"),
        _mode(option("task_goal", "implementation"), "task_goal", GOALS).alias("task_goal"),
    ).withColumn("target", F.coalesce("package_name", P.derive_package(F.col("object_name"))))

    known = docs.groupBy(*own, F.col("name").alias("object_name")).agg(F.min_by(F.struct(*docs.columns), F.struct(*[c for c in ("project", "source_file") if c in docs.columns] or ["name"])).alias("doc"))
    pk = packages.groupBy("env", F.lower("name").alias("_k")).agg(F.min_by(F.struct(F.col("name").alias("pkg"), F.col("version").alias("pkg_version")), "name").alias("p"))
    if "import_names" not in packages.columns:
        packages = packages.withColumn("import_names", F.array().cast("array<string>"))
    imports = P.find_package_by_import(packages, r.where(F.col("import_name").isNotNull()).select("env", "import_name").distinct())
    j = r.join(by_merge(known), [*own, "object_name"], "left").withColumn("_k", F.lower("target")).join(by_merge(pk), ["env", "_k"], "left").drop("_k")
    j = j.join(by_merge(imports.withColumnRenamed("package", "resolved_package")), ["env", "import_name"], "left")
    spec = P.check_spec(j.select("request_id", F.col("p.pkg_version").alias("version"), F.col("package_version_spec").alias("spec")))
    j = j.join(by_merge(spec.select("request_id", F.col("compatible").alias("version_ok"), "details")), "request_id", "left")

    python_ok = P.python_check(F.col("min_python"), F.lit(current_python))
    missing = F.col("target").isNotNull() & F.col("p").isNull()
    none = F.array().cast("array<string>")

    def note(condition, *parts):
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        return F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(none)

    quoted = F.concat(F.lit("'"), F.col("target"), F.lit("'"))
    resolved = F.col("resolved_package")
    warnings = F.concat(
        note(F.col("object_name").isNotNull() & F.col("doc").isNull(), "Object '", F.col("object_name"), "' is not importable in the local environment"),
        F.when(F.col("p").isNotNull() & ~F.coalesce(F.col("version_ok"), F.lit(True)), F.col("details")).otherwise(none),
        note(missing, "Package ", quoted, " is not installed in the local runtime"),
        note(F.col("import_name").isNotNull() & resolved.isNull(), "Import '", F.col("import_name"), "' does not map to any installed package"),
        note(F.lower(resolved) != F.lower("target"), "Import '", F.col("import_name"), "' resolves to '", resolved, "', not ", quoted),
        note(F.col("min_python").isNotNull() & ~F.coalesce(python_ok, F.lit(False)), f"Current Python {current_python} is below required minimum ", F.col("min_python")),
    )
    j = j.withColumn("warnings", warnings).withColumn("install_command", F.when(missing, P.install_command(F.col("manager"), F.col("target"))))
    # The advice texts.
    advice = (
        F.when(F.col("task_goal") == "debugging", "Prioritize raises/source metadata to isolate the failing call path")
        .when(F.col("task_goal") == "testing", "Use parameters, return type, and raises data to derive test assertions")
        .when(F.col("task_goal") == "refactor", "Use related symbols and methods to preserve behavior during refactors")
        .otherwise("Use the returned signature and parameters exactly when generating code")
    )
    recommendations = F.concat(
        note(F.col("doc").isNotNull(), advice),
        note(missing, "Ask the user to run '", F.col("install_command"), "' before using ", F.col("target")),
        note(F.col("p").isNotNull(), "Target installed package version ", F.col("p.pkg_version"), " for API compatibility"),
        note(F.size("warnings") == 0, "No compatibility blockers detected for the current request"),
    )
    return j.select(
        "request_id", *own, "object_name", F.col("doc").isNotNull().alias("found"), F.col("p.pkg").alias("package"), F.col("p.pkg_version").alias("version"),
        F.col("doc.import_statement").alias("import_statement"), F.col("doc.signature").alias("signature"), "resolved_package", "install_command",
        "warnings", (F.size("warnings") == 0).alias("is_compatible"), recommendations.alias("recommendations"), "budget", "task_goal",
        _focus(docs, F.col("task_goal"), F.col("budget")).alias("docs"),
    )
