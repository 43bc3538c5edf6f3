"""Package inventory and compatibility (I1-I15) and doc-index freshness
(J1-J6), as column expressions and joins over inventory snapshots.

``packages(env, name, version, import_names, requires, files, top_level)`` is
one row per installed distribution per environment (many environments at
once). Request tables are joined, never looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import by_merge

VERSION_RE = r"\d+(?:\.\d+){0,3}"
# Roots of dotted names that are no packages.
BUILTIN_TYPES = ("str", "int", "float", "bool", "list", "dict", "set", "tuple")

# Install command per package manager.
INSTALL_COMMANDS = {"uv": "uv add {}", "poetry": "poetry add {}", "pipenv": "pipenv install {}", "pip": "pip install {}"}


# ---------------------------------------------------------------------------
# I1-I8 inventory
# ---------------------------------------------------------------------------


def import_names(top_level: Column, files: Column, name: Column) -> Column:
    """``top_level.txt`` lines; else first path components of installed
    files (``.py`` removed; metadata dirs, ``_*``, tests/test/docs skipped),
    sorted; else the normalised distribution name. All of them, because imports
    are looked up here; a report shows the first few (the reference 5)."""
    tl = F.filter(F.transform(F.split(F.coalesce(F.trim(top_level), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    firsts = F.transform(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.split(f, "/").getItem(0))
    keep = F.filter(
        firsts,
        lambda p: ~p.endswith(".dist-info") & ~p.endswith(".egg-info"),
    )
    names = F.filter(F.transform(keep, lambda p: F.replace(p, F.lit(".py"), F.lit(""))), lambda n: (n != "") & ~n.startswith("_") & ~n.isin("tests", "test", "docs"))
    from_files = F.array_sort(F.array_distinct(names))
    fallback = F.when(F.coalesce(name, F.lit("")) != "", F.array(F.lower(F.replace(name, F.lit("-"), F.lit("_"))))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tl) > 0, tl).when(F.size(from_files) > 0, from_files).otherwise(fallback)


def dependency_names(requires: Column, limit: int | None = None) -> Column:
    """I4: requirement names, cut at the first ``; [ < > = ! ~ (`` or space
    (the reference does not cut at ``~``: ``a~=1`` gives ``a~``); ``limit`` is
    for reports (the reference shows 20)."""
    names = F.transform(F.coalesce(requires, F.array().cast("array<string>")), lambda r: F.trim(F.regexp_extract(r, r"^[^;\[<>=!~( ]*", 0)))
    names = F.filter(names, lambda n: n != "")
    return F.slice(names, 1, limit) if limit else names


def normalise(packages: DataFrame) -> DataFrame:
    """Adds ``import_names`` (when empty) and ``dependencies``."""
    return packages.withColumn(
        "import_names",
        F.when(F.size(F.coalesce("import_names", F.array().cast("array<string>"))) > 0, F.col("import_names")).otherwise(
            import_names(F.col("top_level"), F.col("files"), F.col("name"))
        ),
    ).withColumn("dependencies", dependency_names(F.col("requires")))


def package_list(packages: DataFrame) -> DataFrame:
    """``(env, name, version)`` sorted by name."""
    return packages.select("env", "name", "version").orderBy("env", F.lower("name"), "name")


def inventory(packages: DataFrame) -> DataFrame:
    """Per environment package count and inventory fingerprint; the
    package rows themselves stay rows (``package_list``), so no environment
    is ever gathered into one value."""
    return packages.groupBy("env").agg(F.count("*").cast("long").alias("package_count"))


def package_details(packages: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(env, request)`` left-joined case-insensitively;
    ``installed`` tells whether a package was found; the first match in name
    order wins."""
    p = packages.select("env", F.lower("name").alias("_k"), F.struct(*packages.columns).alias("pkg"))
    first = p.groupBy("env", "_k").agg(F.min_by("pkg", F.col("pkg.name")).alias("pkg"))
    r = requests.withColumn("_k", F.lower("request"))
    return r.join(by_merge(first), ["env", "_k"], "left").select("env", "request", F.col("pkg.name").isNotNull().alias("installed"), "pkg").drop("_k")


def import_to_package(packages: DataFrame) -> DataFrame:
    """I6 lookup table: ``(env, import_name, package)``; case-insensitive key
    ``import_key``; first package in name order per key."""
    e = packages.select("env", "name", F.explode("import_names").alias("import_name"))
    return e.groupBy("env", F.lower("import_name").alias("import_key")).agg(
        F.min_by("import_name", "name").alias("import_name"), F.min("name").alias("package")
    )


def find_package_by_import(packages: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(env, import_name)`` -> package, exact match first then
    case-insensitive."""
    e = packages.select("env", "name", F.explode("import_names").alias("imp"))
    exact = e.groupBy("env", F.col("imp").alias("import_name")).agg(F.min("name").alias("exact_pkg"))
    ci = e.groupBy("env", F.lower("imp").alias("_k")).agg(F.min("name").alias("ci_pkg"))
    r = requests.withColumn("_k", F.lower("import_name"))
    return (
        r.join(by_merge(exact), ["env", "import_name"], "left")
        .join(by_merge(ci), ["env", "_k"], "left")
        .select("env", "import_name", F.coalesce("exact_pkg", "ci_pkg").alias("package"))
    )


def main_exports(api_docs_exports: DataFrame, packages: DataFrame, limit: int | None = None) -> DataFrame:
    """I8: per package, module exports of its import names (static: from the
    API index, never by importing); ``limit`` is for reports (the reference
    shows 10)."""
    imp = packages.select("env", "name", F.explode("import_names").alias("module"))
    names = F.array_sort(F.flatten(F.collect_list(F.coalesce("exports", F.array().cast("array<string>")))))
    return imp.join(by_merge(api_docs_exports), "module", "left").groupBy("env", "name").agg((F.slice(names, 1, limit) if limit else names).alias("main_exports"))


def install_location(root: Column, files: Column) -> Column:
    """I8: the folder of a distribution's first installed file, below the
    environment's package folder ``root``; null without files."""
    first = F.get(files, F.lit(0))
    folder = F.regexp_replace(first, r"/?[^/]*$", "")
    return F.when(first.isNotNull(), F.when(folder == "", root).otherwise(F.concat_ws("/", root, folder)))


def install_instructions(packages: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(request_id, env, package, manager)`` -> whether the
    package is installed (names without case), in which version, a note, and
    the command of the project's manager (of :func:`detect_manager`)."""
    pk = packages.groupBy("env", F.lower("name").alias("_k")).agg(F.min_by("version", "name").alias("installed_version"), F.lit(True).alias("_there"))
    j = requests.withColumn("_k", F.lower("package")).join(by_merge(pk), ["env", "_k"], "left")
    there = F.coalesce("_there", F.lit(False))
    return j.select(
        "request_id", "package", there.alias("already_installed"), F.when(there, F.coalesce("installed_version", F.lit("unknown"))).alias("installed_version"),
        F.when(there, F.concat(F.lit("'"), F.col("package"), F.lit("' is already installed."))).alias("note"),
        F.col("manager").alias("detected_package_manager"), install_command(F.col("manager"), F.col("package")).alias("install_command"),
    )


# ---------------------------------------------------------------------------
# I9-I15 compatibility
# ---------------------------------------------------------------------------


def parse_version(v: Column) -> Column:
    """First ``\\d+(\\.\\d+){0,3}`` as ``array<int>`` padded with zeros to
    four parts (padding makes lexicographic array order the version order);
    NULL when there is none."""
    m = F.regexp_extract(F.coalesce(v, F.lit("")), VERSION_RE, 0)
    parts = F.transform(F.split(m, r"\."), lambda x: x.try_cast("bigint"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), 4)), 1, 4)
    return F.when(m != "", padded)


def compare_versions(a: Column, b: Column) -> Column:
    """-1/0/1 of two parsed versions."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def check_spec(requests: DataFrame, version_col: str = "version", spec_col: str = "spec", key: tuple = ("request_id",)) -> DataFrame:
    """Comma-separated clauses AND-ed; ``>= <= == != > <``. Unsupported
    clause, missing or unparseable version make the result incompatible with a
    message. Output ``(*key, compatible, details array<string>)``."""
    cur = F.col(version_col)
    base = requests.select(*key, cur.alias("_cur"), F.col(spec_col).alias("_spec"))
    clauses = base.select(
        *key, "_cur", "_spec", F.explode_outer(F.filter(F.transform(F.split(F.coalesce("_spec", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")).alias("clause")
    )
    op = F.regexp_extract("clause", r"^(>=|<=|==|!=|>|<)\s*(.+)$", 1)
    rhs = F.regexp_extract("clause", r"^(>=|<=|==|!=|>|<)\s*(.+)$", 2)
    cv, rv = parse_version(F.col("_cur")), parse_version(rhs)
    c = compare_versions(cv, rv)
    ok = (
        F.when(op == ">", c > 0).when(op == ">=", c >= 0).when(op == "<", c < 0).when(op == "<=", c <= 0).when(op == "==", c == 0).when(op == "!=", c != 0)
    )
    detail = (
        F.when(F.col("clause").isNull(), F.lit(None))
        .when(F.coalesce(F.col("_cur"), F.lit("")) == "", F.lit("Current package version unavailable for compatibility check"))
        .when(cv.isNull(), F.concat(F.lit("Unable to parse current version '"), F.col("_cur"), F.lit("'")))
        .when(op == "", F.concat(F.lit("Unsupported version clause '"), F.col("clause"), F.lit("'")))
        .when(rv.isNull(), F.concat(F.lit("Unable to parse version in clause '"), F.col("clause"), F.lit("'")))
        .when(~ok, F.concat(F.lit("Installed version "), F.col("_cur"), F.lit(" does not satisfy '"), F.col("clause"), F.lit("'")))
    )
    per = clauses.withColumn("detail", detail)
    return per.groupBy(*key).agg(
        F.first("_spec").alias("spec"),
        F.first("_cur").alias("current"),
        (F.count_if(F.col("detail").isNotNull()) == 0).alias("compatible"),
        F.array_distinct(F.collect_list("detail")).alias("details"),
    ).withColumn("checked", F.coalesce(F.col("spec"), F.lit("")) != "")


def python_check(min_python: Column, current_python: Column) -> Column:
    """Current interpreter version >= the requested minimum."""
    return compare_versions(parse_version(current_python), parse_version(min_python)) >= 0


def detect_manager(markers: DataFrame, requests: DataFrame, max_levels: int = 10) -> DataFrame:
    """``markers(dir, file, text)`` and ``requests(request_id, dir)``.
    Walk up to ``max_levels`` ancestors; per level uv.lock > poetry.lock >
    Pipfile > pyproject ``[tool.poetry]`` > ``[tool.uv]``; nearest level wins;
    default ``pip``."""
    kind = (
        F.when(F.col("file") == "uv.lock", F.struct(F.lit(0).alias("p"), F.lit("uv").alias("m")))
        .when(F.col("file") == "poetry.lock", F.struct(F.lit(1).alias("p"), F.lit("poetry").alias("m")))
        .when(F.col("file") == "Pipfile", F.struct(F.lit(2).alias("p"), F.lit("pipenv").alias("m")))
        .when((F.col("file") == "pyproject.toml") & F.col("text").contains("[tool.poetry]"), F.struct(F.lit(3).alias("p"), F.lit("poetry").alias("m")))
        .when((F.col("file") == "pyproject.toml") & F.col("text").contains("[tool.uv]"), F.struct(F.lit(4).alias("p"), F.lit("uv").alias("m")))
    )
    # one best marker per folder first: folders may hold any number of files
    mk = markers.select("dir", kind.alias("k")).where(F.col("k").isNotNull()).groupBy("dir").agg(F.min("k").alias("k"))
    parts = F.split(F.col("dir"), "/")
    anc = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts), F.lit(max_levels - 1))),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, F.size(parts) - i), "/").alias("dir")),
    )
    levels = requests.select("request_id", F.explode(anc).alias("a")).select("request_id", F.col("a.depth").alias("depth"), F.col("a.dir").alias("dir"))
    hit = levels.join(by_merge(mk), "dir").groupBy("request_id").agg(F.min_by("k.m", F.struct("depth", "k.p")).alias("manager"))
    return requests.join(by_merge(hit), "request_id", "left").withColumn("manager", F.coalesce("manager", F.lit("pip")))


def install_command(manager: Column, package: Column) -> Column:
    """I13."""
    out = F.concat(F.lit("pip install "), package)
    for m, tpl in INSTALL_COMMANDS.items():
        pre = tpl.replace("{}", "")
        out = F.when(manager == m, F.concat(F.lit(pre), package)).otherwise(out)
    return out


def derive_package(object_name: Column) -> Column:
    """First component of a dotted name; NULL for undotted names and
    builtin types."""
    first = F.split(object_name, r"\.").getItem(0)
    return F.when(object_name.contains(".") & ~first.isin(*BUILTIN_TYPES), first)


def import_audit(file_imports: DataFrame, lookup: DataFrame, stdlib: Column) -> DataFrame:
    """For each imported top-level module, whether it resolves to an
    installed package (via I6), to the standard library, or to nothing. With a
    column ``expected`` (the package a caller means) an import that another
    package provides is ``other-package``."""
    own = ["expected"] if "expected" in file_imports.columns else []
    tops = file_imports.select("env", "path", *own, F.split("module", r"\.").getItem(0).alias("top")).distinct()
    j = tops.join(by_merge(lookup.select("env", F.col("import_key"), "package")), (tops.env == lookup.env) & (F.lower(tops.top) == lookup.import_key), "left")
    other = F.lower("package") != F.lower("expected") if own else F.lit(False)
    return j.select(
        tops.env, "path", *own, "top", "package",
        F.when(F.array_contains(stdlib, F.col("top")), "stdlib").when(other, "other-package").when(F.col("package").isNotNull(), "installed").otherwise("missing").alias("status"),
    )


# ---------------------------------------------------------------------------
# J doc-index freshness
# ---------------------------------------------------------------------------


def inventory_fingerprint(packages: DataFrame, key: str = "env") -> DataFrame:
    """sha256 of the JSON text of the sorted ``[name, version]`` pairs,
    first 16 hex digits (ASCII names)."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "version")))
    js = F.concat(
        F.lit("["),
        F.array_join(F.transform(pairs, lambda x: F.concat(F.lit('["'), x["name"], F.lit('", "'), x["version"], F.lit('"]'))), ", "),
        F.lit("]"),
    )
    return packages.groupBy(key).agg(F.substring(F.sha2(js, 256), 1, 16).alias("fingerprint"), F.count("*").cast("long").alias("packages_count"))


def stale_inventories(old: DataFrame, new: DataFrame, key: str = "env") -> DataFrame:
    """Environments whose fingerprint changed (or appeared/disappeared)."""
    a = inventory_fingerprint(old, key).withColumnRenamed("fingerprint", "old_fp").drop("packages_count")
    b = inventory_fingerprint(new, key).withColumnRenamed("fingerprint", "new_fp").drop("packages_count")
    return a.join(b, key, "full_outer").select(key, "old_fp", "new_fp", (~F.col("old_fp").eqNullSafe(F.col("new_fp"))).alias("stale"))


#: Name ranges of an environment.
RANGES = 1024


def _entry_sums(name: Column, version: Column) -> list[Column]:
    """Two sums over an entry's SHA-256, whatever the order of the entries."""
    said = F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, F.lit("="), F.coalesce(version, F.lit("-"))), 256)
    return [F.sum(F.conv(F.substring(said, at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for at in (1, 16)]


def name_range(name: Column, ranges: int = RANGES) -> Column:
    """The range of a name, by its hash."""
    return (F.conv(F.substring(F.sha2(name, 256), 57, 8), 16, 10).cast("bigint") % ranges).cast("long")


def range_digests(packages: DataFrame, key: str = "env", ranges: int = RANGES) -> DataFrame:
    """J1, lower level: ``(key, range, digest, n)``. A range's digest comes from
    sums over its entries' hashes, so tasks add up before the shuffle and no
    value grows with the inventory."""
    low, high = _entry_sums(F.col("name"), F.col("version"))
    sums = packages.groupBy(key, name_range(F.col("name"), ranges).alias("range")).agg(low.alias("a"), high.alias("b"), F.count("*").alias("n"))
    said = F.concat_ws(",", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select(key, "range", F.sha2(said, 256).alias("digest"), "n")


def inventory_digest(packages: DataFrame, key: str = "env", ranges: int = RANGES) -> DataFrame:
    """J1 at any size: 16 digits of the SHA-256 over an environment's range
    digests (at most ``ranges`` of them). Like :func:`inventory_fingerprint` it
    changes with any name or version, but it is not that hash of the whole list,
    which would gather an inventory into one value."""
    d = range_digests(packages, key, ranges)
    per = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("range", "digest"))).alias("r"), F.sum("n").cast("long").alias("packages_count"))
    said = F.array_join(F.transform("r", lambda x: F.concat(x["range"].cast("string"), F.lit(":"), x["digest"])), ",")
    return per.select(key, F.substring(F.sha2(said, 256), 1, 16).alias("fingerprint"), "packages_count")


def inventory_changes(old: DataFrame, new: DataFrame, key: str = "env", ranges: int = RANGES) -> DataFrame:
    """J2 in detail: ``(key, name, old_version, new_version, change)``. Digests
    tell which ranges differ, and only their entries are compared. Repeated
    entries of a name are compared as a sorted list."""
    a, b = range_digests(old, key, ranges), range_digests(new, key, ranges)
    same = b.select(key, "range", F.col("digest").alias("other"))
    unlike = a.join(same, [key, "range"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select(key, "range")

    def entries(packages: DataFrame, version: str) -> DataFrame:
        own = packages.select(key, "name", "version", name_range(F.col("name"), ranges).alias("range")).join(unlike, [key, "range"], "left_semi")
        return own.groupBy(key, "name").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("version", F.lit("-")))), ",").alias(version))

    both = entries(old, "old_version").join(by_merge(entries(new, "new_version")), [key, "name"], "full_outer")
    change = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old_version").eqNullSafe(F.col("new_version"))).select(key, "name", "old_version", "new_version", change.alias("change"))


def refresh(old: DataFrame, new: DataFrame, doc_index: DataFrame, key: str = "env") -> DataFrame:
    """Per environment: added/removed/changed packages and, when the
    inventory changed at all, the number of doc entries invalidated."""
    o = old.select(key, "name", F.col("version").alias("old_v"))
    n = new.select(key, "name", F.col("version").alias("new_v"))
    diff = o.join(by_merge(n), [key, "name"], "full_outer").groupBy(key).agg(
        F.count_if(F.col("old_v").isNull()).cast("long").alias("added"),
        F.count_if(F.col("new_v").isNull()).cast("long").alias("removed"),
        F.count_if(F.col("old_v").isNotNull() & F.col("new_v").isNotNull() & (F.col("old_v") != F.col("new_v"))).cast("long").alias("changed"),
    )
    docs = doc_index.groupBy(key).agg(F.count("*").cast("long").alias("docs"))
    return diff.join(docs, key, "left").select(
        key, "added", "removed", "changed",
        F.when(F.col("added") + F.col("removed") + F.col("changed") > 0, F.coalesce("docs", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("evicted"),
    )


def doc_freshness(doc_index: DataFrame, packages: DataFrame, now: Column, ttl_hours: int = 168, key: str = "env") -> DataFrame:
    """Hit unless the entry's package has a known current version that
    differs from the cached one (NULL cached version counts as different), or
    the entry is older than the TTL."""
    cur = packages.select(key, F.col("name").alias("package"), F.col("version").alias("current_version"))
    j = doc_index.join(by_merge(cur), [key, "package"], "left")
    stale_version = F.col("package").isNotNull() & F.col("current_version").isNotNull() & ~F.col("package_version").eqNullSafe(F.col("current_version"))
    expired = F.col("cached_at").isNotNull() & (F.col("cached_at") < now - F.expr(f"INTERVAL {int(ttl_hours)} HOURS"))
    status = F.when(stale_version, "stale_version").when(expired, "expired").otherwise("hit")
    # the hit counter rises before the TTL test: expired entries still count
    # the lookup, stale versions do not
    return j.withColumn("status", status).withColumn(
        "hit_count_after", F.col("hit_count") + F.when(F.col("status") == "stale_version", 0).otherwise(1)
    )


def lfu_victims(doc_index: DataFrame, key: str = "env", max_entries: int = 500, count: int = 50) -> DataFrame:
    """In every index holding at least ``max_entries`` entries, the
    ``count`` entries with the fewest hits, ties by insertion time then name.
    Skew-safe top-k per index."""
    from ..plans.topk import top_k_per_group

    sizes = doc_index.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= max_entries).select(key)
    full = doc_index.join(sizes, key, "left_semi")
    return top_k_per_group(full, [key], ["hit_count", "cached_at", "name"], count).drop("rank")


def cache_stats(lookups: DataFrame, key: str = "env") -> DataFrame:
    """Hits, misses, evictions (from a lookup log with ``status`` of
    hit / miss / stale_version / expired / evicted) and entry count."""
    st = F.col("status")
    return lookups.groupBy(key).agg(
        F.count_if(st == "hit").cast("long").alias("cache_hits"),
        F.count_if(st.isin("miss", "stale_version", "expired")).cast("long").alias("cache_misses"),
        F.count_if(st == "evicted").cast("long").alias("evictions"),
        F.countDistinct("name").cast("long").alias("entries"),
    )


def packages_from_metadata(files: DataFrame) -> DataFrame:
    """Distribution metadata files collected from many environments ->
    ``packages``. ``files(env, path, text)`` holds ``*.dist-info/METADATA``,
    ``top_level.txt`` and ``RECORD`` files; one group per (env, dist-info
    folder), so the work is a single aggregation."""
    dist = F.regexp_extract("path", r"([^/]+\.(?:dist|egg)-info)/[^/]+$", 1)
    kind = F.element_at(F.split("path", "/"), -1)
    f = files.where(dist != "").select("env", dist.alias("dist"), kind.alias("kind"), "text")
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    header = lambda key: F.filter(lines, lambda l: l.startswith(key + ": "))
    meta = f.where(F.col("kind") == "METADATA").select(
        "env", "dist",
        F.substring_index(F.element_at(header("Name"), 1), ": ", -1).alias("name"),
        F.substring_index(F.element_at(header("Version"), 1), ": ", -1).alias("version"),
        F.transform(header("Requires-Dist"), lambda l: F.regexp_replace(l, "^Requires-Dist: ", "")).alias("requires"),
    )
    top = f.where(F.col("kind") == "top_level.txt").select("env", "dist", F.col("text").alias("top_level"))
    rec = f.where(F.col("kind") == "RECORD").select(
        "env", "dist", F.filter(F.transform(lines, lambda l: F.split(l, ",").getItem(0)), lambda x: x != "").alias("files")
    )
    out = meta.join(by_merge(top), ["env", "dist"], "left").join(by_merge(rec), ["env", "dist"], "left")
    return normalise(
        out.select("env", "name", "version", F.array().cast("array<string>").alias("import_names"), "requires", "files", "top_level")
    )
