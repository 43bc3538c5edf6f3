"""Registered package-inventory and doc-index queries (I, J) over views
derived from ``part`` (packages, markers) and ``events`` (doc lookups)."""

from pyspark.sql import functions as F

from ..operators import packages as P
from ..operators.joins import by_merge
from ..sources.tables import table
from .registry import query
from .sql_common import GEN, with_

SPECS = [">=10", ">=5,<20", "==10.3.1", "!=7.0", "~=1.0", ">abc", "<=25.12.4"]
_SPECS_SQL = ", ".join(f"'{s}'" for s in SPECS)
MARKER_FILES = ["uv.lock", "poetry.lock", "Pipfile", "pyproject.toml", "pyproject.toml", "setup.py"]
_MARKERS_SQL = ", ".join(f"'{s}'" for s in MARKER_FILES)


def packages_view(spark, sf_dir):
    """One distribution per part row, spread over four environments."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    under = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), k.cast("string"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), k.cast("string"))
    files = F.when(
        k % 3 == 1,
        F.array(F.concat(under, F.lit("/__init__.py")), F.lit("_priv/x.py"), F.lit("tests/t.py"), F.concat(name, F.lit(".dist-info/RECORD"))),
    ).otherwise(F.array().cast("array<string>"))
    requires = F.array(
        F.concat(F.lit("dep"), (k % 7).cast("string"), F.lit(">=1."), (k % 3).cast("string")),
        F.concat(F.lit("extra"), (k % 5).cast("string"), F.lit('[cli]; python_version>"3.8"')),
        F.concat(F.lit("tilde"), (k % 4).cast("string"), F.lit("~=2.0")),
    )
    pk = p.select(
        F.concat(F.lit("env"), (k % 4).cast("string")).alias("env"),
        name.alias("name"),
        F.concat_ws(".", F.col("p_size").cast("string"), (k % 13).cast("string"), (k % 5).cast("string")).alias("version"),
        F.array().cast("array<string>").alias("import_names"),
        requires.alias("requires"),
        files.alias("files"),
        F.when(k % 3 == 0, under).alias("top_level"),
        k.alias("k"),
    )
    return P.normalise(pk)


_PKG_CTE = """
pk AS (
  SELECT p_partkey AS k, 'env' || CAST(p_partkey % 4 AS VARCHAR) AS env,
         replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS name,
         CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 13 AS VARCHAR) || '.' || CAST(p_partkey % 5 AS VARCHAR) AS version,
         p_size AS v1, p_partkey % 13 AS v2, p_partkey % 5 AS v3,
         replace(p_name, ' ', '_') || CAST(p_partkey AS VARCHAR) AS under
  FROM part)
"""


@query("package_list", with_(_PKG_CTE) + "SELECT env, name, version FROM pk")
def package_list(spark, sf_dir):
    return P.package_list(packages_view(spark, sf_dir))


@query(
    "import_names",
    with_(_PKG_CTE)
    + "SELECT env, name, CASE WHEN k % 3 = 2 THEN lower(replace(name, '-', '_')) ELSE under END AS import_name FROM pk",
)
def import_names(spark, sf_dir):
    return packages_view(spark, sf_dir).select("env", "name", F.explode("import_names").alias("import_name"))


@query(
    "dependencies",
    with_(_PKG_CTE)
    + """SELECT env, name, 'dep' || CAST(k % 7 AS VARCHAR) AS dependency FROM pk
         UNION ALL SELECT env, name, 'extra' || CAST(k % 5 AS VARCHAR) FROM pk
         UNION ALL SELECT env, name, 'tilde' || CAST(k % 4 AS VARCHAR) FROM pk""",
)
def dependencies(spark, sf_dir):
    return packages_view(spark, sf_dir).select("env", "name", F.explode("dependencies").alias("dependency"))


@query(
    "import_to_package",
    with_(_PKG_CTE)
    + """, imp AS (SELECT env, name, CASE WHEN k % 3 = 2 THEN lower(replace(name, '-', '_')) ELSE under END AS import_name FROM pk)
         SELECT env, lower(import_name) AS import_key, min(name) AS package FROM imp GROUP BY ALL""",
)
def import_to_package(spark, sf_dir):
    return P.import_to_package(packages_view(spark, sf_dir)).select("env", "import_key", "package")


@query(
    "version_check",
    with_(_PKG_CTE)
    + f""", s AS (SELECT *, k % 7 AS si, ([{_SPECS_SQL}])[k % 7 + 1] AS spec FROM pk),
         c AS (SELECT k, spec, version,
                 CASE si WHEN 0 THEN v1 >= 10
                         WHEN 1 THEN v1 >= 5 AND v1 < 20
                         WHEN 2 THEN v1 = 10 AND v2 = 3 AND v3 = 1
                         WHEN 3 THEN NOT (v1 = 7 AND v2 = 0 AND v3 = 0)
                         WHEN 4 THEN false WHEN 5 THEN false
                         ELSE v1 < 25 OR (v1 = 25 AND (v2 < 12 OR (v2 = 12 AND v3 <= 4))) END AS compatible
               FROM s)
         SELECT k AS request_id, spec, version AS current, compatible, CAST(CASE WHEN compatible THEN 0 ELSE 1 END AS BIGINT) AS n_details FROM c""",
)
def version_check(spark, sf_dir):
    pk = packages_view(spark, sf_dir)
    spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("k") % 7 + 1).cast("int"))
    req = pk.select(F.col("k").alias("request_id"), "version", spec.alias("spec"))
    r = P.check_spec(req)
    return r.select("request_id", "spec", "current", "compatible", F.size("details").cast("long").alias("n_details"))


@query(
    "compat_report",
    with_(_PKG_CTE)
    + f""", s AS (SELECT *, k % 7 AS si, ([{_SPECS_SQL}])[k % 7 + 1] AS spec FROM pk),
         c AS (SELECT spec, CASE si WHEN 0 THEN v1 >= 10 WHEN 1 THEN v1 >= 5 AND v1 < 20
                         WHEN 2 THEN v1 = 10 AND v2 = 3 AND v3 = 1 WHEN 3 THEN NOT (v1 = 7 AND v2 = 0 AND v3 = 0)
                         WHEN 4 THEN false WHEN 5 THEN false
                         ELSE v1 < 25 OR (v1 = 25 AND (v2 < 12 OR (v2 = 12 AND v3 <= 4))) END AS compatible FROM s)
         SELECT spec, CAST(count(*) FILTER (WHERE compatible) AS BIGINT) AS n_compatible,
                CAST(count(*) FILTER (WHERE NOT compatible) AS BIGINT) AS n_incompatible FROM c GROUP BY spec""",
)
def compat_report(spark, sf_dir):
    pk = packages_view(spark, sf_dir)
    spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("k") % 7 + 1).cast("int"))
    r = P.check_spec(pk.select(F.col("k").alias("request_id"), "version", spec.alias("spec")))
    return r.groupBy("spec").agg(
        F.count_if("compatible").cast("long").alias("n_compatible"), F.count_if(~F.col("compatible")).cast("long").alias("n_incompatible")
    )


@query(
    "inventory_fingerprint",
    with_(_PKG_CTE)
    + """SELECT env, substr(sha256('[' || string_agg('["' || name || '", "' || version || '"]', ', ' ORDER BY name, version) || ']'), 1, 16) AS fingerprint,
              CAST(count(*) AS BIGINT) AS packages_count FROM pk GROUP BY env""",
)
def inventory_fingerprint(spark, sf_dir):
    return P.inventory_fingerprint(packages_view(spark, sf_dir))


def markers_view(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("r"), (k % 7).cast("string"), F.lit("/d"), (k % 3).cast("string")).alias("dir"),
        F.element_at(F.array(*[F.lit(m) for m in MARKER_FILES]), (k % 6 + 1).cast("int")).alias("file"),
        F.when(k % 6 == 3, F.lit("[tool.poetry]\nname = 'x'")).when(k % 6 == 4, F.lit("[tool.uv]\ndev = true")).otherwise(F.lit("")).alias("text"),
    )


@query(
    "pkg_manager",
    f"""WITH mk AS (
          SELECT 'r' || CAST(p_partkey % 7 AS VARCHAR) || '/d' || CAST(p_partkey % 3 AS VARCHAR) AS dir,
                 ([{_MARKERS_SQL}])[p_partkey % 6 + 1] AS file, p_partkey % 6 AS fk FROM part),
        kinds AS (SELECT dir, CASE WHEN fk = 0 THEN 0 WHEN fk = 1 THEN 1 WHEN fk = 2 THEN 2 WHEN fk = 3 THEN 3 WHEN fk = 4 THEN 4 END AS p FROM mk WHERE fk < 5),
        req AS (SELECT p_partkey AS request_id, 'r' || CAST(p_partkey % 11 AS VARCHAR) || '/d' || CAST(p_partkey % 5 AS VARCHAR) || '/src' AS dir FROM part),
        lv AS (SELECT request_id, dir, 0 AS depth FROM req
               UNION ALL SELECT request_id, regexp_replace(dir, '/src$', ''), 1 FROM req
               UNION ALL SELECT request_id, regexp_replace(dir, '/d[0-9]+/src$', ''), 2 FROM req
               UNION ALL SELECT request_id, '', 3 FROM req),
        hit AS (SELECT request_id, arg_min(p, depth * 10 + p) AS p FROM lv JOIN kinds USING (dir) GROUP BY request_id)
        SELECT r.request_id, r.dir, coalesce((['uv', 'poetry', 'pipenv', 'poetry', 'uv'])[h.p + 1], 'pip') AS manager,
               CASE coalesce((['uv', 'poetry', 'pipenv', 'poetry', 'uv'])[h.p + 1], 'pip') WHEN 'uv' THEN 'uv add x' WHEN 'poetry' THEN 'poetry add x'
                    WHEN 'pipenv' THEN 'pipenv install x' ELSE 'pip install x' END AS install_command
        FROM req r LEFT JOIN hit h USING (request_id)""",
)
def pkg_manager(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    req = p.select(k.alias("request_id"), F.concat(F.lit("r"), (k % 11).cast("string"), F.lit("/d"), (k % 5).cast("string"), F.lit("/src")).alias("dir"))
    m = P.detect_manager(markers_view(spark, sf_dir), req)
    return m.select("request_id", "dir", "manager", P.install_command(F.col("manager"), F.lit("x")).alias("install_command"))


def doc_index_view(spark, sf_dir):
    """Doc-index entries derived from ``events``: one cached object per event,
    attributed to the package of part ``user_id``."""
    e = table(spark, sf_dir, "events")
    pk = packages_view(spark, sf_dir).select(F.col("k").alias("user_id"), F.col("name").alias("package"), F.col("version").alias("real_version"))
    d = e.join(by_merge(pk), "user_id", "left")
    return d.select(
        F.concat(F.lit("env"), (F.col("event_id") % 4).cast("string")).alias("env"),
        F.concat(F.lit("obj"), F.col("event_id").cast("string")).alias("name"),
        "package",
        F.when(F.col("event_id") % 5 == 0, F.lit("0.0.0")).when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("real_version")).alias("package_version"),
        F.col("ts").alias("cached_at"),
        (F.col("event_id") % 17).cast("long").alias("hit_count"),
    )


_DOC_CTE = (
    _PKG_CTE
    + """,
doc AS (
  SELECT 'env' || CAST(e.event_id % 4 AS VARCHAR) AS env, 'obj' || CAST(e.event_id AS VARCHAR) AS name, pk.name AS package,
         CASE WHEN e.event_id % 5 = 0 THEN '0.0.0' WHEN e.event_id % 11 = 0 THEN NULL ELSE pk.version END AS package_version,
         e.ts AS cached_at, e.event_id % 17 AS hit_count
  FROM events e LEFT JOIN pk ON pk.k = e.user_id),
fresh AS (
  SELECT d.*, c.version AS current_version,
         CASE WHEN d.package IS NOT NULL AND c.version IS NOT NULL AND d.package_version IS DISTINCT FROM c.version THEN 'stale_version'
              WHEN d.cached_at IS NOT NULL AND d.cached_at < (SELECT max(ts) FROM events) - INTERVAL 168 HOURS THEN 'expired'
              ELSE 'hit' END AS status
  FROM doc d LEFT JOIN pk c ON c.env = d.env AND c.name = d.package)
"""
)


def _fresh(spark, sf_dir):
    now = table(spark, sf_dir, "events").select(F.max("ts")).scalar()
    pk = packages_view(spark, sf_dir)
    return P.doc_freshness(doc_index_view(spark, sf_dir), pk, now)


@query("doc_freshness", with_(_DOC_CTE) + "SELECT env, name, package, status FROM fresh")
def doc_freshness(spark, sf_dir):
    return _fresh(spark, sf_dir).select("env", "name", "package", "status")


@query(
    "lfu_victims",
    with_(_DOC_CTE)
    + """SELECT env, name, hit_count FROM (
           SELECT env, name, hit_count, row_number() OVER (PARTITION BY env ORDER BY hit_count, cached_at, name) AS rn,
                  count(*) OVER (PARTITION BY env) AS n FROM doc) WHERE n >= 500 AND rn <= 50""",
)
def lfu_victims(spark, sf_dir):
    return P.lfu_victims(doc_index_view(spark, sf_dir)).select("env", "name", "hit_count")


@query(
    "cache_stats",
    with_(_DOC_CTE)
    + """SELECT env, CAST(count(*) FILTER (WHERE status = 'hit') AS BIGINT) AS cache_hits,
              CAST(count(*) FILTER (WHERE status IN ('miss', 'stale_version', 'expired')) AS BIGINT) AS cache_misses,
              CAST(0 AS BIGINT) AS evictions, CAST(count(DISTINCT name) AS BIGINT) AS entries FROM fresh GROUP BY env""",
)
def cache_stats(spark, sf_dir):
    return P.cache_stats(_fresh(spark, sf_dir))


@query(
    "package_details",
    with_(_PKG_CTE)
    + """SELECT env, CASE WHEN k % 5 = 0 THEN 'missing-' || CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN upper(name) ELSE name END AS request,
              k % 5 <> 0 AS installed, CASE WHEN k % 5 = 0 THEN NULL ELSE version END AS version FROM pk""",
)
def package_details(spark, sf_dir):
    pk = packages_view(spark, sf_dir)
    req = pk.select(
        "env",
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("missing-"), F.col("k").cast("string")))
        .when(F.col("k") % 2 == 0, F.upper("name"))
        .otherwise(F.col("name"))
        .alias("request"),
    )
    d = P.package_details(pk.drop("k"), req)
    return d.select("env", "request", "installed", F.col("pkg.version").alias("version"))


@query("inventory", with_(_PKG_CTE) + "SELECT env, CAST(count(*) AS BIGINT) AS package_count FROM pk GROUP BY env")
def inventory(spark, sf_dir):
    return P.inventory(packages_view(spark, sf_dir)).select("env", "package_count")


def _new_snapshot(pk):
    """A later inventory: every 10th package upgraded, every 13th removed, one
    new package per 17 keys."""
    kept = pk.where(F.col("k") % 13 != 0).withColumn(
        "version", F.when(F.col("k") % 10 == 0, F.concat(F.col("version"), F.lit(".post1"))).otherwise(F.col("version"))
    )
    added = pk.where(F.col("k") % 17 == 0).withColumn("name", F.concat(F.col("name"), F.lit("-new")))
    return kept.unionByName(added)


_SNAP_CTE = (
    _PKG_CTE
    + """,
new AS (SELECT env, name, CASE WHEN k % 10 = 0 THEN version || '.post1' ELSE version END AS version FROM pk WHERE k % 13 <> 0
        UNION ALL SELECT env, name || '-new', version FROM pk WHERE k % 17 = 0)
"""
)


@query(
    "stale_inventories",
    with_(_SNAP_CTE)
    + """, o AS (SELECT env, substr(sha256('[' || string_agg('["' || name || '", "' || version || '"]', ', ' ORDER BY name, version) || ']'), 1, 16) AS old_fp FROM pk GROUP BY env),
           n AS (SELECT env, substr(sha256('[' || string_agg('["' || name || '", "' || version || '"]', ', ' ORDER BY name, version) || ']'), 1, 16) AS new_fp FROM new GROUP BY env)
         SELECT coalesce(o.env, n.env) AS env, old_fp, new_fp, old_fp IS DISTINCT FROM new_fp AS stale FROM o FULL OUTER JOIN n ON o.env = n.env""",
)
def stale_inventories(spark, sf_dir):
    pk = packages_view(spark, sf_dir)
    return P.stale_inventories(pk, _new_snapshot(pk))


@query(
    "refresh_counts",
    with_(_SNAP_CTE)
    + """, d AS (SELECT coalesce(o.env, n.env) AS env, o.version AS old_v, n.version AS new_v
                 FROM (SELECT env, name, version FROM pk) o FULL OUTER JOIN new n ON o.env = n.env AND o.name = n.name),
           c AS (SELECT env, CAST(count(*) FILTER (WHERE old_v IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE new_v IS NULL) AS BIGINT) AS removed,
                        CAST(count(*) FILTER (WHERE old_v IS NOT NULL AND new_v IS NOT NULL AND old_v <> new_v) AS BIGINT) AS changed FROM d GROUP BY env),
           docs AS (SELECT 'env' || CAST(event_id % 4 AS VARCHAR) AS env, count(*) AS n FROM events GROUP BY ALL)
         SELECT c.env, added, removed, changed, CAST(CASE WHEN added + removed + changed > 0 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS evicted
         FROM c LEFT JOIN docs USING (env)""",
)
def refresh_counts(spark, sf_dir):
    pk = packages_view(spark, sf_dir)
    return P.refresh(pk, _new_snapshot(pk), doc_index_view(spark, sf_dir))


@query(
    "import_audit",
    with_(GEN)
    + """SELECT path, imp AS top, CASE WHEN k % 4 < 2 THEN 'stdlib' ELSE 'missing' END AS status FROM ok
         UNION ALL SELECT path, 'm' || CAST(d AS VARCHAR), 'missing' FROM ok WHERE d IS NOT NULL""",
)
def import_audit(spark, sf_dir):
    from ..operators.extract import stdlib_array
    from ..operators.graph import file_imports
    from .corpus_views import code_analysis

    imps = file_imports(code_analysis(spark, sf_dir)).where(F.col("level") == 0).withColumn("env", F.lit("env0"))
    lookup = P.import_to_package(packages_view(spark, sf_dir))
    return P.import_audit(imps, lookup, stdlib_array()).select("path", "top", "status")


def metadata_files(spark, sf_dir):
    """Distribution metadata files (METADATA, RECORD, top_level.txt) written
    by Spark for every package of the packages view."""
    pk = packages_view(spark, sf_dir)
    folder = F.concat(F.lit("site-packages/"), F.col("name"), F.lit("-"), F.col("version"), F.lit(".dist-info/"))
    meta = F.concat(
        F.lit("Metadata-Version: 2.1\nName: "), F.col("name"), F.lit("\nVersion: "), F.col("version"), F.lit("\n"),
        F.array_join(F.transform("requires", lambda r: F.concat(F.lit("Requires-Dist: "), r)), "\n"), F.lit("\n"),
    )
    m = pk.select("env", F.concat(folder, F.lit("METADATA")).alias("path"), meta.alias("text"))
    rec = pk.where(F.size("files") > 0).select("env", F.concat(folder, F.lit("RECORD")).alias("path"), F.array_join(F.transform("files", lambda x: F.concat(x, F.lit(",,"))), "\n").alias("text"))
    top = pk.where(F.col("top_level").isNotNull()).select("env", F.concat(folder, F.lit("top_level.txt")).alias("path"), F.concat("top_level", F.lit("\n")).alias("text"))
    return m.unionByName(rec).unionByName(top)


@query(
    "metadata_packages",
    with_(_PKG_CTE)
    + """SELECT env, name, version, CASE WHEN k % 3 = 2 THEN lower(replace(name, '-', '_')) ELSE under END AS import_name,
              CAST(3 AS BIGINT) AS n_dependencies FROM pk""",
)
def metadata_packages(spark, sf_dir):
    p = P.packages_from_metadata(metadata_files(spark, sf_dir))
    return p.select("env", "name", "version", F.explode("import_names").alias("import_name"), F.size("dependencies").cast("long").alias("n_dependencies"))


def _grown(packages):
    """The packages over environments whose number grows with their own: about
    the square root."""
    n = packages.agg(F.greatest(F.lit(4), F.floor(F.sqrt(F.max("k")))).alias("n")).scalar()
    return packages.withColumn("env", F.concat(F.lit("env"), (F.col("k") % n).cast("string")))


_DIGEST_CTE = (
    _SNAP_CTE.replace("'env' || CAST(p_partkey % 4 AS VARCHAR) AS env", "'env' || CAST(p_partkey % (SELECT greatest(4, CAST(floor(sqrt(max(p_partkey))) AS BIGINT)) FROM part) AS VARCHAR) AS env")
    + """,
both_inv AS (SELECT 'old' AS side, env, name, version FROM pk UNION ALL SELECT 'new', env, name, version FROM new),
hashed AS (
  SELECT side, env, CAST('0x' || substr(sha256(name), 57, 8) AS BIGINT) % 1024 AS range, sha256(CAST(length(name) AS VARCHAR) || ':' || name || '=' || version) AS h FROM both_inv),
ranged AS (
  SELECT side, env, range, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b FROM hashed GROUP BY ALL),
digests AS (SELECT side, env, range, n, sha256(CAST(n AS VARCHAR) || ',' || CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR)) AS digest FROM ranged),
tops AS (
  SELECT side, env, substr(sha256(string_agg(CAST(range AS VARCHAR) || ':' || digest, ',' ORDER BY range)), 1, 16) AS fingerprint, CAST(sum(n) AS BIGINT) AS packages_count FROM digests GROUP BY side, env)
"""
)


@query("inventory_digest", with_(_DIGEST_CTE) + "SELECT env, fingerprint, packages_count FROM tops WHERE side = 'old'")
def inventory_digest(spark, sf_dir):
    return P.inventory_digest(_grown(packages_view(spark, sf_dir)))


@query(
    "inventory_ranges",
    with_(_DIGEST_CTE)
    + """SELECT coalesce(o.env, n.env) AS env, coalesce(o.range, n.range) AS range FROM (SELECT * FROM digests WHERE side = 'old') o
         FULL OUTER JOIN (SELECT * FROM digests WHERE side = 'new') n ON o.env = n.env AND o.range = n.range WHERE o.digest IS DISTINCT FROM n.digest""",
)
def inventory_ranges(spark, sf_dir):
    """The name ranges in which two snapshots differ."""
    pk = _grown(packages_view(spark, sf_dir))
    a, b = P.range_digests(pk), P.range_digests(_new_snapshot(pk)).select("env", "range", F.col("digest").alias("other"))
    return a.join(b, ["env", "range"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("env", "range")


@query(
    "inventory_changes",
    with_(_DIGEST_CTE)
    + """SELECT coalesce(o.env, n.env) AS env, coalesce(o.name, n.name) AS name, coalesce(o.version, '-') AS old_version, coalesce(n.version, '-') AS new_version,
              CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change
         FROM pk o FULL OUTER JOIN new n ON o.env = n.env AND o.name = n.name WHERE o.version IS DISTINCT FROM n.version""",
)
def inventory_changes(spark, sf_dir):
    pk = _grown(packages_view(spark, sf_dir))
    c = P.inventory_changes(pk, _new_snapshot(pk))
    return c.select("env", "name", F.coalesce("old_version", F.lit("-")).alias("old_version"), F.coalesce("new_version", F.lit("-")).alias("new_version"), "change")


@query(
    "install_answers",
    with_(_PKG_CTE)
    + """SELECT k AS request_id, k % 2 = 0 AS already_installed, CASE WHEN k % 2 = 0 THEN version ELSE '-' END AS installed_version,
              CASE WHEN k % 2 = 0 THEN '''' || upper(name) || ''' is already installed.' ELSE '-' END AS note,
              (['uv add ', 'poetry add ', 'pipenv install ', 'pip install '])[k % 4 + 1] || CASE WHEN k % 2 = 0 THEN upper(name) ELSE 'no-' || name END AS install_command FROM pk""",
)
def install_answers(spark, sf_dir):
    """Every other request asks for an installed package, in capitals."""
    pk = packages_view(spark, sf_dir)
    k = F.col("k")
    manager = F.element_at(F.array(*[F.lit(m) for m in ("uv", "poetry", "pipenv", "pip")]), (k % 4 + 1).cast("int"))
    req = pk.select(k.alias("request_id"), "env", F.when(k % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit("no-"), "name")).alias("package"), manager.alias("manager"))
    r = P.install_instructions(pk, req)
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return r.select("request_id", "already_installed", dash("installed_version"), dash("note"), "install_command")


def _wide(spark, sf_dir):
    """Distributions of eight modules each, all from their file lists."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    own, none = F.col("k").cast("string"), F.array().cast("array<string>")
    files = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("mod"), own, F.lit("_"), i.cast("string"), F.lit("/__init__.py")))
    pk = p.select(
        "k", F.lit("env0").alias("env"), F.concat(F.lit("Wide"), own).alias("name"), F.lit("1.0").alias("version"), none.alias("import_names"), none.alias("requires"), files.alias("files"),
        F.lit(None).cast("string").alias("top_level"),
    )
    return P.normalise(pk)


@query(
    "wide_imports",
    """SELECT 'env0' AS env, 'MOD' || CAST(p_partkey AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS import_name, 'Wide' || CAST(p_partkey AS VARCHAR) AS package
       FROM part, (SELECT unnest(range(1, 9)) AS i)""",
)
def wide_imports(spark, sf_dir):
    """I3 into I6: the eighth module of a package is found like the first."""
    pk = _wide(spark, sf_dir)
    req = pk.select("env", F.explode("import_names").alias("n")).select("env", F.upper("n").alias("import_name"))
    return P.find_package_by_import(pk, req)


@query(
    "expected_packages",
    """SELECT 'mod' || CAST(p_partkey AS VARCHAR) || '_8' AS top, CASE WHEN p_partkey % 3 = 0 THEN 'other-package' ELSE 'installed' END AS status FROM part""",
)
def expected_packages(spark, sf_dir):
    """Imports that another package than the expected one provides."""
    from ..operators.extract import stdlib_array

    pk = _wide(spark, sf_dir)
    own = F.col("k").cast("string")
    expected = F.when(F.col("k") % 3 == 0, F.lit("else")).otherwise(F.lower("name"))
    imps = pk.select("env", F.concat(F.lit("p"), own, F.lit(".py")).alias("path"), expected.alias("expected"), F.concat(F.lit("mod"), own, F.lit("_8.sub")).alias("module"))
    return P.import_audit(imps, P.import_to_package(pk), stdlib_array()).select("top", "status")


@query("install_locations", "SELECT 'Wide' || CAST(p_partkey AS VARCHAR) AS name, '/site/mod' || CAST(p_partkey AS VARCHAR) || '_1' AS location FROM part")
def install_locations(spark, sf_dir):
    """I8: the folder of a distribution's first file."""
    return _wide(spark, sf_dir).select("name", P.install_location(F.lit("/site"), F.col("files")).alias("location"))
