"""Name resolution (F5, G2, G3) as joins over scope rows.

The parse emits scopes, bindings and raw uses. A use looks for its name in its
own scope, then in the functions around it, then in the module; a class body is
seen from directly inside it alone. So a use meets the bindings of its name in
every scope it can see, and the nearest one wins (``min_by`` depth). Uses of one
name in one scope are one row until the end, with their places in a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import KEY_COLS
from .joins import by_merge


def scope_rows(analysis: DataFrame) -> DataFrame:
    """One row a scope: ``(project, path, scope_id, parent_id, kind, scope)``."""
    return analysis.select(*KEY_COLS, F.explode("scopes").alias("s")).select(
        *KEY_COLS, F.col("s.id").alias("scope_id"), F.get("s.path", F.lit(1)).alias("parent_id"), F.col("s.kind").alias("kind"), F.col("s.name").alias("scope")
    )


def _seen(start):
    """The scopes seen from the scope ``start``, nearest first: itself, then
    what is around it without class bodies (``scopes`` is in id order)."""
    around = F.get("scopes", start)["path"]
    return F.filter(around, lambda s, i: (i == 0) | (F.get("scopes", s)["kind"] != "class"))


def visible_scopes(analysis: DataFrame) -> DataFrame:
    """The closure: ``(project, path, scope_id, depth, seen_id)``."""
    one = analysis.select(*KEY_COLS, "scopes", F.explode(F.transform("scopes", lambda s: s["id"])).alias("scope_id"))
    return one.select(*KEY_COLS, "scope_id", F.posexplode(_seen(F.col("scope_id"))).alias("depth", "seen_id"))


def bound_names(analysis: DataFrame) -> DataFrame:
    """Distinct ``(project, path, scope_id, name)`` that some binding makes."""
    return analysis.select(*KEY_COLS, F.explode("bindings").alias("b")).select(*KEY_COLS, F.col("b.scope_id").alias("scope_id"), F.col("b.name").alias("name")).distinct()


def resolve(analysis: DataFrame, column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The names of the parse column ``column`` (``uses`` or ``attribute_uses``):
    ``(project, path, *carry, name, scope, scope_id, places, resolved_id,
    resolved)``; the last two are the scope whose binding the name means, null
    if there is none in the file."""
    names = analysis.select(*KEY_COLS, *carry, "scopes", F.explode(column).alias("u"))
    around = F.posexplode(_seen(F.col("u.start_id"))).alias("depth", "seen_id")
    seen = names.select(*KEY_COLS, *carry, "scopes", "u", around)
    # the places go with the row of the first scope alone
    places = F.when(F.col("depth") == 0, F.struct(*carry, F.col("u.scope").alias("scope"), F.col("u.places").alias("places")))
    slim = seen.select(
        *KEY_COLS, F.col("u.scope_id").alias("scope_id"), F.col("u.name").alias("name"), "depth", "seen_id", F.get("scopes", F.col("seen_id"))["name"].alias("seen"), places.alias("c")
    )
    there = bound_names(analysis).select(*KEY_COLS, F.col("scope_id").alias("seen_id"), "name", F.lit(True).alias("there"))
    met = slim.join(by_merge(there), [*KEY_COLS, "seen_id", "name"], "left")
    nearest = F.min(F.when(F.col("there"), F.struct("depth", "seen_id", "seen")))
    out = met.groupBy(*KEY_COLS, "scope_id", "name").agg(nearest.alias("hit"), F.first("c", ignorenulls=True).alias("c"))
    return out.select(*KEY_COLS, *[F.col(f"c.{c}").alias(c) for c in carry], "name", F.col("c.scope").alias("scope"), "scope_id", F.col("c.places").alias("places"), F.col("hit.seen_id").alias("resolved_id"), F.col("hit.seen").alias("resolved"))


def uses(analysis: DataFrame) -> DataFrame:
    """Every use of a name: ``(project, path, star_import, name, scope, line,
    column, resolved_id, resolved)``."""
    one = resolve(analysis, "uses", ("star_import",)).withColumn("p", F.explode("places"))
    return one.select(*KEY_COLS, "star_import", "name", "scope", F.col("p.line").cast("long").alias("line"), F.col("p.col").cast("long").alias("column"), "resolved_id", "resolved")


def attribute_uses(analysis: DataFrame) -> DataFrame:
    """Every dotted use: ``(project, path, name, rest, line, column,
    resolved_id)`` with the first name and what follows it (``.b.c``)."""
    one = resolve(analysis, "attribute_uses").withColumn("p", F.explode("places"))
    return one.select(*KEY_COLS, "name", F.col("p.rest").alias("rest"), F.col("p.line").cast("long").alias("line"), F.col("p.col").cast("long").alias("column"), "resolved_id")
