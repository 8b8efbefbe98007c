"""Access scopes: which graphs a user may read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_graphs(public: DataFrame, owned: DataFrame, shared: DataFrame, user: str | None) -> DataFrame:
    """(g): public graphs, those that ``user`` owns (g, owner), and those shared with them (g, viewer); no user sees public ones only."""
    g = public.select("g")
    if user is not None:
        g = g.union(owned.where(F.col("owner") == user).select("g")).union(shared.where(F.col("viewer") == user).select("g"))
    return g.distinct()


def owns_object(objects: DataFrame, owners: DataFrame, user: str) -> DataFrame:
    """``objects`` (s, ...) with ``owned``: whether ``owners`` (s, owner) names ``user``."""
    mine = owners.where(F.col("owner") == user).select("s").distinct().withColumn("owned", F.lit(True))
    return objects.join(mine, "s", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def can_write(objects: DataFrame, owners: DataFrame, public: DataFrame, user: str | None, admin: bool = False) -> DataFrame:
    """``objects`` (s, g) with ``writable``: an admin writes everywhere; others what they own outside public graphs; nobody writes without a name."""
    if admin or user is None:
        return objects.withColumn("writable", F.lit(admin))
    p = public.select("g").distinct().withColumn("_public", F.lit(True))
    found = owns_object(objects, owners, user).join(p, "g", "left")
    return found.withColumn("writable", F.col("owned") & F.col("_public").isNull()).drop("owned", "_public")


def readable(rows: DataFrame, graphs: DataFrame) -> DataFrame:
    """Rows of those graphs; a row without a graph is denied."""
    return rows.join(graphs.select("g").distinct(), "g", "left_semi")
