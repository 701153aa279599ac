"""Who may see and change which document: visibility modes and role policies as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.storage import broadcast_small, stage

#: Fixed values: (role, resource glob, method) policies; a group names the role that it inherits.
POLICIES = [
    ("viewer", "/documents/*", "GET"),
    ("viewer", "/search", "GET"),
    ("editor", "/documents/*", "POST"),
    ("editor", "/documents/*", "PUT"),
    ("admin", "/*", "GET"),
    ("admin", "/*", "POST"),
    ("admin", "/*", "DELETE"),
]
INHERITS = [("editor", "viewer"), ("admin", "editor")]


def rules(documents: DataFrame, users: DataFrame, membership: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, scope, target, via): who sees what by the object rule: admin, then owner, then grant, then shared group.

    documents: document_id, owner_id. users: user_id, is_admin. membership: user_id, group_id. grants: document_id,
    user_id. An admin is one row of scope "all" (target 0), a membership one of scope "group", so only owned and granted documents
    are listed one by one, each with its first reason; admins have no other rows.
    """
    row = lambda df, scope, target, via: df.select("user_id", F.lit(scope).alias("scope"), target.cast("long").alias("target"), via.alias("via"))
    admins = users.where("is_admin").select("user_id")
    owners = documents.where(F.col("owner_id").isNotNull()).select(F.col("owner_id").alias("user_id"), "document_id", F.lit(2).alias("rank"), F.lit("owner").alias("via"))
    given = grants.select("user_id", "document_id", F.lit(3).alias("rank"), F.lit("grant").alias("via"))
    listed = owners.unionByName(given).groupBy("user_id", "document_id").agg(F.min_by("via", "rank").alias("via"))
    some = row(membership.select("user_id", "group_id").distinct(), "group", F.col("group_id"), F.lit("group")).unionByName(row(listed, "document", F.col("document_id"), F.col("via")))
    return row(admins, "all", F.lit(0), F.lit("admin")).unionByName(some.join(admins, "user_id", "left_anti"))


def visible_to(user_id: int, documents: DataFrame, users: DataFrame, membership: DataFrame, grants: DataFrame) -> DataFrame:
    """(document_id, via) of the documents that one user sees: the rules above expanded for who asks."""
    admin = bool(users.where((F.col("user_id") == user_id) & F.col("is_admin")).head(1))
    mine = grants.where(F.col("user_id") == user_id).select("document_id", F.lit(True).alias("granted")).distinct()
    groups = membership.where(F.col("user_id") == user_id).select("group_id", F.lit(True).alias("shared")).distinct()
    d = documents.join(mine, "document_id", "left").join(broadcast_small(groups), "group_id", "left")
    via = F.when(F.lit(admin), "admin").when(F.col("owner_id") == user_id, "owner").when(F.col("granted"), "grant").when(F.col("shared"), "group")
    return d.select("document_id", via.alias("via")).where(F.col("via").isNotNull())


def search_filter(user_id: int, documents: DataFrame, users: DataFrame, membership: DataFrame) -> DataFrame:
    """(document_id) that a search may return: all for an admin and for a user without groups, else those of a shared group.

    Ownership and grants don't count here; that is the search rule's own semantics.
    """
    mine = membership.where(F.col("user_id") == user_id).select("group_id").distinct()
    admin = bool(users.where((F.col("user_id") == user_id) & F.col("is_admin")).head(1))
    if admin or not mine.head(1):
        return documents.select("document_id")
    return documents.join(broadcast_small(mine), "group_id", "left_semi").select("document_id")


def closure(edges: DataFrame, a: str = "role", b: str = "parent") -> DataFrame:
    """(a, b): every pair that a chain of edges joins, semi-naively: only pairs that are new are walked on.

    Cycles end by themselves, as their pairs are known; a member of one reaches itself. Rounds are as many as the longest
    chain has edges.
    """
    step = edges.select(F.col(a).alias("mid"), F.col(b).alias("far")).distinct()
    known = fresh = stage(edges.select(a, b).distinct(), "closure")
    while fresh.head(1):
        further = fresh.join(step, F.col(b) == F.col("mid")).select(a, F.col("far").alias(b)).distinct()
        fresh = stage(further.join(known, [a, b], "left_anti"), "closure")
        known = known.unionByName(fresh)
    return known


def glob_regex(glob: Column) -> Column:
    """The regular expression of a glob: ``*`` is any text, every other character is itself."""
    literal = F.regexp_replace(glob, r"([\\.^$|?+(){}\[\]])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("$"))


def enforce(requests: DataFrame, policies: DataFrame, inherits: DataFrame) -> DataFrame:
    """requests (role, resource, method) with whether any policy of the role, or of a role it inherits, however far, allows them."""
    reach = closure(inherits).select(F.col("role").alias("r1"), F.col("parent").alias("p1"))
    own = policies.select(F.col("role").alias("r1")).distinct().select("r1", F.col("r1").alias("p1"))
    reach = own.unionByName(reach).distinct()
    effective = reach.join(policies, F.col("p1") == F.col("role")).select(F.col("r1").alias("policy_role"), glob_regex(F.col("glob")).alias("pattern"), F.col("method").alias("policy_method")).distinct()
    hit = requests.join(broadcast_small(effective), (F.col("role") == F.col("policy_role")) & (F.col("method") == F.col("policy_method")) & F.expr("resource RLIKE pattern"), "left")
    return hit.groupBy(*requests.columns).agg(F.coalesce(F.bool_or(F.col("policy_role").isNotNull()), F.lit(False)).alias("allowed"))
