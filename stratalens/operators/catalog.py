"""Record maintenance: upserts, diffs, invalidation, merges and access decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.blocking import containing


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key (insert-or-replace as a view over appended rows)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of the same key."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """added, modified or deleted keys between two snapshots."""
    both = old.select(key, F.col(version).alias("old"), F.lit(True).alias("in_old")).join(new.select(key, F.col(version).alias("new"), F.lit(True).alias("in_new")), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select(key, change.alias("change")).filter("change is not null")


def time_diff(old: DataFrame, new: DataFrame, key: str, mtime: str, tolerance: float = 1.0) -> DataFrame:
    """Keys that are new or whose time moved by more than the tolerance; deletions aren't reported."""
    both = new.select(key, F.col(mtime).alias("new")).join(old.select(key, F.col(mtime).alias("old")), key, "left")
    return both.filter(F.col("old").isNull() | (F.abs(F.col("new") - F.col("old")) > tolerance)).select(key)


def staleness(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (qa_id, path, stored) whose file is deleted, or modified since: qa_id, path, status."""
    both = refs.join(files.select("path", "mtime"), "path", "left")
    status = F.when(F.col("mtime").isNull(), "deleted").when(F.col("mtime") > F.coalesce("stored", F.lit(0)), "modified")
    return both.select("qa_id", "path", status.alias("status")).filter("status is not null")


def invalidated(entries: DataFrame, changed: DataFrame, ref: str, file: str) -> DataFrame:
    """Entries with a reference that holds a changed file's name or is held by one; nulls and empty names match nothing. References
    are compared with the names that share a stretch with them."""
    refs, names = entries.select(ref).distinct(), changed.select(file).distinct()
    hit = containing(refs, names, ref, file).select(ref).unionByName(containing(names, refs, file, ref).select(ref))
    return entries.join(hit.distinct(), ref, "left_semi")


def merge_entries(target: DataFrame, source: DataFrame, key: str, stamp: str, strategy: str = "keep_newer") -> DataFrame:
    """Full outer merge of two versions of a table: keep_newer (ties keep the target), keep_source or keep_target."""
    columns = [c for c in target.columns if c != key]
    both = target.select(key, F.struct(*columns).alias("t")).join(source.select(key, F.struct(*columns).alias("s")), key, "full_outer")
    take_source = {"keep_newer": F.col(f"s.{stamp}") > F.col(f"t.{stamp}"), "keep_source": F.col("s").isNotNull(), "keep_target": F.lit(False)}[strategy]
    picked = F.when(F.col("t").isNull() | (F.col("s").isNotNull() & take_source), F.col("s")).otherwise(F.col("t"))
    return both.select(key, picked.alias("p")).select(key, "p.*")


def merge_sets(target: DataFrame, source: DataFrame, key: str, sets: list[str], most: list[str], least: list[str]) -> DataFrame:
    """Content merge: unions of set columns, greatest and least of others."""
    both = target.join(source.select(key, *[F.col(c).alias(f"s_{c}") for c in (*sets, *most, *least)]), key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    out = [F.sort_array(F.array_union(empty(c), empty(f"s_{c}"))).alias(c) for c in sets]
    return both.select(key, *out, *[F.greatest(c, f"s_{c}").alias(c) for c in most], *[F.least(c, f"s_{c}").alias(c) for c in least])


def decisions(requests: DataFrame, resources: DataFrame, members: DataFrame, grants: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Access decisions for requests (user_id, resource_id, action): the owner; a role granted to the user; a member of the
    resource's team, for reading or by the role of the team; anyone, for reading what is public."""
    explicit = grants.join(role_permissions, "role").select("user_id", "resource_id", "action", F.lit(True).alias("granted")).distinct()
    in_team = members.select("user_id", "team", F.lit(True).alias("member")).distinct()
    by_role = members.join(role_permissions, "role").select("user_id", "team", "action", F.lit(True).alias("team_granted")).distinct()
    asked = requests.join(resources, "resource_id").join(explicit, ["user_id", "resource_id", "action"], "left").join(in_team, ["user_id", "team"], "left").join(by_role, ["user_id", "team", "action"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    allowed = (F.col("owner") == F.col("user_id")) | yes("granted") | (yes("member") & ((F.col("action") == "read") | yes("team_granted"))) | ((F.col("visibility") == "public") & (F.col("action") == "read"))
    return asked.select("user_id", "resource_id", "action", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def net_votes(votes: DataFrame, item: str, voter: str, order: list[Column]) -> DataFrame:
    """Sum of each voter's last vote on each item."""
    return latest(votes, [item, voter], order).groupBy(item).agg(F.coalesce(F.sum("vote"), F.lit(0)).alias("votes"))


def next_version(history: DataFrame, key: str) -> DataFrame:
    return history.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def workflow_status(events: DataFrame, key: str, order: str) -> DataFrame:
    """Status of each item after its events (pending, approve, reject, merge): only pending items move, and only approved merge."""
    step = lambda s, e: F.when((s == "pending") & (e["action"] == "approve"), "approved").when((s == "pending") & (e["action"] == "reject"), "rejected").when((s == "approved") & (e["action"] == "merge"), "merged").otherwise(s)
    ordered = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "action"))).alias("each"))
    return ordered.select(key, F.aggregate("each", F.lit("pending"), step).alias("status"))
