"""Control-plane rules as joins: permission requests and state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def clean_path(path: Column, home: str = "") -> Column:
    """A path without doubled or trailing slashes, ``.`` and ``..``; a leading ``~`` is the home."""
    full = F.when((path == "~") | path.startswith("~/"), F.concat(F.lit(home), F.substr(path, F.lit(2)))).otherwise(path) if home else path
    parts = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(full.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def forbidden_path(path: Column, home: str = "") -> Column:
    """Whether a path, or a folder above it, is never granted; temporary folders are."""
    clean = clean_path(path, home)
    below = lambda folder: (clean == folder) | clean.startswith(folder + "/")
    some = lambda folders: reduce(lambda a, b: a | b, map(below, folders))
    return ~some(V.ALLOWED_PATHS) & some(V.FORBIDDEN_PATHS + ([f"{home.rstrip('/')}/{f}" for f in V.FORBIDDEN_IN_HOME] if home else []))


def decide(requests: DataFrame, rules: DataFrame, grants: DataFrame, home: str = "") -> DataFrame:
    """``request_id, decision, reason`` of ``requests (request_id, instance_id, kind, target)``.

    ``rules (priority, kind, pattern, decision, reason)``: a rule fits a request of its kind whose target matches its pattern. A denial of priority 0 comes first, then that of a forbidden path
    (requests of kind ``filesystem``); then a grant ``(instance_id, kind, target)`` allows, another fitting rule decides by priority, and what nothing covers is allowed. Rules meet distinct targets, not requests.
    """
    asked = requests.select("kind", "target").distinct()
    fits = asked.join(rules.withColumnRenamed("kind", "_kind"), (F.col("kind") == F.col("_kind")) & F.expr("target rlike pattern"), "left")
    best = fits.groupBy("kind", "target").agg(F.min(F.when(F.col("decision").isNotNull(), F.struct("priority", "decision", "reason"))).alias("rule"))
    best = best.withColumn("barred", F.coalesce((F.col("kind") == "filesystem") & forbidden_path(F.col("target"), home), F.lit(False)))
    known = grants.select("instance_id", "kind", "target").distinct().withColumn("granted", F.lit(True))
    best = best.withColumnsRenamed({"kind": "_kind", "target": "_target"})
    decided = requests.join(best, F.col("kind").eqNullSafe(F.col("_kind")) & F.col("target").eqNullSafe(F.col("_target")), "left")
    both = decided.join(known, ["instance_id", "kind", "target"], "left")
    denied = F.coalesce((F.col("rule.priority") == 0) & (F.col("rule.decision") == "deny"), F.lit(False))
    decision = F.when(denied | F.col("barred"), "deny").when(F.col("granted"), "allow").otherwise(F.coalesce("rule.decision", F.lit("allow")))
    reason = F.when(~denied & F.col("barred"), "Forbidden filesystem access requested").when(decision != "allow", F.col("rule.reason")).otherwise("No policy violations")
    return both.select("request_id", decision.alias("decision"), reason.alias("reason"))


def check_transitions(changes: DataFrame) -> DataFrame:
    """``changes (from_status, to_status)`` with ``lawful``."""
    lawful = F.lit(False)
    for start, ends in V.TRANSITIONS.items():
        if ends:
            lawful = lawful | ((F.col("from_status") == start) & F.col("to_status").isin(ends))
    return changes.withColumn("lawful", F.coalesce(lawful, F.lit(False)))
