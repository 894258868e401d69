"""Gate evidence: the latest result of each gate, whether its inputs are still what they were, and the inputs' fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators.changes import last_per_key


def stale(results: DataFrame, current: DataFrame, keys: list[str], on: list[str], fingerprint: str = "input_fingerprint") -> DataFrame:
    """The latest result of each gate where it passed with another fingerprint than the current one (column ``current``)."""
    return last_per_key(results, keys, ["seq"]).where("outcome = 'passed'").join(current, on).where(F.col(fingerprint) != F.col("current"))


def unbound(results: DataFrame, known: DataFrame, keys: list[str], fingerprint: str = "input_fingerprint") -> DataFrame:
    """The results of gates that hold for nothing, and ``why``: ``unknown`` where ``known`` lacks their keys or one is null, else ``fingerprint`` where it is null or empty."""
    marked = results.join(known.select(*keys, F.lit(True).alias("__known")).distinct(), keys, "left")
    why = F.when(F.col("__known").isNull(), "unknown").when(F.coalesce(F.col(fingerprint), F.lit("")) == "", "fingerprint")
    return marked.withColumn("why", why).where("why is not null").drop("__known")


def fingerprints(inputs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, current: digest of each group's paths and their hashes in order of path; a path that isn't there counts as ``missing``."""
    known = inputs.select(*keys, "path").distinct().join(files.select("path", "hash"), "path", "left").withColumn("hash", F.coalesce("hash", F.lit("missing")))
    listed = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", "hash"))).alias("inputs"))
    return listed.select(*keys, F.concat(F.lit("sha256:"), F.sha2(F.to_json("inputs").cast("binary"), 256)).alias("current"))


def satisfied(results: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """``required`` gates and whether the latest result of the highest plan revision passed."""
    last = last_per_key(results.select(*keys, "outcome", "plan_revision", "seq"), keys, ["plan_revision", "seq"])
    return required.join(last, keys, "left").withColumn("ok", F.coalesce(F.col("outcome") == "passed", F.lit(False)))


def engineering_hashes(plans: DataFrame) -> DataFrame:
    """plan_id, profile_hash, gates_hash: digests of the engineering profile and of the set of quality gates."""
    key = lambda name: F.get_json_object("frontmatter", f"$.engineering.{name}")
    gates = F.array_sort(F.array_distinct(text.from_json_list(key("quality_gates"))))
    return plans.where("code is null").select("plan_id", text.digest(key("profile").alias("profile")).alias("profile_hash"), text.digest(gates.alias("gates")).alias("gates_hash"))
