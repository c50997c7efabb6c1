"""What changed between two captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .observe import FLOW_KEY


def new_rows(base: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Rows of current whose key base lacks; swap the tables for what is gone."""
    return current.join(base.select(*key).distinct(), key, "left_anti")


def role_shifts(base: DataFrame, current: DataFrame) -> DataFrame:
    """ip, was, now of assets whose role differs."""
    both = base.select("ip", F.col("role").alias("was")).join(current.select("ip", F.col("role").alias("now")), "ip")
    return both.where("was <> now")


def flow_delta(base: DataFrame, current: DataFrame, multiplier: float = 2.0, base_seconds: float | None = None, current_seconds: float | None = None) -> DataFrame:
    """Flows that are new, gone or shifted, with bytes before and after and their ratio.

    The measure is bytes a second where both windows last a second at least, else bytes. The ratio is
    larger by smaller; flows with an empty side do not shift.
    """
    if not 1.0 <= multiplier < float("inf"):
        raise ValueError("multiplier must be finite and 1 at least")
    rate = bool(base_seconds and current_seconds and base_seconds >= 1 and current_seconds >= 1)
    was, now = F.col("base_bytes"), F.col("current_bytes")
    a, b = (was / F.lit(base_seconds), now / F.lit(current_seconds)) if rate else (was.cast("double"), now.cast("double"))
    both = base.select(*FLOW_KEY, F.col("bytes").alias("base_bytes")).join(current.select(*FLOW_KEY, F.col("bytes").alias("current_bytes")), FLOW_KEY, "full_outer")
    low, high = F.least(a, b), F.greatest(a, b)
    ratio = F.when(was.isNotNull() & now.isNotNull() & (low > 0), high / low)
    change = F.when(was.isNull(), "new").when(now.isNull(), "gone").when(ratio >= multiplier, "shifted")
    return both.select(*FLOW_KEY, "base_bytes", "current_bytes", F.round(ratio, 6).alias("ratio"), change.alias("change")).where("change IS NOT NULL")


def window_advisory(base_seconds: float | None, current_seconds: float | None) -> str:
    """degenerate, mismatch or comparable."""
    if not base_seconds or not current_seconds or min(base_seconds, current_seconds) < 1:
        return "degenerate"
    return "mismatch" if max(base_seconds, current_seconds) / min(base_seconds, current_seconds) >= 2 else "comparable"


def finding_delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """rule_id, entity and whether the finding is new, resolved or recurring."""
    key = ["rule_id", "entity"]
    both = base.select(*key, F.lit(True).alias("was")).join(current.select(*key, F.lit(True).alias("now")), key, "full_outer")
    return both.select(*key, F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("recurring").alias("change"))


def tally_delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """metric, baseline, current of two conformance tallies of one policy (one row each)."""
    metrics = ["allowed", "intra_zone", "violating_flows", "idmz_bypasses", "no_matching_conduit", "wrong_direction", "multicast_exempt", "external_endpoints"]
    long = lambda df, name: df.unpivot([], metrics, "metric", name)
    return long(base, "baseline").join(long(current, "current"), "metric")


def violation_delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """The same for violations, by kind and flow."""
    key = ["violation", *FLOW_KEY]
    both = base.select(*key).distinct().withColumn("was", F.lit(True)).join(current.select(*key).distinct().withColumn("now", F.lit(True)), key, "full_outer")
    return both.select(*key, F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("persisting").alias("change"))
