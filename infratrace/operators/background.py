"""Features against a matched background: membership, support, prevalence, lift, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import group_hash, joined_id, sha256_text
from ..functions.sizes import broadcast_if_few, is_few

Z = 1.959963984540054
EPSILON = 1e-9


def wilson(n: Column, d: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % interval of n in d; (0, 1) if d is 0."""
    n, d, z = n.cast("double"), d.cast("double"), F.lit(Z)
    p, term = n / d, 1 + z * z / d
    centre = (p + z * z / (2 * d)) / term
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * d)) / d) / term
    return F.when(d == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + margin))


def lift(support: Column, prevalence: Column) -> Column:
    return support / F.greatest(prevalence, F.lit(EPSILON))


def _matches(sets: DataFrame, services: DataFrame) -> DataFrame:
    """reference_set_id, observation_id where a service of the observation has the set's protocol, port
    and product. An open condition is a value of its own that every service has too, so the three are
    one equality join whatever the number of sets."""
    every = "*"
    p, q = F.coalesce(F.lower("protocol"), F.lit(every)), F.coalesce(F.lower("product"), F.lit(every))
    ports = F.when(F.coalesce(F.size("ports") > 0, F.lit(False)), F.col("ports")).otherwise(F.array(F.lit(0)))
    wanted = sets.select("reference_set_id", p.alias("p"), q.alias("q"), F.explode(F.array_distinct(ports)).alias("port"))
    own = services.select("observation_id", F.lower("protocol").alias("p"), F.lower(F.coalesce("software_product", F.lit(""))).alias("q"), "port").distinct()
    both = lambda c, any_: F.explode(F.array(F.col(c), F.lit(any_))).alias(c)
    for column, any_ in (("p", every), ("q", every), ("port", 0)):
        own = own.select(*[c for c in own.columns if c != column], both(column, any_))
    return own.join(broadcast_if_few(wanted), ["p", "q", "port"]).select("reference_set_id", "observation_id").distinct()


def memberships(sets: DataFrame, hosts: DataFrame, services: DataFrame, excluded: bool = True) -> DataFrame:
    """reference_set_id, observation_id, observable and exclusion_reason for every host and set, or only
    for observable ones, which then come from the matches alone.

    sets: reference_set_id, cutoff_at, protocol, ports (array), product, window_start, window_end,
    registered_at; null or empty conditions hold. The full table has a row for each host and set by
    definition, so sets (few, defined by hand) go out to the hosts."""
    hits = _matches(sets, services)
    effective = F.coalesce("h.observed_at", "h.collected_at")
    own = ["h.observation_id", "h.host_observed", "h.collected_at", effective.alias("effective_at")]
    if excluded:
        # a host meets its sets before it goes out to all of them, so that it is moved once
        of_host = hits.groupBy("observation_id").agg(F.collect_set("reference_set_id").alias("_hits"))
        told = hosts.alias("h").join(of_host, "observation_id", "left").join(broadcast_if_few(sets).alias("r"), F.lit(True))
        told = told.select("r.*", *own, F.when(F.array_contains("_hits", F.col("r.reference_set_id")), True).alias("hit"))
    else:
        told = hosts.alias("h").join(hits, "observation_id").join(broadcast_if_few(sets).alias("r"), "reference_set_id").select("r.*", *own, F.lit(True).alias("hit"))
    reason = (
        F.when((F.col("collected_at") > F.col("cutoff_at")) | (F.col("effective_at") > F.col("cutoff_at")), "after_cutoff").when(~F.col("host_observed"), "not_observable")
        .when(F.col("window_start").isNotNull() & ~F.col("effective_at").between(F.col("window_start"), F.col("window_end")), "time_window_mismatch").when(F.col("hit").isNull(), "stratum_mismatch")
    )
    told = told.withColumn("exclusion_reason", reason)
    told = told.select(joined_id("reference-membership", F.col("reference_set_id"), F.col("observation_id")).alias("membership_id"), "reference_set_id", "observation_id", F.col("exclusion_reason").isNull().alias("observable"), "exclusion_reason", F.col("registered_at").alias("matched_at"))
    return told if excluded else told.where("observable")


def feature_stats(catalog: DataFrame, observations: DataFrame, sets: DataFrame, members: DataFrame, anchors: DataFrame, manifest: bool = False) -> DataFrame:
    """Statistics of every feature in every set.

    anchors: reference_set_id, observation_id. Observations after the set's cutoff do not count. The
    feature side is reduced to (feature, observation) once; anchors and background meet it in one
    join on the observation, so the cost is that of the observations and not features times sets.
    """
    small = is_few(sets)
    few = sets.select("reference_set_id", "cutoff_at")
    few = F.broadcast(few) if small else few
    sample = anchors.select("reference_set_id", "observation_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(members.where("observable").select("reference_set_id", "observation_id", F.lit(0), F.lit(1)))
    # both sides are dealt out by observation once: their groups and the join stay within an observation
    sample = sample.repartition("observation_id").groupBy("reference_set_id", "observation_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    totals = sample.groupBy("reference_set_id").agg(F.sum("a").alias("anchor_denominator"), F.sum("b").alias("background_denominator"))
    seen = observations.select("feature_id", "observation_id", "available_at", "observed_at").repartition("observation_id").groupBy("feature_id", "observation_id").agg(F.min(F.greatest("available_at", F.coalesce("observed_at", "available_at"))).alias("known_at"))
    hits = seen.join(sample, "observation_id").join(few, "reference_set_id").where("known_at <= cutoff_at")
    counts = hits.groupBy("feature_id", "reference_set_id").agg(F.sum("a").alias("anchor_numerator"), F.sum("b").alias("background_numerator"))
    if manifest:
        row = sha256_text(F.concat_ws("|", "observation_id", F.col("a").cast("string"), F.col("b").cast("string")))
        counts = counts.join(group_hash(hits, ["feature_id", "reference_set_id"], row, "source_manifest_hash"), ["feature_id", "reference_set_id"])
    totals = F.broadcast(totals) if small else totals  # a row for each set
    every = catalog.select("feature_id").join(few, F.lit(True)).join(totals, "reference_set_id", "left")
    told = every.join(counts, ["feature_id", "reference_set_id"], "left").na.fill(0, ["anchor_numerator", "background_numerator", "anchor_denominator", "background_denominator"])
    n = {c: F.col(c).cast("double") for c in ("anchor_numerator", "anchor_denominator", "background_numerator", "background_denominator")}
    support = F.when(n["anchor_denominator"] == 0, 0.0).otherwise(n["anchor_numerator"] / n["anchor_denominator"])
    prevalence = F.when(n["background_denominator"] == 0, 0.0).otherwise(n["background_numerator"] / n["background_denominator"])
    told = told.withColumn("anchor_support", support).withColumn("background_prevalence", prevalence).withColumn("reference_lift", lift(F.col("anchor_support"), F.col("background_prevalence")))
    for side in ("anchor", "background"):
        low, high = wilson(n[f"{side}_numerator"], n[f"{side}_denominator"])
        told = told.withColumn(f"{side}_ci_low", low).withColumn(f"{side}_ci_high", high)
    return told


def assess(stats: DataFrame, catalog: DataFrame, min_anchors: int = 2, min_support: float = 0.5, max_prevalence: float = 0.1) -> DataFrame:
    """stats with status (candidate or blocked) and the sorted reason_codes."""
    told = stats.join(catalog.select("feature_id", "first_available_at", "stability", "query_field", "shared_or_default"), "feature_id")
    c = F.col
    reasons = {
        "available_after_cutoff": c("first_available_at") > c("cutoff_at"), "unstable_field": c("stability") == "unstable",
        "query_field_unavailable": (c("stability") == "unavailable") | (F.coalesce(c("query_field"), F.lit("")) == ""), "shared_or_default": c("shared_or_default"),
        "insufficient_distinct_anchors": c("anchor_numerator") < min_anchors, "insufficient_anchor_support": c("anchor_support") < min_support,
        "matched_background_missing": c("background_denominator") == 0, "background_too_common": (c("background_denominator") > 0) & (c("background_prevalence") > max_prevalence),
    }
    codes = F.array_sort(F.array_compact(F.array(*[F.when(cond, k) for k, cond in reasons.items()])))
    return told.withColumn("reason_codes", codes).withColumn("status", F.when(F.size("reason_codes") > 0, "blocked").otherwise("candidate"))


def eligible(assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with an accepted review that is not older than the assessment."""
    told = assessments.join(reviews.select("assessment_id", "decision", "reviewed_at"), "assessment_id", "left")
    return told.withColumn("eligible", F.coalesce((F.col("status") == "candidate") & (F.col("decision") == "accepted") & (F.col("reviewed_at") >= F.col("assessed_at")), F.lit(False)))


def eligible_sets(eligible_rows: DataFrame) -> DataFrame:
    """feature_id and the reference sets of its eligible assessments."""
    return eligible_rows.where("eligible").groupBy("feature_id").agg(F.sort_array(F.collect_set("reference_set_id")).alias("reference_set_ids"))
