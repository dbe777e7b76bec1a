"""Per-project state: pending steps, outcomes, flags and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OUTCOMES = ("completed", "failed", "skipped", "deferred", "excluded")
#: How a context may be closed, and the checks of each mode.
FINAL_STATUSES = ("complete", "partial", "abandoned")
LITE_CHECKS = ("truncation", "applicability_uncertain", "version_sanity", "paysafe_unresolved")
FULL_CHECKS = (*LITE_CHECKS, "stepless_rule", "bridge_eligible")
#: What a scan puts into a context; refreshed whenever it is opened again.
BUCKETS = ("classes", "class_simple", "deps_ga", "dep_artifacts", "props")


def fold(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last event per key; partial aggregation, no window."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return last.select(*keys, *[F.col("e")[c].alias(c) for c in rest])


def outcome_counts(contexts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per context with a count for each outcome."""
    counted = outcomes.groupBy("context_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in OUTCOMES])
    zero = F.lit(0).cast("long")
    return contexts.join(counted, "context_id", "left").select(*contexts.columns, *[F.coalesce(f"{s}_count", zero).alias(f"{s}_count") for s in OUTCOMES])


def prerequisites(steps: DataFrame) -> DataFrame:
    """(step_id, prereq_step_id): the step before it in its rule, if there is one."""
    before = steps.select("rule_id", (F.col("step_index") + 1).alias("step_index"), F.col("step_id").alias("prereq_step_id"))
    return steps.select("step_id", "rule_id", "step_index").join(before, ["rule_id", "step_index"]).select("step_id", "prereq_step_id")


def pending(rules: DataFrame, steps: DataFrame, done: DataFrame, manual: DataFrame, efforts: list[str] = (), scopes: list[str] = ()) -> DataFrame:
    """Steps without an outcome, with manual ones.

    ``rules``: applicable rules with ``scope`` and ``severity``; excluded ones
    are left out.  A scope filter does not drop a graph step: it blanks the
    scope and ranks the severity as unknown, which can exclude an uncertain
    rule.  It does drop manual steps.
    """
    kept = rules
    if scopes:
        fits = F.col("scope").isin(list(scopes))
        rank = F.when(fits, F.col("severity_rank")).otherwise(4)
        kept = (
            rules.withColumn("severity_rank", rank)
            .withColumn("scope", F.when(fits, F.col("scope")))
            .withColumn("applicability", F.when((F.col("applicability") == "uncertain") & (F.col("severity_rank") > 1), "excluded").otherwise(F.col("applicability")))
        )
    kept = kept.where("applicability <> 'excluded'")
    todo = steps.join(done.select("step_id"), "step_id", "left_anti")
    if efforts:
        todo, manual = todo.where(F.col("effort").isin(list(efforts))), manual.where(F.col("effort").isin(list(efforts)))
    if scopes:
        manual = manual.where(F.col("scope").isin(list(scopes)))
    auto = F.when(F.col("auto") & ~F.col("missing_params"), F.col("recipe_id"))
    graph = (
        todo.join(kept.select("rule_id", "scope", "severity_rank", "applicability"), "rule_id")
        .join(prerequisites(steps), "step_id", "left")
        .select("step_id", "step_index", "effort", auto.alias("recipe_id"), "scope", "severity_rank", "applicability", "prereq_step_id")
    )
    own = manual.select(
        "step_id", F.coalesce("step_index", F.lit(9999)).alias("step_index"), "effort", F.lit(None).cast("long").alias("recipe_id"), "scope", "severity_rank",
        F.lit("manual").alias("applicability"), F.lit(None).cast("long").alias("prereq_step_id"),
    )
    return graph.unionByName(own)


def resume_stage(counts: DataFrame) -> DataFrame:
    """Where a context continues; rows need the outcome counts, ``status``, ``has_flags`` and ``pending_count``."""
    total = sum((F.col(f"{s}_count") for s in OUTCOMES), F.lit(0))
    accounted = sum((F.col(f"{s}_count") for s in ("completed", "excluded", "failed", "skipped")), F.lit(0))
    stage = (
        F.when(F.col("status").isin("complete", "partial", "abandoned"), F.lit(None).cast("string"))
        .when(F.col("has_flags") & (F.col("excluded_count") + F.col("completed_count") + F.col("failed_count") == 0), "clarify")
        .when(total == 0, "gap-check")
        .when((F.col("failed_count") > 0) | (F.col("deferred_count") > 0), "execute")
        .when((F.col("pending_count") + total > 0) & (accounted == F.col("pending_count") + total), "feedback")
        .otherwise("execute")
    )
    return counts.withColumn("resume_stage", stage)


def final_status() -> Column:
    """partial if anything was skipped or failed, else complete."""
    return F.when((F.col("skipped_count") > 0) | (F.col("failed_count") > 0), "partial").otherwise("complete")


def auto_resolved(outcomes: DataFrame) -> DataFrame:
    """Deferred steps whose reason (JSON) requires a step of the context that is completed."""
    deferred = outcomes.where("status = 'deferred'").select(
        "context_id", F.col("step_key").alias("deferred_step"), F.get_json_object("reason", "$.requiredChange").try_cast("int").alias("step_key")
    )
    done = outcomes.where("status = 'completed'").select("context_id", "step_key")
    return deferred.join(done, ["context_id", "step_key"], "left_semi").select("context_id", "deferred_step", F.col("step_key").alias("required_step"))


def merge_flags(existing: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """Gap flags without repeats by (type, reference, message), null-safe; first come, first kept."""
    if overwrite:
        return incoming
    both = existing.withColumn("origin", F.lit(0)).unionByName(incoming.withColumn("origin", F.lit(1)))
    keys = ["context_id", "type", "reference", "message"]
    return both.groupBy(*keys).agg(F.min(F.struct("origin", "position")).alias("p")).select(*keys, "p.position", F.col("p.origin").alias("origin"))


def queried_map(updates: DataFrame, limit: int = 500) -> DataFrame:
    """Per context a map of entity to summary, last update wins, cut at ``limit`` characters."""
    last = fold(updates, ["context_id", "entity"], ["at"])
    return last.groupBy("context_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", F.substring("summary", 1, limit).alias("summary"))))).alias("queried")
    )


def sole_in_progress(contexts: DataFrame, group: list[str]) -> DataFrame:
    """The only open context of a group, or how many candidates there are."""
    found = contexts.where("status = 'in-progress'").groupBy(*group).agg(F.count("*").alias("candidates"), F.min("context_id").alias("only"))
    return found.select(*group, "candidates", F.when(F.col("candidates") == 1, F.col("only")).alias("context_id"))


def cap(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of a ranked report, with their rank."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def judge_updates(requests: DataFrame, steps: DataFrame, rules: DataFrame, contexts: DataFrame, bridges: DataFrame, owned: DataFrame) -> DataFrame:
    """The requests (request_id, context_id, step_id, outcome) with ``error_code``, null where the update is accepted.

    In this order: an outcome that is none; a deferral although no bridge
    (``bridges``: rule_id) leads from the step's rule; a step that is neither
    on the context's path (its rule's version in the context's range) nor its
    own (``owned``: context_id, step_id).
    """
    placed = steps.select("step_id", "rule_id").join(rules.select("rule_id", F.col("framework").alias("rule_framework"), "sortable"), "rule_id")
    placed = placed.join(bridges.select("rule_id", F.lit(True).alias("bridged")).distinct(), "rule_id", "left")
    mine = owned.select("context_id", "step_id", F.lit(True).alias("own")).distinct()
    met = (
        requests.join(placed, "step_id", "left")
        .join(contexts.select("context_id", "framework", "from_sortable", "to_sortable"), "context_id", "left")
        .join(mine, ["context_id", "step_id"], "left")
    )
    inside = (F.col("rule_framework") == F.col("framework")) & (F.col("sortable") > F.col("from_sortable")) & (F.col("sortable") <= F.col("to_sortable"))
    off = F.lit(False)
    error = (
        F.when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), off), "invalid_outcome")
        .when((F.col("outcome") == "deferred") & ~F.coalesce("bridged", off), "bridge_not_in_graph")
        .when(~(F.coalesce("own", off) | F.coalesce(inside, off)), "step_not_on_path")
    )
    return met.select(*requests.columns, error.alias("error_code"))


def settled(events: DataFrame) -> DataFrame:
    """Last state of every step (context_id, step_id) of accepted events (outcome, required, at).

    A deferred step whose required step is completed after the deferral is
    completed through its bridge.
    """
    last = fold(events.select("context_id", "step_id", "outcome", "required", "at"), ["context_id", "step_id"], ["at"])
    done = events.where("outcome = 'completed'").groupBy("context_id", F.col("step_id").alias("required")).agg(F.max("at").alias("done_at"))
    met = last.join(done, ["context_id", "required"], "left")
    via = (F.col("outcome") == "deferred") & (F.col("done_at") > F.col("at"))
    return met.select(
        "context_id", "step_id", F.when(via, "completed").otherwise(F.col("outcome")).alias("status"), F.when(via, "bridge").alias("resolved_via")
    )


def opened(existing: DataFrame, requests: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Contexts after each request opened its own, by (project_id, from_sortable, to_sortable), with ``created``.

    A new one is in progress.  One that is there keeps its status and its
    scanned entities; its buckets are those of the request.  With ``versions``
    contexts whose start is no longer in the catalogue are deleted first, and
    so made anew.  Of several requests for one context one counts, the last by
    ``at``.
    """
    keys = ["project_id", "from_sortable", "to_sortable"]
    if versions is not None:
        known = versions.select("framework", F.col("sortable").alias("from_sortable")).distinct()
        existing = existing.join(known, ["framework", "from_sortable"], "left_semi")
    fresh = fold(requests.select(*keys, "framework", "scanned_entities", *BUCKETS, "at"), keys, ["at"])
    new = fresh.select(*keys, F.struct("framework", "scanned_entities", *BUCKETS).alias("new"))
    old = existing.select(*keys, F.struct("framework", "status", "scanned_entities", *BUCKETS).alias("old"))
    either = lambda c: F.when(F.col("old").isNotNull(), F.col("old")[c]).otherwise(F.col("new")[c]).alias(c)
    latest = lambda c: F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col("old")[c]).alias(c)
    return old.join(new, keys, "full_outer").select(
        *keys, either("framework"), F.coalesce("old.status", F.lit("in-progress")).alias("status"), either("scanned_entities"), *map(latest, BUCKETS),
        F.col("old").isNull().alias("created"),
    )


def closed(contexts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts after the closing requests, requests with their error).

    A request (request_id, context_id, final_status, notes, at) with another
    status, or for no context, changes nothing; the last sound one counts.
    """
    there = contexts.select("context_id", F.lit(True).alias("there"))
    error = F.when(~F.coalesce(F.col("final_status").isin(*FINAL_STATUSES), F.lit(False)), "invalid_final_status").when(F.col("there").isNull(), "context_not_found")
    judged = requests.join(there, "context_id", "left").select(*requests.columns, error.alias("error_code"))
    last = fold(judged.where("error_code is null").select("context_id", "final_status", "notes", "at"), ["context_id"], ["at"])
    after = contexts.join(last, "context_id", "left").select(
        *[c for c in contexts.columns if c != "status"], F.coalesce("final_status", "status").alias("status"), F.coalesce("notes", F.lit("")).alias("notes")
    )
    return after, judged


def checks(mode: Column) -> Column:
    """Names of the gap checks of a mode; only ``full``, which no mode is too, has all."""
    return F.when(F.coalesce(mode, F.lit("full")) == "full", F.array(*map(F.lit, FULL_CHECKS))).otherwise(F.array(*map(F.lit, LITE_CHECKS)))
