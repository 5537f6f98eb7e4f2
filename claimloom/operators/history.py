"""Histories of entity decisions: rows (decision_id, kind, previous_id, reversed_id, sources, targets, ...), each naming the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, sha_identity
from ..sources.scratch import written

KINDS = ("resolution", "merge", "split", "reversal")


def decision_id(body: Column) -> Column:
    """An id made of the decision's content, its own id left empty."""
    return F.concat(F.lit("entity-decision:"), sha_identity(canonical_json(body)))


def decision_error(kind: Column, sources: Column, targets: Column) -> Column:
    """First broken rule: a merge takes two or more distinct sources to one target that is none of them, a split one source to two or more such targets."""
    distinct = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    merge, split = kind == "merge", kind == "split"
    rules = [
        (~kind.isin(*KINDS), "kind"),
        (merge & ((F.size(sources) < 2) | ~distinct(sources)), "sources"),
        (merge & ((F.size(targets) != 1) | F.arrays_overlap(sources, targets)), "target"),
        (split & ((F.size(targets) < 2) | ~distinct(targets)), "targets"),
        (split & ((F.size(sources) != 1) | F.arrays_overlap(sources, targets)), "source"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])


def context_error(candidates: Column, most: Column, evidence: Column) -> Column:
    """First broken rule of a resolution's context: bounded, not truncated."""
    rules = [(F.size(evidence) == 0, "evidence"), (most < 1, "maximum"), (F.size(candidates) > most, "candidates"), (F.size(F.array_distinct(candidates)) != F.size(candidates), "unique")]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])


def outcome_error(kind: Column, entity: Column, candidates: Column) -> Column:
    """An existing entity is one of the candidates, a provisional one is not."""
    known = F.coalesce(F.array_contains(candidates, entity), F.lit(False))
    return F.when((kind == "existing") & ~known, "existing").when((kind == "provisional") & known, "provisional").when(~kind.isin("existing", "provisional", "unresolved"), "kind")


def walk(decisions: DataFrame) -> DataFrame:
    """decisions with step, the oldest of each chain 0, and diagnostic: "missing" where a chain's first link is not there, "cycle" where it has none; step is null there.

    Pointers double: each round joins every row with the row that its pointer names, so that a chain of n takes log2(n) rounds, each written."""
    ids = decisions.select("decision_id", "previous_id").dropDuplicates(["decision_id"])
    step = F.when(F.col("previous_id").isNull(), 0).otherwise(1).cast("long")
    state = written(ids.select("decision_id", F.col("previous_id").alias("hop"), step.alias("step"), F.lit(None).cast("string").alias("diagnostic")), "chain")
    n = state.count()
    while not state.where("hop is not null").isEmpty():
        up = state.select(F.col("decision_id").alias("u"), F.col("hop").alias("u_hop"), F.col("step").alias("u_step"), F.col("diagnostic").alias("u_diagnostic"))
        met = state.join(up, F.col("hop") == F.col("u"), "left")
        far = F.col("step") + F.coalesce("u_step", F.lit(0))
        told = F.when(F.col("hop").isNull(), F.col("diagnostic")).when(F.col("u").isNull(), "missing").when(F.col("u_diagnostic").isNotNull(), F.col("u_diagnostic")).when(far > n, "cycle")
        state = written(met.select("decision_id", F.when(told.isNull(), F.col("u_hop")).alias("hop"), far.alias("step"), told.alias("diagnostic")), "chain")
    known = state.select("decision_id", F.when(F.col("diagnostic").isNull(), F.col("step").cast("int")).alias("step"), "diagnostic")
    return decisions.join(known, "decision_id", "left")


def heads(decisions: DataFrame) -> DataFrame:
    """The newest decision of each chain: those that no decision follows."""
    followed = decisions.where("previous_id is not null").select(F.col("previous_id").alias("f_")).distinct()
    return decisions.join(followed, F.col("decision_id") == F.col("f_"), "left_anti")


def body(kind: Column, sources: Column, targets: Column, reversed_id: Column, provenance: Column) -> Column:
    """A decision's content as JSON: what its id is made of."""
    return F.to_json(F.struct(kind.alias("kind"), sources.alias("sources"), targets.alias("targets"), reversed_id.alias("reversed_id"), provenance.alias("provenance")))


def append(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """new (previous_id or null for a new chain, kind, sources, targets, reversed_id, provenance) as decisions: with decision_id and error.

    error names the first broken rule: those of decision_error, "head" where previous_id is no chain's newest decision, "reversed" where a reversal names no merge or split."""
    made = new.withColumn("decision_id", decision_id(body(*[F.col(c) for c in ("kind", "sources", "targets", "reversed_id", "provenance")])))
    newest = heads(decisions).select(F.col("decision_id").alias("h_")).distinct()
    open_ = active(decisions).select(F.col("decision_id").alias("m_")).distinct()
    joined = made.join(newest, F.col("previous_id") == F.col("h_"), "left").join(open_, F.col("reversed_id") == F.col("m_"), "left")
    error = F.coalesce(
        decision_error(F.col("kind"), F.col("sources"), F.col("targets")), F.when(F.col("previous_id").isNotNull() & F.col("h_").isNull(), "head"),
        F.when((F.col("kind") == "reversal") & F.col("m_").isNull(), "reversed"),
    )
    return joined.withColumn("error", error).drop("h_", "m_")


def identity_error(decisions: DataFrame) -> DataFrame:
    """decisions with error "decision_id" where the content gives another id than the stored one."""
    own = decision_id(body(*[F.col(c) for c in ("kind", "sources", "targets", "reversed_id", "provenance")]))
    return decisions.withColumn("error", F.when(~F.col("decision_id").eqNullSafe(own), "decision_id"))


def active(decisions: DataFrame) -> DataFrame:
    """Merges and splits that no reversal names."""
    undone = decisions.where("kind = 'reversal'").select(F.col("reversed_id").alias("gone")).distinct()
    return decisions.where("kind in ('merge', 'split')").join(undone, F.col("decision_id") == F.col("gone"), "left_anti")


def reversal_error(reversals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reversals with error: "missing" if they name no decision, "kind" if it is neither merge nor split, else null."""
    named = decisions.select(F.col("decision_id").alias("n"), F.col("kind").alias("k"))
    joined = reversals.join(named, F.col("reversed_id") == F.col("n"), "left")
    return joined.withColumn("error", F.when(F.col("n").isNull(), "missing").when(~F.col("k").isin("merge", "split"), "kind")).drop("n", "k")


def identity_map(decisions: DataFrame) -> DataFrame:
    """(source, target) of all active merges and splits."""
    return active(decisions).select(F.explode("sources").alias("source"), "targets").select("source", F.explode("targets").alias("target")).distinct()
