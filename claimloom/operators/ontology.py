"""Ontology evolution: what stands against a proposal, and the gate that makes a release current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, exact_keys, quoted
from ..functions.turtle import TurtleError, parse
from ..sources import artefacts
from . import shacl

SHAPES_FOR = f"{shacl.SH}NodeShape"


def research_diagnostics(changes: DataFrame, assessments: DataFrame) -> DataFrame:
    """(term, ord, diagnostic) of changes (term, kind, external_terms) against assessments (term, suitable, ord). The last assessment of a term holds."""
    last = assessments.groupBy("term").agg(F.max_by("suitable", "ord").alias("suitable"))
    each = changes.select("term", "kind", F.explode_outer("external_terms").alias("external"))
    met = each.join(last.select(F.col("term").alias("external"), "suitable"), "external", "left").groupBy("term", "kind").agg(
        F.coalesce(F.bool_or(F.col("external").isNotNull() & F.col("suitable").isNull()), F.lit(False)).alias("lacking"),
        F.coalesce(F.bool_or("suitable"), F.lit(False)).alias("some"),
    )
    own = met.join(last.select("term", F.col("suitable").alias("own")), "term", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    invents, reuses = F.col("kind") == "local_invention", F.col("kind") == "external_reuse"
    named = F.concat(F.lit("Ontology change "), quoted(F.col("term")), F.lit(" "))
    rules = (
        (F.col("lacking"), "lacks recorded external-term research."),
        (invents & F.col("some"), "invents locally despite a suitable external term."),
        (reuses & ~F.col("some"), "does not identify a suitable reused term."),
        (reuses & ~F.col("own"), "must reuse an evidenced external term."),
    )
    told = F.array(*[F.struct(F.lit(i).alias("ord"), F.when(bad, F.concat(named, F.lit(text))).alias("diagnostic")) for i, (bad, text) in enumerate(rules)])
    return own.select("term", F.inline(told)).where("diagnostic is not null")


def absent_terms(terms: DataFrame, triples: DataFrame) -> DataFrame:
    """terms (source, term) that are neither subject, predicate nor object of their source's triples."""
    there = triples.select("source", F.explode(F.array("s", "p", "o")).alias("term")).distinct()
    return terms.join(there, ["source", "term"], "left_anti")


def reference_diagnostics(references: DataFrame, store: DataFrame) -> DataFrame:
    """references (role, sha256, kind) with diagnostic where the store (sha256, kind) lacks one or has it under another kind."""
    held = store.select("sha256", F.col("kind").alias("held")).distinct()
    joined = references.join(held, "sha256", "left")
    return joined.withColumn("diagnostic", F.when(F.col("held").isNull(), F.concat("role", F.lit(" is missing."))).when(F.col("held") != F.col("kind"), F.concat("role", F.lit(" has another kind.")))).drop("held")


def claim_diagnostics(reconsidered: DataFrame, prior: DataFrame) -> DataFrame:
    """reconsidered (claim_id, candidate) with diagnostic: unknown, another candidate than before, or named twice."""
    before = prior.select("claim_id", F.col("candidate").alias("was"))
    n = reconsidered.groupBy("claim_id").agg(F.count("*").alias("n"))
    joined = reconsidered.join(before, "claim_id", "left").join(n, "claim_id")
    return joined.withColumn("diagnostic", F.when(F.col("n") > 1, "named twice").when(F.col("was").isNull(), "unknown").when(F.col("was") != F.col("candidate"), "another candidate")).drop("was", "n")


def release_diagnostics(ontology: str, shapes: str) -> list[str]:
    """What is wrong with a proposed release's two Turtle texts."""
    out = []
    try:
        parse(ontology)
    except TurtleError:
        out.append("Proposed Ontology release is not valid Turtle.")
    try:
        if not any(o == SHAPES_FOR for _, _, o, *_ in parse(shapes)):
            out.append("Proposed SHACL release defines no NodeShape.")
        else:
            shacl.read_shapes(shapes)
    except TurtleError:
        out.append("Proposed SHACL release is not valid Turtle.")
    except shacl.ShapeError as error:
        out.append(f"Proposed SHACL release is not valid SHACL: {error}.")
    return out


def gate(current: str, proposed: str, diagnostics: DataFrame) -> tuple[str, DataFrame]:
    """The release that is current after a proposal, and all that stood against it, in order."""
    told = diagnostics.where("diagnostic is not null").orderBy("ord").select("diagnostic")
    return (proposed if told.isEmpty() else current), told


#: The stages whose decisions a proposal rests on.
STAGES = ("researcher", "proposer", "critic", "synthesiser")


def vendor(rows: DataFrame, path: str, payload: str = "payload") -> DataFrame:
    """Stores external ontology artefacts before they can influence a proposal; gives their references."""
    return artefacts.write(rows, path, "external-ontology", payload)


def record_decision(rows: DataFrame, path: str, payload: str = "payload") -> DataFrame:
    """Stores decisions, JSON objects with a stage of STAGES; others are refused by an error."""
    if not rows.where(~F.coalesce(F.get_json_object(payload, "$.stage").isin(*STAGES), F.lit(False))).isEmpty():
        raise ValueError("a decision's stage is unknown")
    return artefacts.write(rows, path, "ontology-decision", payload)


def prompt_error(gap: DataFrame, mappings: DataFrame, external: DataFrame, store: DataFrame) -> DataFrame:
    """(research_id, diagnostic) of research prompted by gap (research_id, identity, kind): it must be a stored claim mapping with the disposition
    ontology_gap, and all that external (research_id, identity) names must have been vendored; mappings has identity and disposition, store identity and kind."""
    known = mappings.select(F.col("identity").alias("m_"), "disposition").dropDuplicates(["m_"])
    told = F.when(F.col("kind") != "claim-mapping", "Research must be prompted by a Claim mapping.").when(
        ~F.coalesce(F.col("disposition") == "ontology_gap", F.lit(False)), "Research must be prompted by an Ontology-gap Claim."
    )
    first = gap.join(known, F.col("identity") == F.col("m_"), "left").select("research_id", told.alias("diagnostic"))
    vendored = store.where("kind = 'external-ontology'").select("identity").distinct()
    second = external.join(vendored, "identity", "left_anti").select("research_id", F.lit("Reference does not identify an external Ontology artefact.").alias("diagnostic"))
    return first.where("diagnostic is not null").union(second).distinct()


def prompt_research(rows: DataFrame, path: str) -> DataFrame:
    """Stores research (columns research, JSON of an object, and ontology_gap, a reference struct) with the claim that prompted it."""
    inner = F.substring(F.rtrim("research"), F.lit(1), F.length(F.rtrim("research")) - 1)
    comma = F.when(F.size(F.json_object_keys("research")) > 0, ",").otherwise("")
    body = F.concat(inner, comma, F.lit('"ontology_gap":'), F.to_json("ontology_gap"), F.lit("}"))
    return artefacts.write(rows.select(canonical_json(body).alias("payload")), path, "ontology-research")


def causal_diagnostics(references: DataFrame, store: DataFrame) -> DataFrame:
    """(ord, diagnostic) of a proposal's references (role, identity, kind) against the store (identity, kind, payload): research first, then a decision of each stage."""
    place = F.array_position(F.array(*[F.lit(r) for r in ("research", *STAGES)]), F.col("role"))
    wanted = F.when(F.col("role") == "research", "ontology-research").otherwise("ontology-decision")
    held = store.select(F.col("identity").alias("i_"), F.col("kind").alias("k_"), "payload").dropDuplicates(["i_", "k_"])
    joined = references.join(held, (F.col("identity") == F.col("i_")) & (F.col("kind") == F.col("k_")), "left")
    stage = F.get_json_object("payload", "$.stage")
    told = (
        F.when(F.col("kind") != wanted, F.concat(F.lit("Expected "), wanted, F.lit(" causal artefact.")))
        .when(F.col("i_").isNull(), F.concat(F.lit("Causal artefact "), F.col("identity"), F.lit(" is invalid.")))
        .when((F.col("role") != "research") & ~stage.eqNullSafe(F.col("role")), F.concat(F.lit("Causal artefact "), F.col("identity"), F.lit(" is not a "), F.col("role"), F.lit(" decision.")))
    )
    return joined.select(place.alias("ord"), told.alias("diagnostic")).where("diagnostic is not null")


def gap_diagnostics(research: DataFrame, mappings: DataFrame, reconsidered: DataFrame) -> DataFrame:
    """research (proposal_id, payload) with diagnostic: its gap must name a stored claim mapping that is an ontology gap, and a reconsideration
    (proposal_id, previous) of the proposal must take that mapping up."""
    gap = F.get_json_object("payload", "$.ontology_gap")
    sound = exact_keys(gap, "identity", "kind", "schema_version") & (F.get_json_object(gap, "$.kind") == "claim-mapping")
    rows = research.withColumn("gap_", gap).withColumn("named_", F.when(F.coalesce(sound, F.lit(False)), F.get_json_object(gap, "$.identity")))
    gaps = mappings.where("disposition = 'ontology_gap'").select(F.col("identity").alias("m_")).distinct()
    taken = reconsidered.select(F.col("proposal_id").alias("p_"), F.col("previous").alias("r_")).distinct()
    joined = rows.join(gaps, F.col("named_") == F.col("m_"), "left").join(taken, (F.col("proposal_id") == F.col("p_")) & (F.col("named_") == F.col("r_")), "left")
    told = (
        F.when(F.col("gap_").isNull(), "Ontology research record has no Ontology-gap Claim.")
        .when(F.col("m_").isNull(), "Ontology research record has an invalid Ontology-gap Claim.")
        .when(F.col("r_").isNull(), "The Ontology-gap Claim that prompted research must be reconsidered.")
    )
    return joined.select(*research.columns, told.alias("diagnostic"))


def consider(spark, path: str, ontology: str, shapes: str, diagnostics: DataFrame, reconsidered: DataFrame, current: str | None) -> tuple[str | None, bool]:
    """Stores a proposal's releases always, its new claim mappings (reconsidered: payload) only where nothing stands against it, and a record of the outcome;
    the pointer under path moves only then. diagnostics has ord and diagnostic. Gives the current release and whether it is the new one."""
    import json

    one = lambda kind, value: artefacts.write(spark.range(1).select(F.lit(json.dumps(value)).alias("payload")), f"{path}/store", kind).first().reference
    told = [(-1, d) for d in release_diagnostics(ontology, shapes)]
    shacl_release = one("shacl-release", {"turtle": shapes})
    release = one("ontology-release", {"shacl_release": shacl_release.asDict(), "turtle": ontology})
    active, stood = gate(current, release.identity, diagnostics if not told else diagnostics.select("ord", "diagnostic").limit(0).union(spark.range(1).select(F.lit(-1), F.lit(told[0][1]))))
    accepted = active == release.identity and not told
    if accepted:
        artefacts.write(reconsidered, f"{path}/store", "claim-mapping")
        artefacts.set_pointer(spark, f"{path}/current", release.identity)
    all_told = diagnostics.where("diagnostic is not null").select(F.col("ord").cast("long"), "diagnostic")
    if told:
        all_told = all_told.union(spark.createDataFrame(told, "ord long, diagnostic string"))
    listed = all_told.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "diagnostic"))), lambda x: x["diagnostic"])).alias("d"))
    head = json.dumps({"current_release": release.identity if accepted else current, "ontology_release": release.asDict(), "shacl_release": shacl_release.asDict(), "status": "accepted" if accepted else "failed"})
    record = listed.select(F.concat(F.lit(head[:-1] + ',"diagnostics":'), "d", F.lit("}")).alias("payload"))
    artefacts.write(record, f"{path}/store", "ontology-evolution").collect()
    return (release.identity if accepted else current), accepted


def size_measures(triples: DataFrame) -> DataFrame:
    """One row: classes, properties, axioms."""
    kind = lambda *names: F.count_if((F.col("p") == f"{shacl.RDF}type") & F.regexp_extract("o", r"([A-Za-z]+)$", 1).isin(*names))
    return triples.agg(kind("Class").alias("classes"), kind("ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Property").alias("properties"), F.count("*").alias("axioms"))
