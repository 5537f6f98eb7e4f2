"""Measures over claims and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def disposition_counts(claims: DataFrame, by: str, kind: str, kinds: list) -> DataFrame:
    return claims.groupBy(by).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0)


def cluster_measures(rows: DataFrame, by: str, cluster: str) -> DataFrame:
    """For each group: rows, clusters, entropy (nats), largest cluster and its share."""
    sizes = rows.groupBy(by, cluster).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return sizes.groupBy(by).agg(F.sum("n").alias("rows"), F.count("*").alias("clusters"), F.round(-F.sum(F.col("share") * F.log("share")), 6).alias("entropy"), F.max("n").alias("largest"), F.round(F.max("share"), 6).alias("largest_share"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of edges (s, o)."""
    ends = edges.select(F.col("s").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("o", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").cast("long").alias("out_degree"), F.sum("in").cast("long").alias("in_degree"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of edges (s, o), undirected: labels fall to neighbours' least, then to their label's label, checkpointed every round."""
    both = edges.select("s", "o").union(edges.select("o", "s")).distinct()
    _keep_checkpoints(both)
    both = both.checkpoint()
    labels = both.groupBy("s").agg(F.least(F.min("o"), F.min("s")).alias("label")).withColumnRenamed("s", "node").checkpoint()
    for _ in range(rounds):
        near = both.join(labels, both.o == labels.node).groupBy("s").agg(F.min("label").alias("near"))
        fallen = labels.join(near, F.col("node") == F.col("s"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = fallen.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        jumped = fallen.join(up, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", "upper").alias("label")).checkpoint()
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def _keep_checkpoints(df: DataFrame) -> None:
    """The shared folder for checkpoints."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))


def pagerank(edges: DataFrame, steps: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of steps over distinct edges (s, o); what dangling nodes hold is lost to none: it is spread evenly."""
    _keep_checkpoints(edges)
    links = edges.select("s", "o").distinct()
    links = links.join(links.groupBy("s").agg(F.count("*").alias("d")), "s").checkpoint()
    nodes = links.select(F.col("s").alias("node")).union(links.select("o")).distinct().checkpoint()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for step in range(steps):
        given = links.join(ranks, links.s == ranks.node).groupBy("o").agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        held = given.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("h"))
        base = F.lit((1 - damping) / n) + F.lit(damping / n) * (1 - F.col("h"))
        ranks = nodes.join(given, nodes.node == given.o, "left").crossJoin(F.broadcast(held)).select("node", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))  # held is one row
        if step % 3 == 2:
            ranks = ranks.checkpoint()
    return ranks


def cut_points(edges: DataFrame) -> DataFrame:
    """(component, kind, a, b): bridges (a, b) and articulation points (a) of the undirected graph, component by component. A component must fit a task; it is meant for the graphs of one projection."""
    import pandas as pd

    both = edges.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).where("a <> b").distinct()
    labelled = both.join(components(edges).withColumnRenamed("node", "a"), "a")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(part["a"], part["b"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        seen: dict = {}
        low: dict = {}
        found = []
        for root in sorted(near):
            if root in seen:
                continue
            seen[root] = low[root] = len(seen)
            stack, children = [(root, None, iter(near[root]))], 0
            while stack:
                node, parent, rest = stack[-1]
                for other in rest:
                    if other == parent:
                        continue
                    if other in seen:
                        low[node] = min(low[node], seen[other])
                    else:
                        seen[other] = low[other] = len(seen)
                        children += node == root
                        stack.append((other, node, iter(near[other])))
                        break
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[node])
                        if low[node] > seen[parent]:
                            found.append(("bridge", min(parent, node), max(parent, node)))
                        if parent != root and low[node] >= seen[parent]:
                            found.append(("articulation", parent, None))
            if children > 1:
                found.append(("articulation", root, None))
        out = pd.DataFrame(sorted(set(found), key=str), columns=["kind", "a", "b"])
        out.insert(0, "component", part["component"].iloc[0])
        return out

    kind = labelled.schema["a"].dataType.simpleString()
    return labelled.groupBy("component").applyInPandas(search, f"component {kind}, kind string, a {kind}, b {kind}")


def deltas(counts: DataFrame, order: str, *measures: str) -> DataFrame:
    """counts with the change of each measure since the row before. One row for each point of time: the window has no partition because there are few."""
    w = Window.orderBy(order)
    return counts.select("*", *[(F.col(m) - F.coalesce(F.lag(m).over(w), F.lit(0))).alias(f"{m}_change") for m in measures])


def running(counts: DataFrame, order: str, *measures: str) -> DataFrame:
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("*", *[F.sum(m).over(w).alias(f"{m}_so_far") for m in measures])


def uncovered(concepts: DataFrame, coverage: DataFrame, key: str, last: str, fresh_until: Column) -> DataFrame:
    """concepts with status: "missing" without coverage, "stale" if its last is before fresh_until, else "covered"."""
    newest = coverage.groupBy(key).agg(F.max(last).alias("last_"))
    joined = concepts.join(newest, key, "left")
    return joined.withColumn("status", F.when(F.col("last_").isNull(), "missing").when(F.col("last_") < fresh_until, "stale").otherwise("covered")).drop("last_")


#: Which reason tells why a claim of a disposition does not fit.
WHY = {"ontology_gap": "mapping", "constraint_violation": "validation", "conflict": "conflict", "out_of_scope": "scope"}


def misfits(mappings: DataFrame) -> DataFrame:
    """(claim_id, disposition, reason) of claims that are not accepted."""
    told = F.coalesce(*[F.when(F.col("disposition") == d, F.col(c)) for d, c in WHY.items()], F.col("acceptance"))
    return mappings.where("disposition <> 'accepted'").select("claim_id", "disposition", told.alias("reason"))


def known_about(quads: DataFrame, term: str) -> DataFrame:
    """Triples whose subject, or object as an IRI, is term; in whatever graph, each once."""
    return quads.where((F.col("s") == term) | ((F.col("o") == term) & (F.col("o_kind") == "iri"))).select("s", "p", "o", "o_kind").distinct()


def gap_measures(rows: DataFrame, period: str, cluster: str, source: str, is_gap: Column) -> DataFrame:
    """For each period: rows, gaps and their rate, clusters, those never seen before, and distinct sources."""
    first = rows.groupBy(cluster).agg(F.min(period).alias("first_"))
    gap = F.count_if(is_gap)
    return rows.join(first, cluster).groupBy(period).agg(
        F.count("*").alias("rows"), gap.alias("gaps"), F.round(gap / F.count("*"), 6).alias("gap_rate"), F.count_distinct(cluster).alias("clusters"),
        F.count_distinct(F.when(F.col(period) == F.col("first_"), F.col(cluster))).alias("new_clusters"), F.count_distinct(source).alias("sources"),
    )
