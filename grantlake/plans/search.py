"""One search from query to ordered cards. Control flow is on the driver; rows stay in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.operators import eligibility, results, retrieval
from grantlake.operators.safety import crisis
from grantlake.sources.shared import cut_lineage


@dataclass
class Node:
    """A need in the tree that a user walks: what to search, what to allow and what to favour."""

    id: str
    concept: str = ""
    kind: str = "leaf"
    allowed: list[str] = field(default_factory=list)
    boost_categories: list[str] = field(default_factory=list)
    boost_words: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def find(self, node_id: str) -> Node | None:
        if self.id == node_id:
            return self
        return next((f for c in self.children if (f := c.find(node_id))), None)

    def choices(self) -> list[Node]:
        return [c for c in self.children if c.kind != "safety"]


@dataclass
class Outcome:
    crisis: bool = False
    rows: DataFrame | None = None
    degraded: bool = False
    alternatives: list[Node] = field(default_factory=list)


def is_crisis(like: DataFrame, query: str) -> bool:
    one = like.sparkSession.range(1).select(crisis(F.lit(query))["crisis"].alias("c"))
    return bool(one.first()["c"])


def search(catalogue: DataFrame, root: Node, node_id: str, profile: dict, today: date, query: str | None = None, vector: list[float] | None = None, k: int = 10) -> Outcome:
    """The safety screen comes before any scan; region and category filters below the top-k; then eligibility and order.

    ``catalogue``: normalized rows with text, keywords, vector and updated_at. No candidate, or none that
    may be shown, gives the node's children as alternatives. The few rows found are kept, as they are looked
    at twice; vectors stay out of them. Without a query vector the outcome is marked as degraded.
    """
    node = root.find(node_id)
    text = query if query is not None else (node.concept if node and node is not root else "")
    if is_crisis(catalogue, text):
        return Outcome(crisis=True)
    request = retrieval.clamp_request(text, k, node.allowed if node else None, profile.get("region_code"))
    if node is None or not request["query"]:
        return Outcome(alternatives=node.choices() if node else [])
    open_ = retrieval.compatible(F.col("region_codes"), F.col("is_nationwide"), request["region"])
    index = catalogue.filter(open_ & retrieval.in_categories(F.col("category"), request["categories"]))
    pool = max(8 * request["top_k"], 120)
    arms = [retrieval.keyword_arm(index, request["query"], pool, "keywords")]
    if vector:
        arms.insert(0, retrieval.vector_arm(index, vector, pool))
    ranked = retrieval.fused(arms, pool).join(catalogue.select("id", "category", "keywords"), "id")
    bonus = retrieval.boost(F.col("category"), F.col("keywords"), node.boost_categories, node.boost_words)
    hits = retrieval.top_k(ranked.select("id", (F.col("score") + bonus).alias("score")), request["top_k"])
    who = F.struct(*[F.lit(profile.get(n)).cast(t).alias(n) for n, t in (
        ("age", "double"), ("region_code", "string"), ("median_ratio", "double"), ("amount", "double"),
        ("active_programs", "array<string>"), ("completed_programs", "array<string>"),
    )])
    found = retrieval.resolved(hits, catalogue.drop("vector", "text", "keywords"), index).withColumn("profile", who).withColumn("ordinal", -F.col("score"))
    kept = cut_lineage(results.latest_variants(eligibility.evaluate(found, today).filter("bucket <> 'blocked'")))
    if not kept.limit(1).count():
        return Outcome(alternatives=node.choices(), degraded=not vector)
    return Outcome(rows=results.in_display_order(kept), degraded=not vector)
