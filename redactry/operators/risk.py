"""Counts, tiers and triage order of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.functions.rules import SEVERITY
from redactry.operators.running import running_total


def weighed(spans: DataFrame) -> DataFrame:
    """Spans with ``tier`` and ``weight``; types outside the table weigh 0 and have no tier."""
    tier = F.create_map(*[F.lit(x) for t, (n, _) in SEVERITY.items() for x in (t, n)])
    weight = F.create_map(*[F.lit(x) for t, (_, w) in SEVERITY.items() for x in (t, w)])
    return spans.withColumn("tier", F.element_at(tier, F.col("entity_type"))).withColumn("weight", F.coalesce(F.element_at(weight, F.col("entity_type")), F.lit(0)))


def entity_counts(spans: DataFrame, id_col: str) -> DataFrame:
    return spans.groupBy(id_col, "entity_type").agg(F.count("*").alias("n"))


def document_risk(docs: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """(id, critical, sensitive, review, total_entities, risk_score) of every document, 0 where nothing is found."""
    count = lambda t: F.count(F.when(F.col("tier") == t, 1)).alias(t)
    found = weighed(spans).groupBy(id_col).agg(count("critical"), count("sensitive"), count("review"), F.count("*").alias("total_entities"), F.sum("weight").cast("bigint").alias("risk_score"))
    return docs.select(id_col).join(found, id_col, "left").fillna(0, ["critical", "sensitive", "review", "total_entities", "risk_score"])


def ranked(risk: DataFrame, id_col: str) -> DataFrame:
    """With ``risk_rank``: the riskiest first, ties by id. No task holds the whole table."""
    return running_total(risk, [], [F.col("risk_score").desc(), F.col(id_col)], F.lit(1), "risk_rank").withColumn("risk_rank", F.col("risk_rank").cast("bigint"))


def corpus_totals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity_type").agg(F.count("*").alias("n"))


def report(risk: DataFrame, totals: DataFrame, id_col: str, top: int = 100) -> str:
    """A Markdown report: sums, the ``top`` riskiest documents and the types; only these reach the driver."""
    s = risk.agg(F.count("*").alias("docs"), *(F.sum(c).alias(c) for c in ("total_entities", "critical", "sensitive", "review"))).first()
    lines = ["# Sensitive data report", "", f"{s.docs} documents, {s.total_entities or 0} findings: {s.critical or 0} critical, {s.sensitive or 0} sensitive, {s.review or 0} to review.", "", "| Rank | Document | Risk | Critical | Sensitive | Review | Total |", "|---|---|---|---|---|---|---|"]
    for i, r in enumerate(risk.orderBy(F.col("risk_score").desc(), id_col).limit(top).collect(), 1):
        lines.append(f"| {i} | {r[id_col]} | {r.risk_score} | {r.critical} | {r.sensitive} | {r.review} | {r.total_entities} |")
    lines += ["", "| Type | Findings | Tier |", "|---|---|---|"]
    lines += [f"| {r.entity_type} | {r.n} | {SEVERITY.get(r.entity_type, ('',))[0]} |" for r in totals.orderBy(F.col("n").desc(), "entity_type").collect()]
    return "\n".join(lines) + "\n"


def nearest_rank(df: DataFrame, group_col: str, value_col: str, share: float = 0.95) -> DataFrame:
    """(group, mean, nearest_rank): the value at place int(n * share), at least the first; nulls don't count.

    Equal values are counted first, and the place is found on running totals of the counts.
    """
    counts = df.where(F.col(value_col).isNotNull()).groupBy(group_col, value_col).agg(F.count("*").alias("_n"))
    upto = running_total(counts, [group_col], [F.col(value_col)], F.col("_n"), "_upto")
    totals = counts.groupBy(group_col).agg((F.sum(F.col(value_col) * F.col("_n")) / F.sum("_n")).alias("mean"), F.greatest(F.floor(F.sum("_n") * share), F.lit(1)).alias("_place"))
    joined = upto.withColumnRenamed(group_col, "_g").join(totals, F.col("_g").eqNullSafe(F.col(group_col)))
    return joined.groupBy(group_col).agg(F.first("mean").alias("mean"), F.min(F.when(F.col("_upto") >= F.col("_place"), F.col(value_col))).alias("nearest_rank"))
