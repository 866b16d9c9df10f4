"""One reconcile pass: drift, repair plan, report, and the repaired index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.chunking import ChunkConfig, chunk_documents
from tarn.operators.entities import ENTITY_KEY
from tarn.operators.lineage import detect_drift, reconcile_report, repair_plan
from tarn.session import durable
from tarn.sources.index_table import replace_reps


@dataclass
class Reconciled:
    """The result of a pass."""

    plan: DataFrame
    report: DataFrame
    staged: DataFrame
    index: DataFrame


def reconcile(dirs: DataFrame, meta: DataFrame, reps: DataFrame, index: DataFrame, sources: DataFrame,
              cfg: ChunkConfig | None = None, chunks: DataFrame | None = None) -> Reconciled:
    """``sources`` holds ``text`` per entity. Only entities with a feasible repair are
    chunked again; the plan is stored, since three results read it."""
    drifts = detect_drift(dirs, meta, reps, index, chunks)
    plan = durable(repair_plan(drifts, sources))
    affected = plan.filter(F.col("feasible")).select(*ENTITY_KEY).distinct()
    todo = sources.join(affected, ENTITY_KEY, "left_semi").select(*ENTITY_KEY, "text")
    staged = chunk_documents(todo, cfg).withColumn("rep_name", F.lit("canonical_md")).select(
        *ENTITY_KEY, "rep_name", "chunk_index", "text"
    )
    touched = affected.join(sources.select(*ENTITY_KEY).distinct(), ENTITY_KEY, "left_semi").withColumn(
        "rep_name", F.lit("canonical_md")
    )
    repaired = replace_reps(index, staged, touched)
    return Reconciled(plan, reconcile_report(dirs, plan), staged, repaired)
