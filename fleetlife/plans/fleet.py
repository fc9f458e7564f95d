"""The three jobs of a fleet: import telemetry, keep lifespans and anomalies, build learning tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.staging_area import stage
from ..operators import anomalies, dims, enrich, facts, lifespan, strata
from .roles import LearningTask
from .weibull import accepted_fits, fit_weibull_groups


@dataclass
class Imported:
    models: DataFrame
    drives: DataFrame
    facts: DataFrame


def import_telemetry(
    staging: DataFrame, models: DataFrame, drives: DataFrame, brands: DataFrame, carry: Sequence[str],
) -> Imported:
    """Staging rows to all models (with brands), all drives and one fact per drive and day.

    ``models`` and ``drives`` are the stored dimensions; store the returned ones before the facts are computed.
    """
    new_models, new_drives = dims.new_models_and_drives(staging, models, drives)
    all_models = dims.classify_models(models.select("id", "name").unionByName(new_models), brands)
    columns = ["id", "model_id", "serial_number"]
    all_drives = drives.select(columns).unionByName(new_drives.select(columns))
    rows = facts.normalize_and_collapse(staging, all_drives, carry)
    return Imported(all_models, all_drives, rows)


def preprocess(
    new_facts: DataFrame, stored: DataFrame | None, drives: DataFrame, models: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(histories, anomalies): only new facts are aggregated, once, and merged with the stored histories.

    Histories (lifespan and failure days per device) are written to the shared folder: pass them as ``stored`` with the
    next load. Loading in parts gives what loading at once gives.
    """
    spans = lifespan.histories(new_facts)
    if stored is not None:
        spans = lifespan.merge_histories(stored, spans)
    spans = stage(spans, "histories")
    return spans, anomalies.report_from_histories(spans, dims.unknown_model_drives(drives, models))


def survival_stats(spans: DataFrame, reported: DataFrame, drives: DataFrame, reduced: bool = True) -> DataFrame:
    """Durations and events of the drives without anomalies, with their model."""
    clean = lifespan.exclude(spans, reported)
    stats = lifespan.duration_and_event(lifespan.worked_days(clean, reduced), reduced)
    return stats.join(drives.selectExpr("id AS drive_id", "model_id"), "drive_id")


def learning_task(stats: DataFrame, models: DataFrame, attributes: Sequence[str], kind: str = "unaggregated") -> LearningTask:
    """One frame to learn from: a row per drive, a mean per (model, failed), or a Weibull fit per model.

    Attributes join after aggregation, when there are few rows. The task also tells which groups were rejected and which
    attributes the models lack.
    """
    rejected = None
    if kind == "aggregated":
        stats, rejected = strata.aggregate_groups(stats, ["model_id", "failed"], strata.mean_duration)
    elif kind == "weibull":
        fits = fit_weibull_groups(stats, ["model_id"])
        stats, rejected = accepted_fits(fits), fits.where("rejected is not null")
    elif kind != "unaggregated":
        raise ValueError(f"unknown kind of task {kind!r}")
    frame, missing = enrich.attach_attributes(stats, models, attributes)
    return LearningTask(frame, rejected=rejected, missing_attributes=missing)
