"""Batch scoring of models nobody has run yet."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import with_human_span
from ..functions.schema_tools import reorder
from ..operators.enrich import Enricher, enrich
from ..operators.sampling import sorted_by_prediction
from .evaluate import reject_nan
from .explain import with_compact_explanation


def parse_descriptors(df: DataFrame, text: str, fields: Mapping[str, str], *carry: str) -> DataFrame:
    """Requests as rows: a JSON list of objects or names, a JSON object, or a bare model name. A malformed list or object
    gives one row of nulls."""
    struct = "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields.items()) + ">"
    raw = F.trim(F.col(text))
    as_list = raw.startswith("[")
    parts = F.when(as_list, F.from_json(raw, "array<string>"))
    one = df.select(*carry, F.explode(F.coalesce(parts, F.array(F.when(~as_list, raw)))).alias("_part"))
    part = F.trim(F.col("_part"))
    record = F.when(part.startswith("{"), F.from_json(part, struct))
    bare = F.when(~part.startswith("{"), part)
    out = one.select(*carry, record.alias("_r"), bare.alias("_name"))
    return out.select(*carry, *[
        (F.coalesce(F.col(f"_r.{n}"), F.col("_name").cast(t)) if n == "name" else F.col(f"_r.{n}")).alias(n)
        for n, t in fields.items()])


def score_models(
    requests: DataFrame, enrichers: Mapping[str, Enricher], predict: Callable[[DataFrame], DataFrame],
    contributions: Sequence[str], anchor: datetime.date, threshold_ratio: float = 50.0,
) -> DataFrame:
    """Enrich, predict, check, explain, name the time, sort by predicted survival.

    ``predict`` adds ``predicted_survival`` and, when contributions are wanted, one ``phi_<feature>`` column each. Time spans count from ``anchor``.
    """
    out = reject_nan(predict(enrich(requests, enrichers)), "predicted_survival")
    if contributions:
        out = with_compact_explanation(out, contributions, "explanation", threshold_ratio, "phi_")
        out = out.drop(*[f"phi_{f}" for f in contributions])
    out = with_human_span(out, "predicted_survival", "fancy_time", anchor)
    return reorder(sorted_by_prediction(out, ["name"]), ["vendor", "name", "predicted_survival", "fancy_time"])
