"""Column roles of the learning tasks, and feature assembly from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Roles of the target and of the model attributes.
TARGET_ROLES = {"failed": "binary", "duration_worked": "numerical"}
ATTRIBUTE_ROLES = {
    "id": "stop", "last_date": "stop", "model_id": "stop", "brand_id": "stop", "vendor_id": "stop", "vendor": "stop",
    "series": "categorical", "Scorpio": "binary", "Caviar": "binary", "GP": "binary", "Red": "binary", "N2": "binary",
    "SpinPoint": "binary", "buffer_size": "numerical", "capacity": "numerical", "top_capacity": "stop",
    "interface": "stop", "interface_version": "numerical", "interface_speed": "numerical",
    "interface_pin_count": "numerical", "form_factor": "numerical", "form_factor_weight": "numerical",
    "form_factor_depth": "numerical", "form_factor_width": "numerical", "form_factor_height": "numerical",
    "segment": "categorical", "family": "stop", "sector_size": "numerical", "feature_code": "stop",
    "rpm": "numerical", "data_security_mode": "stop", "platters": "numerical", "max_platters": "stop",
    "variable_rpm": "binary", "first_known_date": "numerical", "feature": "stop", "name": "stop",
    "attributes": "stop", "generation_code": "stop", "options": "stop", "type": "stop", "comment": "stop",
    "product_code": "stop",
}
SURVIVAL_LABEL_SUFFIX = "_prep"


@dataclass(frozen=True)
class LearningTask:
    """A frame of subjects and the columns that play the learned roles."""

    frame: DataFrame
    duration: str = "duration_worked"
    event: str = "failed"
    rejected: DataFrame | None = None
    missing_attributes: Sequence[str] = ()


def columns_with_role(roles: Mapping[str, str], role: str, present: Sequence[str]) -> list[str]:
    return [c for c in present if roles.get(c) == role]


def with_survival_roles(roles: Mapping[str, str], duration: str, event: str, weight: str | None = None) -> dict[str, str]:
    """Roles at fit time: the signed label is the survival target, duration and event are out of the features."""
    out = {**roles, duration: "stop", event: "stop", f"{duration}{SURVIVAL_LABEL_SUFFIX}": "survival"}
    if weight:
        out[weight] = "weight"
    return out


def numeric_features(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numbers as doubles; a null becomes the column's mean and sets ``<column>_missing``. One aggregation for all."""
    columns = list(columns)
    if not columns:
        return df, []
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    value = {f"num_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))) for c in columns}
    missing = {f"num_{c}_missing": F.col(c).isNull().cast("double") for c in columns}
    return df.withColumns({**value, **missing}), [*value, *missing]


def assembly_stages(
    df: DataFrame, roles: Mapping[str, str], out: str = "features", one_hot: bool = False, skip: Sequence[str] = (),
) -> list:
    """Stages that turn role-typed columns into one vector; unseen and null categories get a slot of their own."""
    present = [c for c in df.columns if c not in skip]
    plain = columns_with_role(roles, "numerical", present) + columns_with_role(roles, "binary", present)
    categories = columns_with_role(roles, "categorical", present)
    stages, inputs = [], list(plain)
    if categories:
        indexed = [f"{c}_index" for c in categories]
        stages.append(StringIndexer(
            inputCols=categories, outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc"))
        if one_hot:
            vectors = [f"{c}_vector" for c in categories]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=vectors, handleInvalid="keep"))
            inputs += vectors
        else:
            inputs += indexed
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    return stages


def feature_pipeline(df: DataFrame, roles: Mapping[str, str], out: str = "features", one_hot: bool = True) -> Pipeline:
    """Unfitted pipeline for the columns of ``df``; a column without a role is an error."""
    unknown = sorted(c for c in df.columns if c not in roles)
    if unknown:
        raise ValueError(f"columns without a role: {unknown}")
    return Pipeline(stages=assembly_stages(df, roles, out, one_hot))
