"""The training run: split, check weights, fit, write model and manifest, validate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tailseries import config as C
from tailseries.models.forecast import (
    DEFAULT_HYPERPARAMETERS,
    Forecaster,
    fit_forecaster,
    model_frame,
)
from tailseries.operators.audit import dataset_profile, weight_check
from tailseries.operators.evaluate import metrics_by_horizon
from tailseries.operators.harmonize import feature_columns
from tailseries.operators.split import chronological_split
from tailseries.sources.records import run_manifest, write_manifest


@dataclass
class TrainingRun:
    model: Forecaster
    features: list[str]
    validation: DataFrame
    metrics: DataFrame


def train(
    labelled: DataFrame,
    *,
    path: str,
    keys: Sequence[str] = C.SERIES_KEYS,
    ratio: float = C.TRAIN_RATIO,
    kind: str = "linear",
    parameters: Mapping[str, float] | None = None,
    features: Sequence[str] | None = None,
    tiers: C.Tiers = C.TIERS,
    target_feedback: bool = False,
) -> TrainingRun:
    """Train on the earlier part of ``labelled`` and write everything below ``path``.

    Inputs are ``features``, or else every feature column; those made from the target's own values are left out
    unless ``target_feedback`` asks for them.
    """
    settings = {**DEFAULT_HYPERPARAMETERS, **(parameters or {})}
    features = list(features) if features is not None else feature_columns(labelled, target_feedback=target_feedback)
    split = chronological_split(labelled, ratio=ratio, tie_cols=keys)
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        check = weight_check(split.where(F.col("split") == "train")).first()
        if not check["weight_present"]:
            raise ValueError("training rows carry no sample weights")
        manifest = run_manifest(
            dataset_profile(split),
            features=features,
            hyperparameters=settings,
            tiers=tiers,
            settings={"train_ratio": ratio},
        )
        write_manifest(manifest, f"{path}/manifest")
        frame = model_frame(
            split,
            features=features,
            keys=[*keys, "split"],
            encoder_length=int(settings["encoder_length"]),
            decoder_length=int(settings["decoder_length"]),
        ).store()
        model = fit_forecaster(
            frame.where(F.col("split") == "train"), kind=kind, parameters=settings
        )
        model.save(labelled.sparkSession, f"{path}/model")
        forecast = model.predict(frame.where(F.col("split") == "validation"))
        forecast.write.mode("overwrite").parquet(f"{path}/validation")
    finally:
        split.unpersist()
    validation = labelled.sparkSession.read.parquet(f"{path}/validation")
    return TrainingRun(model, features, validation, metrics_by_horizon(validation))
