"""Versions of trained models in a shared folder.

A version is a folder with the features, the factors and, written last, a manifest. Only
versions with a finished manifest exist for readers, so a run that is killed leaves the
versions before it as they are.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from answerrec.errors import InputDataError
from answerrec.operators.model import Options, RankingModel, fit
from answerrec.session import discard, file_system
from answerrec.sources.tables import run_name, write_table, write_values

FORMAT = 1


@dataclass(frozen=True)
class Version:
    """A saved model: its name, the model, and the number of epochs it was trained."""

    run_id: str
    model: RankingModel
    epochs: int


def save_model(model: RankingModel, root: str, epochs: int = 0, run_id: str | None = None) -> str:
    """Write a version below `root`; returns its name. A name that is taken raises."""
    run_id = run_id or run_name()
    spark = model.factors.sparkSession
    folder = f"{root}/run_id={run_id}"
    path, fs = file_system(spark, folder)
    if fs.exists(path):
        raise InputDataError(f"version {run_id} is in {root} already")
    write_table(model.features, f"{folder}/features")
    write_table(model.factors, f"{folder}/factors")
    write_values(spark, {"format": FORMAT, "epochs": epochs, "options": asdict(model.options)}, f"{folder}/manifest")
    return run_id


def _names(spark: SparkSession, root: str, pattern: str) -> list[str]:
    path, fs = file_system(spark, f"{root}/run_id=*{pattern}")
    found = fs.globStatus(path) or []
    return sorted(status.getPath().toString().rsplit("run_id=", 1)[1].split("/")[0] for status in found)


def versions(spark: SparkSession, root: str) -> list[str]:
    """The names of the finished versions, the oldest first."""
    return _names(spark, root, "/manifest/_SUCCESS")


def load_model(spark: SparkSession, root: str, run_id: str | None = None) -> Version:
    """A version by name, or the newest one."""
    known = versions(spark, root)
    if not known or run_id not in (None, *known):
        raise InputDataError(f"no finished version {run_id or ''} in {root}")
    run_id = run_id or known[-1]
    folder = f"{root}/run_id={run_id}"
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    if manifest["format"] != FORMAT:
        raise InputDataError(f"version {run_id} has format {manifest['format']}, not {FORMAT}")
    tables = (spark.read.parquet(f"{folder}/{name}") for name in ("features", "factors"))
    return Version(run_id, RankingModel(Options(**manifest["options"]), *tables), manifest["epochs"])


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest `keep` finished versions, and what unfinished runs before the
    newest one have left; returns the names of what was deleted."""
    if keep < 1:
        raise ValueError("at least one version must be kept")
    done = versions(spark, root)
    kept = set(done[-keep:])
    gone = [name for name in _names(spark, root, "") if name not in kept and done and name < done[-1]]
    for name in gone:
        path, fs = file_system(spark, f"{root}/run_id={name}")
        fs.delete(path, True)
    return gone


def resume(spark: SparkSession, root: str, interactions: DataFrame, epochs: int, keep: int = 2) -> Version:
    """Train the newest version for more epochs, save the result as a new one, drop older ones.

    Epochs are numbered on from those done, so training in parts gives what training at once gives.
    """
    last = load_model(spark, root)
    trained = fit(last.model, interactions, epochs, first_epoch=last.epochs)
    run_id = save_model(trained, root, last.epochs + epochs)
    discard(trained.factors)
    drop_versions(spark, root, keep)
    return load_model(spark, root, run_id)
