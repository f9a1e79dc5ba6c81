"""Work on catalog versions: each call reads one version and stores its result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import models, synth
from millrace.plans.sequence import run_sequence
from millrace.sources.catalog import Catalog
from millrace.sources.experiments import ExperimentLog


def save_sequence(
    catalog: Catalog, dataset: str, parent: str, version: str, steps: list[dict], key: list[str] | None = None
) -> DataFrame:
    """Run steps on ``parent`` and store the result as ``version``."""
    out, configs = run_sequence(catalog.load_version(dataset, parent), steps, key)
    catalog.create_version(dataset, version, out, parent, "operations_sequence", configs)
    return catalog.load_version(dataset, version)


def save_clusters(
    catalog: Catalog, dataset: str, parent: str, version: str, features: list[str],
    method: str = "kmeans", n_clusters: int = 3, seed: int = 42, **options,
) -> DataFrame:
    """Cluster ``parent`` and store it with its ``cluster`` column."""
    out, _ = models.cluster(catalog.load_version(dataset, parent), features, method, seed, n_clusters, **options)
    config = {"model": method, "n_clusters": n_clusters, "random_seed": seed}
    catalog.create_version(dataset, version, out, parent, "clustering", config)
    return catalog.load_version(dataset, version)


def save_synthesis(
    catalog: Catalog, dataset: str, parent: str, version: str, rows: int, evaluate: bool = True, seed: int = 42
) -> DataFrame:
    """Store ``rows`` synthetic rows learnt from ``parent``."""
    out, config = synth.synthesize(catalog.load_version(dataset, parent), rows, evaluate=evaluate, seed=seed)
    catalog.create_version(dataset, version, out, parent, "synthesis", config)
    return catalog.load_version(dataset, version)


def run_experiment(
    catalog: Catalog,
    log: ExperimentLog,
    dataset: str,
    version: str,
    target: str,
    task: str,
    model: str,
    key: list[str],
    features: list[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    name: str | None = None,
    **params,
) -> str:
    """Train, evaluate and record; returns the experiment id."""
    trained = models.train(
        catalog.load_version(dataset, version), target, task, model, key, features, test_size, seed, **params
    )
    return log.create(
        dataset_name=dataset,
        dataset_version=version,
        model_type=model,
        hyperparameters=params | {"test_size": test_size},
        metrics=models.evaluate(trained),
        random_seed=seed,
        model=trained.model,
        notes=f"training task: {task}",
        experiment_name=name,
        target_column=target,
        feature_columns=trained.config["feature_columns"],
    )
