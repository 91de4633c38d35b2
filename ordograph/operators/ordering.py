"""Cuthill-McKee orders, pseudo-peripheral vertices, local search: one instance a task."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ordograph.functions import kernels
from ordograph.operators.traverse import per_instance

LABELS = "instance string, solution string, v int, label int"


def cuthill_mckee(edges: DataFrame, start: int | None = None, reverse: bool = False) -> DataFrame:
    """Labels 1 to n; all components, from start or a pseudo-peripheral vertex."""

    def run(name, names, g):
        order = kernels.cuthill_mckee(g, None if start is None else int(np.searchsorted(names, start)))
        label = kernels.labels_of(order[::-1] if reverse else order)
        return pd.DataFrame({"instance": name, "solution": "rcm" if reverse else "cm", "v": names, "label": label})

    return per_instance(edges, run, LABELS)


def george_liu(edges: DataFrame) -> DataFrame:
    """(instance, component, vertex): a pseudo-peripheral vertex of each component, from one of smallest degree."""

    def run(name, names, g):
        rows = [(name, int(names[p[0]]), int(names[kernels.george_liu(g, int(p[np.lexsort((p, g.degree[p]))[0]]))])) for p in g.parts()]
        return pd.DataFrame(rows, columns=["instance", "component", "vertex"])

    return per_instance(edges, run, "instance string, component int, vertex int")


def gps_pair(edges: DataFrame) -> DataFrame:
    """(instance, first, second): the two endpoints in the largest component."""

    def run(name, names, g):
        a, b = kernels.gps_pair(g, g.parts()[0])
        return pd.DataFrame({"instance": [name], "first": [int(names[a])], "second": [int(names[b])]})

    return per_instance(edges, run, "instance string, first int, second int")


def hill_climb(edges: DataFrame) -> DataFrame:
    """Labels after local search from the Cuthill-McKee labels."""

    def run(name, names, g):
        label = kernels.hill_climb(g, kernels.labels_of(kernels.cuthill_mckee(g)))
        return pd.DataFrame({"instance": name, "solution": "hill", "v": names, "label": label})

    return per_instance(edges, run, LABELS)


def vns(edges: DataFrame, starts: int = 2, k_min: int = 5, k_max: int = 220, k_step: int = 5, alpha: int = 10) -> DataFrame:
    """Labels of the best of several variable neighbourhood searches."""

    def run(name, names, g):
        first = kernels.labels_of(kernels.cuthill_mckee(g))
        tried = [kernels.vns(g, first if s == 0 else np.random.default_rng(s).permutation(g.n) + 1, k_min, k_max, k_step, alpha, s) for s in range(starts)]
        return pd.DataFrame({"instance": name, "solution": "vns", "v": names, "label": min(tried, key=g.bandwidth)})

    return per_instance(edges, run, LABELS)


def batch(edges: DataFrame, solvers: dict) -> DataFrame:
    """(instance, solver, bandwidth, seconds, error): every solver, graph -> labels, on every instance; one that fails
    leaves its error and no bandwidth, and the others go on."""

    def run(name, names, g):
        rows = []
        for solver, function in solvers.items():
            began, cost, error = time.perf_counter(), None, None
            try:
                cost = int(g.bandwidth(function(g)))
            except Exception as e:  # noqa: BLE001  whatever a solver raises is a row of the table
                error = f"{type(e).__name__}: {e}"
            rows.append((name, solver, cost, time.perf_counter() - began, error))
        return pd.DataFrame(rows, columns=["instance", "solver", "bandwidth", "seconds", "error"]).astype({"bandwidth": "Int32"})

    return per_instance(edges, run, "instance string, solver string, bandwidth int, seconds double, error string")
