"""Learning which centrality orders a level or an attempt: environments, agents, training and grid search."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ordograph.functions import kernels
from ordograph.operators.graph import simple
from ordograph.operators.traverse import per_instance

NAMES = ("Degree", "Closeness", "Betweenness", "Eigenvector", "Katz Centrality", "PageRank", "Harmonic Centrality")


def tables_of(g: kernels.Graph) -> np.ndarray:
    """Centralities of NAMES, a row each."""
    q, of = g.quotient()
    reached, far, har = np.zeros(q.n), np.zeros(q.n), np.zeros(q.n)
    for k, d, n in q.level_counts(np.arange(q.n)):
        if d:
            reached[k] += n
            far[k] += d * n
            har[k] += n / d
    return np.stack([g.degree / max(1, g.n - 1), (reached / np.maximum(far, 1))[of], kernels.betweenness(g), kernels.eigenvector(g), kernels.katz(g), kernels.pagerank(g), har[of]])


def lower_bound(n: int, m: int) -> int:
    inside = (2 * n - 1) ** 2 - 8 * m
    return int(np.ceil(n - (1 + np.sqrt(inside)) / 2)) if m and inside >= 0 else 0


def state(size: int, left: float, last: int) -> tuple[int, int, int]:
    return sum(size > x for x in (0, 2, 5, 10, 20)), sum(left > x for x in (0.1, 0.25, 0.5, 0.75)), last


class LevelEnv:
    """One step labels one breadth-first level with the chosen centrality's best candidates; the reward comes last."""

    def __init__(self, g: kernels.Graph, tables: np.ndarray, alpha: float = 0.5, seed: int = 0):
        self.g, self.tables, self.alpha, self.rng = g, tables, alpha, np.random.default_rng(seed)

    def reset(self):
        self.left, self.order, self.last = np.ones(self.g.n, dtype=bool), [], len(self.tables)
        self.front = [int(self.rng.integers(self.g.n))]
        return state(1, 1.0, self.last)

    def step(self, action: int):
        front = np.array(self.front)
        value = self.tables[action][front]
        chosen = front[np.lexsort((front, -value))][: max(1, int(len(front) * self.alpha))]
        self.left[chosen] = False
        self.order += chosen.tolist()
        reach = self.g.around(chosen)
        self.front = np.union1d(front[self.left[front]], reach[self.left[reach]]).astype(np.int64)
        if not len(self.front) and self.left.any():  # another component
            self.front = [int(self.rng.choice(np.flatnonzero(self.left)))]
        self.last, done = action, not self.left.any()
        reward = 0.0
        if done:
            self.bandwidth = self.g.bandwidth(kernels.labels_of(np.array(self.order)))
            reward = -max(0, self.bandwidth - lower_bound(self.g.n, len(self.g.u))) / max(1, self.g.n)
        return state(len(self.front), self.left.mean(), self.last), reward, done


class AttemptEnv:
    """One step is the best of `tries` labellings with the chosen centrality; 10, 5 or -2 for a best, no worse or
    worse result. State: steps, gap, reward, bandwidth."""

    def __init__(self, g: kernels.Graph, tables: np.ndarray, tries: int = 15, alpha: float = 0.3, seed: int = 0):
        self.g, self.tables, self.tries, self.alpha, self.rng = g, tables, tries, alpha, np.random.default_rng(seed)
        self.best = self.previous = None
        self.steps, self.log = 0, []

    def step(self, action: int):
        value, bound = self.tables[action], lower_bound(self.g.n, len(self.g.u))
        labels = []
        for _ in range(self.tries):
            p = value / value.sum() if value.sum() > 0 else None
            order = kernels.level_order(self.g, -value, self.alpha, self.rng, root=int(self.rng.choice(self.g.n, p=p)))
            labels.append(kernels.labels_of(order))
        label = min(labels, key=self.g.bandwidth)
        cost = self.g.bandwidth(label)
        if self.best is None or cost < self.best:
            self.best, self.label = cost, label
        reward = 10 if cost <= self.best and (self.previous is None or cost <= self.previous) else 5 if self.previous is None or cost <= self.previous else -2
        self.previous, self.steps = cost, self.steps + 1
        self.log.append((self.steps, action, cost, reward))
        return (self.steps, (cost - bound) / max(1, bound), reward, cost), reward


def train_levels(g: kernels.Graph, tables: np.ndarray, episodes: int, seed: int, **how) -> tuple[int, kernels.TabularAgent]:
    """Bandwidth after training (epsilon 0) and the agent."""
    env, agent = LevelEnv(g, tables, seed=seed), kernels.TabularAgent(len(tables), seed=seed, **how)
    for _ in range(episodes):
        at, done = env.reset(), False
        while not done:
            action = agent.choose(at)
            after, reward, done = env.step(action)
            agent.learn(at, action, reward, after, done)
            at = after
        agent.end_episode()
    agent.eps, best = 0.0, None
    for _ in range(3):
        at, done = env.reset(), False
        while not done:
            at, _, done = env.step(agent.choose(at))
        best = env.bandwidth if best is None else min(best, env.bandwidth)
    return best, agent


def attempt_log(edges: DataFrame, episodes: int = 30, tries: int = 15, network: bool = False, seed: int = 0) -> DataFrame:
    """(instance, episode, centrality, bandwidth, reward, score): one agent for each instance, in its own task."""

    def run(name, names, g):
        tables = tables_of(g)
        env = AttemptEnv(g, tables, tries, seed=seed)
        agent = (kernels.NetworkAgent if network else kernels.TabularAgent)(len(tables), seed=seed)
        at, score = (0, 0, 0, 0), 0
        rows = []
        for episode in range(episodes):
            action = agent.choose(at)
            after, reward = env.step(action)
            agent.learn(at, action, reward, after, False)
            agent.end_episode()
            at, score = after, score + reward
            rows.append((name, episode, NAMES[action], env.log[-1][2], reward, score))
        return pd.DataFrame(rows, columns=["instance", "episode", "centrality", "bandwidth", "reward", "score"])

    return per_instance(edges, run, "instance string, episode int, centrality string, bandwidth int, reward int, score int")


# The parameter grid that param_grid's SQL lists, and the reference's, which top3_params searches.
GRID = {"episodes": [10, 20, 30], "lr": [0.1, 0.5], "gamma": [0.9, 0.99], "eps": [0.5, 1.0], "eps_decay": [0.9, 0.99]}
REFERENCE_GRID = {"episodes": [20, 30, 40], "lr": [0.001, 0.005], "gamma": [0.8, 0.9], "eps": [1.0, 0.5], "eps_decay": [0.99, 0.995]}


def parameter_grid(spark: SparkSession, values: dict[str, list] | None = None) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(itertools.product(*(values or GRID).values()))]
    return spark.createDataFrame(rows, "param_id int, episodes int, lr double, gamma double, eps double, eps_decay double")


def grid_search(edges: DataFrame, grid: DataFrame, seed: int = 0) -> DataFrame:
    """(instance, param_id, bandwidth, lower_bound): a task trains and solves with one point of the grid."""
    plain = simple(edges)
    points = plain.select("instance").distinct().crossJoin(F.broadcast(grid))  # the grid is a fixed list
    copies = plain.join(points.select("instance", "param_id"), "instance").select(F.col("instance").alias("of"), F.col("param_id").alias("point"), "u", "v")

    known = per_instance(edges, lambda name, names, g: pd.DataFrame({"instance": [name], "tables": [tables_of(g).tobytes()]}), "instance string, tables binary")
    points = points.join(known, "instance")  # computed once for all points of the grid

    def run(pairs: pd.DataFrame, point: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(point):
            return pd.DataFrame({"instance": [], "param_id": [], "bandwidth": [], "lower_bound": []})
        names, where = np.unique(np.concatenate([pairs.u, pairs.v]), return_inverse=True)
        g, p = kernels.Graph(len(names), where[: len(pairs)], where[len(pairs) :]), point.iloc[0]
        bw, _ = train_levels(g, np.frombuffer(p.tables).reshape(len(NAMES), -1), int(p.episodes), seed, lr=p.lr, gamma=p.gamma, eps=p.eps, decay=p.eps_decay)
        return pd.DataFrame({"instance": [p.instance], "param_id": [int(p.param_id)], "bandwidth": [bw], "lower_bound": [lower_bound(g.n, len(g.u))]})

    return copies.groupBy("of", "point").cogroup(points.groupBy("instance", "param_id")).applyInPandas(run, "instance string, param_id int, bandwidth int, lower_bound int")


def q_table(agent: kernels.TabularAgent, spark: SparkSession) -> DataFrame:
    """An agent's table for writing: (level, left, last, action, q)."""
    rows = [(*map(int, s), a, float(q)) for s, row in agent.q.items() for a, q in enumerate(row)]
    return spark.createDataFrame(rows, "level int, left int, last int, action int, q double")


def with_q_table(agent: kernels.TabularAgent, table: DataFrame) -> kernels.TabularAgent:
    for r in table.collect():
        agent.row((r["level"], r["left"], r["last"]))[r["action"]] = r["q"]
    return agent
