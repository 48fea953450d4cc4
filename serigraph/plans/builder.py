"""From a panel to features in two calls: plan and fit, then transform."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from serigraph.operators import bags
from serigraph.plans.planner import Config, plan
from serigraph.sources.panel import length_profile
from serigraph.sources.storage import checkpoint

Step = Callable[[DataFrame], DataFrame]


@dataclass
class BagModel:
    """Configurations, the steps between bag and features, and the vocabulary that was seen when fitting."""

    configs: list[Config]
    vocabulary: DataFrame
    width: int
    least_ratio: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    steps: tuple[Step, ...] = ()
    constant_is_middle: bool = False

    def bag(self, panel: DataFrame) -> DataFrame:
        return _bag(panel, self.configs, self.least_ratio, self.steps, self.constant_is_middle)

    def transform(self, panel: DataFrame) -> DataFrame:
        """(ts_id, feature_idx, cnt), with weight if configurations have weights."""
        bag = self.bag(panel)
        if not self.weights:
            return bags.features(bag, self.vocabulary)
        return bags.weighted(bag, self.weights).join(self.vocabulary, bags.FEATURE).select("ts_id", "feature_idx", "cnt", "weight")

    def vectors(self, panel: DataFrame) -> DataFrame:
        """(ts_id, features): a sparse ML vector for each series of the panel, of asinh of the counts; empty without known words."""
        rows = bags.sparse_rows(self.transform(panel), self.width, panel)
        return bags.sparse_vectors(rows.withColumn("values", F.transform("values", F.asinh)))


def _bag(panel: DataFrame, configs: list[Config], least_ratio: float, steps: tuple[Step, ...], constant_is_middle: bool) -> DataFrame:
    out = bags.bag(panel, configs, least_ratio, constant_is_middle)
    for step in steps:
        out = step(out)
    return out


@dataclass
class BagBuilder:
    """Plans configurations from the lengths of a panel unless they are given, and learns its vocabulary.

    steps: functions from bag to bag, run in order. weights: by conf_idx. planning: options of plan(). constant_is_middle:
    a constant signal has the symbol of score 0, not 0.
    """

    configs: list[Config] | None = None
    least_ratio: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    steps: tuple[Step, ...] = ()
    planning: dict = field(default_factory=dict)
    constant_is_middle: bool = False

    def plan(self, panel: DataFrame) -> list[Config]:
        if self.configs is not None:
            return self.configs
        profile = length_profile(panel).first()
        return plan(profile["min_length"], profile["max_length"], **self.planning) if profile["n_signals"] else []

    def fit(self, panel: DataFrame) -> BagModel:
        configs = self.plan(panel)
        vocabulary = checkpoint(bags.vocabulary(_bag(panel, configs, self.least_ratio, self.steps, self.constant_is_middle)))
        return BagModel(configs, vocabulary, vocabulary.count(), self.least_ratio, dict(self.weights), tuple(self.steps), self.constant_is_middle)
