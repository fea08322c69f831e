"""What a model run can be told, and what it accepts."""

from __future__ import annotations

import dataclasses
import itertools
from dataclasses import dataclass, field
from typing import Any

from .functions.criteria import CRITERIA, canonical

MODELS = ("build_tree", "boosted_tree", "bagged_tree")
ESTIMATES = ("rawRelativities", "unsmoothedPerScore", "smoothedPerScore")


@dataclass
class ModelSettings:
    model_type: str = "build_tree"
    min_weight: float = -0.1
    criterion: str = "difference"
    max_splitting_points: int = 250
    iterations: int = 2
    learning_rate: float = 0.1
    moderation: list[float] = field(default_factory=list)
    n_scores: int = 1000
    score_bands: list[int] = field(default_factory=lambda: [1, *range(100, 1000, 100)])
    fit_for_stats: str = "rawRelativities"
    smooth_estimates: bool = True
    random_top: float = 0.0
    random_only_at_root: bool = True
    sample_rows: float = 1.0
    sample_features: float = 1.0
    sort_categories_above: int = 7
    stats_by: list[str] = field(default_factory=list)
    random_groups: int = 5
    performance_measure: str = "lift_val"
    ignore_zero_denominator: bool = False
    max_depth: int = 60
    checkpoint_every: int = 5
    seed: int = 90210

    def __post_init__(self) -> None:
        self.criterion = canonical(self.criterion)

    def update(self, **changes: Any) -> ModelSettings:
        """A copy with changes; text is turned into the type of the field it replaces."""
        names = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        if unknown := set(changes) - set(names):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        new = dataclasses.replace(self, **{k: _coerced(names[k], v) for k, v in changes.items()})
        new.validate()
        return new

    def validate(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.criterion in CRITERIA, f"criterion must be one of {', '.join(CRITERIA)}")
        need(self.model_type in MODELS, f"model_type must be one of {', '.join(MODELS)}")
        need(self.min_weight >= -1, "min_weight below 0 is a share of the training weight, at most 1")
        need(2 <= self.max_splitting_points <= 2000, "max_splitting_points must be from 2 to 2000")
        need(self.iterations >= 1, "iterations must be positive")
        need(0 < self.learning_rate <= 1, "learning_rate must be in (0, 1]")
        need(len(self.moderation) in (0, 1, self.iterations), "moderation has one value, or one for each iteration")
        need(self.n_scores > 8, "n_scores must be above 8")
        bands = self.score_bands
        need(bool(bands) and bands[0] == 1 and bands == sorted(set(bands)) and bands[-1] < self.n_scores, "score_bands rise from 1 to below n_scores")
        need(self.fit_for_stats in ESTIMATES, f"fit_for_stats must be one of {', '.join(ESTIMATES)}")
        need(0 <= self.random_top <= 1, "random_top must be in [0, 1]")
        need(0 < self.sample_rows <= 1 and 0 < self.sample_features <= 1, "samples are shares in (0, 1]")
        need(1 <= self.sort_categories_above <= 12, "sort_categories_above must be from 1 to 12")

    def rates(self) -> list[float]:
        """The learning rate of each iteration."""
        if len(self.moderation) == self.iterations:
            return list(self.moderation)
        return (self.moderation or [self.learning_rate]) * self.iterations


def _coerced(old: Any, new: Any) -> Any:
    if not isinstance(new, str) or isinstance(old, str):
        return new
    if isinstance(old, bool):
        if new.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"not a truth value: {new}")
        return new.lower() in ("true", "1")
    if isinstance(old, list):
        kind = int if old and isinstance(old[0], int) else float
        items = [x.strip() for x in new.replace(";", ",").split(",") if x.strip()]
        try:
            return [kind(x) for x in items]
        except ValueError:
            return items
    return type(old)(new)


def grid(base: ModelSettings, **options: list) -> list[ModelSettings]:
    """All combinations of the options' values, each validated."""
    names = list(options)
    return [base.update(**dict(zip(names, values, strict=True))) for values in itertools.product(*options.values())]


def stats_columns(wanted: str | list[str], features: list[str]) -> list[str]:
    """Feature names from names or 1-based numbers."""
    items = [x.strip() for x in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    out = [features[int(x) - 1] if str(x).isdigit() else x for x in items if str(x)]
    if missing := [x for x in out if x not in features]:
        raise ValueError(f"not a feature: {', '.join(missing)}")
    return out
