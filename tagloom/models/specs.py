"""Model configurations."""

from __future__ import annotations

from dataclasses import dataclass, field

SEED = 42
UNLIMITED_DEPTH = 30  # the deepest tree Spark ML grows


@dataclass(frozen=True)
class Spec:
    name: str
    model: str  # random_forest, gradient_boosting, boosted_trees, ridge, elasticnet or naive_mean
    params: dict = field(default_factory=dict)


# The published parameter sets. Depth None is unlimited; the share of features
# tried per split is 'all' unless given; ``rows`` and ``columns`` are the shares each tree draws.
SPECS = {
    s.name: s
    for s in [
        Spec("rf_small", "random_forest", {"trees": 100}),
        Spec("rf_medium", "random_forest", {"trees": 250, "depth": 10}),
        Spec("rf_tuned_150", "random_forest", {"trees": 150}),
        Spec("rf_tuned_300", "random_forest", {"trees": 300}),
        Spec("rf_tuned_leaf3", "random_forest", {"trees": 200, "min_leaf": 3}),
        Spec("rf_v6", "random_forest", {"trees": 300, "depth": 10, "min_leaf": 3}),
        Spec(
            "rf_v6_light",
            "random_forest",
            {"trees": 500, "depth": 12, "min_leaf": 2, "features": "sqrt"},
        ),
        Spec("rf_v6_plain", "random_forest", {"trees": 300}),
        Spec(
            "xgb_small",
            "boosted_trees",
            {"trees": 200, "depth": 4, "rate": 0.05, "rows": 0.9, "columns": 0.9},
        ),
        Spec(
            "xgb_medium",
            "boosted_trees",
            {"trees": 300, "depth": 6, "rate": 0.05, "rows": 0.9, "columns": 0.9},
        ),
        Spec("gb_v6", "gradient_boosting", {"trees": 300, "depth": 3, "rate": 0.05}),
        Spec("gb_default", "gradient_boosting", {"trees": 100, "depth": 3, "rate": 0.1}),
        Spec("ridge", "ridge", {"alpha": 1.0}),
        Spec("elasticnet", "elasticnet", {"alpha": 1.0, "l1_ratio": 0.5}),
        Spec("naive_mean", "naive_mean"),
    ]
}

# The five configurations tried together in the tuning experiment, in grid order.
TUNING_GRID = ("rf_small", "rf_tuned_150", "rf_tuned_300", "rf_tuned_leaf3", "xgb_small")
