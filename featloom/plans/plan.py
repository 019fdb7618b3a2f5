"""One preparation plan on the driver, and the fixed names plans may use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

# fixed values: the method names of a plan, by category
MISSING_VALUES = [
    "DROP", "MEAN", "MEDIAN", "MODE", "FORWARD_FILL", "BACKWARD_FILL", "ZERO_AS_MISSING_VALUE", "NEGATIVE_AS_MISSING_VALUE",
]
SAMPLING = ["BORDERLINE_SMOTE", "SMOTE"]
TRANSFORMATION = [
    "BINARIZE", "NORMALIZE", "STANDARDIZE", "MIN_MAX_SCALE", "UNIFORM_DISCRETIZE", "QUANTILE_DISCRETIZE", "DISCRETE_COSINE",
]
ENCODING = ["STRING_INDEX", "ONE_HOT_ENCODE"]
EXTRACTION = ["PCA"]
METHODS = {
    "missing_values": MISSING_VALUES,
    "sampling": SAMPLING,
    "transformation": TRANSFORMATION,
    "encoding": ENCODING,
    "extraction": EXTRACTION,
}
CATEGORIES = list(METHODS)

# fixed values: the other names of a plan document
TASK_TYPES = ["CLASSIFICATION", "REGRESSION", "MULTICLASS_CLASSIFICATION"]
QUALITY_TYPES = ["MISSING_VALUES", "IMBALANCE", "INCONSISTENT_TYPES", "HIGH_COMPLETENESS", "CONSISTENT_SCHEMA"]
OVERALL_QUALITY = ["GOOD", "MODERATE", "POOR"]
VALIDATION_METHODS = ["K_FOLD", "LEAVE_ONE_OUT", "TIME_SERIES_SPLIT"]
METRICS = [
    "RMSE", "MAE", "R2", "MAPE", "ACCURACY", "PRECISION", "RECALL", "F1", "AUC", "LOG_LOSS", "MACRO_F1", "WEIGHTED_F1",
    "TOP_K_ACCURACY",
]


@dataclass(frozen=True)
class Step:
    column: str
    methods: tuple[str, ...]


@dataclass(frozen=True)
class Plan:
    target: str
    task_type: str = "CLASSIFICATION"
    missing_values: tuple[Step, ...] = ()
    sampling: tuple[Step, ...] = ()
    transformation: tuple[Step, ...] = ()
    encoding: tuple[Step, ...] = ()
    extraction: tuple[Step, ...] = ()

    @classmethod
    def of(cls, target: str, task_type: str = "CLASSIFICATION", **steps: Sequence[tuple[str, Sequence[str]]]) -> Plan:
        """Plan.of("y", encoding=[("city", ["ONE_HOT_ENCODE"])])"""
        made = {}
        for category, items in steps.items():
            names = METHODS[category]
            made[category] = tuple(Step(c, tuple(m.upper() for m in methods)) for c, methods in items)
            unknown = [m for s in made[category] for m in s.methods if m not in names]
            if unknown:
                raise ValueError(f"unknown {category} methods: {unknown}")
        return cls(target, task_type.upper(), **made)

    def operations(self) -> list[tuple[str, str, str]]:
        return [(c, s.column, m) for c in CATEGORIES for s in getattr(self, c) for m in s.methods]

    def keep(self, masks: Mapping[str, Mapping[int, Sequence[bool]]]) -> Plan:
        """Keep the masked methods: {category: {step index: [bool per method]}}."""
        changed = {}
        for category, chosen in masks.items():
            steps = list(getattr(self, category))
            for index, mask in chosen.items():
                step = steps[int(index)]
                if len(mask) != len(step.methods):
                    raise ValueError(
                        f"{category}[{index}] has {len(mask)} selections for {len(step.methods)} methods"
                    )
                steps[int(index)] = replace(
                    step, methods=tuple(m for m, on in zip(step.methods, mask, strict=True) if on)
                )
            changed[category] = tuple(steps)
        return replace(self, **changed)
