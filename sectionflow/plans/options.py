"""Stage options and their inheritance rules."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from sectionflow.operators.infer import InferOptions

# Fixed names of the configuration format, with the option each one sets.
OPTION_NAMES = {
    "nIterations": "iterations",
    "shiftProportion": "shift_proportion",
    "multiplierEstimationIterations": "multiplier_iterations",
    "multiplierGenerationRegularizerWeight": "multiplier_weight",
    "coordinateUpdateRegularizerWeight": "coordinate_weight",
    "gridRegularizationWeight": "grid_weight",
    "minimumSectionThickness": "min_thickness",
    "comparisonRange": "comparison_range",
    "regularizationType": "regularization",
    "forceMonotonicty": "monotone",
    "withReorder": "reorder",
    "estimateWindowRadius": "window_radius",
}
REQUIRED = ("defaultOptions", "options", "source", "mask", "target", "start", "stop")


@dataclass(frozen=True)
class Stage:
    steps: tuple[int, int]
    radii: tuple[int, int]
    correlation_radii: tuple[int, int]
    max_offsets: tuple[int, int]
    infer: InferOptions
    log_matrices: bool = False


@dataclass(frozen=True)
class JobOptions:
    source: str
    mask: str
    target: str
    start: int
    stop: int
    scale: int
    join_step: int
    stages: tuple[Stage, ...]

    @property
    def sections(self) -> int:
        return self.stop - self.start

    @property
    def reach(self) -> int:
        return max(s.infer.comparison_range for s in self.stages)


def _updates(given: Mapping[str, Any]) -> dict[str, Any]:
    return {OPTION_NAMES[k]: v for k, v in given.items() if k in OPTION_NAMES}


def _logged(given: Any, count: int) -> list[bool]:
    """A flag for all, a list of stage numbers, or a map stage -> flag."""
    if isinstance(given, bool):
        return [given] * count
    on = {int(k) for k, v in given.items() if v} if isinstance(given, Mapping) else {int(k) for k in given or ()}
    return [i in on for i in range(count)]


def job_options(config: Mapping[str, Any]) -> JobOptions:
    """Read a configuration mapping.

    Defaults given by the user apply to all stages; what one stage overrides stays
    in force for the stages after it.
    """
    missing = [k for k in REQUIRED if k not in config]
    if missing:
        raise ValueError(f"missing configuration keys: {', '.join(missing)}")
    current = replace(InferOptions(), **_updates(config["defaultOptions"]))
    entries = config["options"]
    logged = _logged(config.get("logMatrices", False), len(entries))
    stages = []
    for entry, log in zip(entries, logged, strict=True):
        current = replace(current, **_updates(entry.get("inference", {})))
        stages.append(
            Stage(
                steps=tuple(entry["steps"]),
                radii=tuple(entry["radii"]),
                correlation_radii=tuple(entry.get("correlationBlockRadii", entry["radii"])),
                max_offsets=tuple(entry.get("maxOffsets", (0, 0))),
                infer=current,
                log_matrices=log,
            )
        )
    join_step = max(int(config.get("joinStepSize", 0)), 2 * stages[0].infer.comparison_range)
    return JobOptions(
        source=config["source"],
        mask=config["mask"],
        target=config["target"],
        start=int(config["start"]),
        stop=int(config["stop"]),
        scale=int(config.get("scale", 0)),
        join_step=join_step,
        stages=tuple(stages),
    )


def halving_stages(width: int, height: int, count: int) -> list[dict[str, Any]]:
    """Coarse-to-fine stage entries: one block first, then half the size each time.

    From the second stage on the ends are free and coordinates are held by a
    weight that grows with the stage.
    """
    out = []
    for i in range(count):
        entry: dict[str, Any] = {
            "steps": [max(1, width >> i), max(1, height >> i)],
            "radii": [max(1, (width // 2 + 1) >> i), max(1, (height // 2 + 1) >> i)],
        }
        if i > 0:
            entry["inference"] = {
                "regularizationType": "NONE",
                "coordinateUpdateRegularizerWeight": 0.1 * i,
            }
        out.append(entry)
    return out
