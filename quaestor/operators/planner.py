"""A study plan for one evening: first every unit a little, then what pays best."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

PLAN = "subject_id int, step long, concept_id string, phase string, unit_no int, cost long, expected_marks double, planned long, reserve long, expected_total double, unit_minutes array<long>, uncovered array<int>"


def reserve_of(budget: int, share: float = 0.15) -> int:
    return math.floor(share * budget + 0.5)


def plan(concepts: list[dict], budget: int, units: list[int], enough: int = 25) -> list[dict]:
    """The steps in order; a concept: concept_id, units, cost, expected_marks, given by falling worth.

    A pass for each unit, then one for all, walk the list: what is taken, does not fit into the minutes left or is of
    another unit is passed over. A unit's pass ends once its concepts hold enough minutes.
    """
    left = budget - reserve_of(budget)
    minutes = dict.fromkeys(units, 0)
    steps: dict[str, dict] = {}
    for unit in [*units, None]:
        for c in concepts:
            if unit is not None and minutes[unit] >= enough:
                break
            wanted = unit is None or unit in c["units"]
            if wanted and c["concept_id"] not in steps and c["cost"] <= left:
                left -= c["cost"]
                minutes.update({u: minutes[u] + c["cost"] for u in c["units"] if u in minutes})
                steps[c["concept_id"]] = {**c, "phase": "depth" if unit is None else "coverage", "unit_no": unit}
    return list(steps.values())


def unit_minutes(steps: list[dict], units: list[int]) -> list[int]:
    """The minutes that steps spend on each unit; a concept of two units counts for both."""
    return [sum(s["cost"] for s in steps if u in s["units"]) for u in units]


def planned(concepts: DataFrame, budget: int = 120, units: tuple = (1, 2, 3, 4, 5), enough: int = 25) -> DataFrame:
    """PLAN for each subject of concepts (subject_id, concept_id, units, cost, expected_marks, place); a group is a syllabus.

    uncovered: the units whose steps hold fewer than `enough` minutes.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        steps = plan([{**r, "units": list(r["units"])} for r in rows.to_dict("records")], budget, list(units), enough)
        total, worth, minutes = sum(s["cost"] for s in steps), sum(s["expected_marks"] for s in steps), unit_minutes(steps, list(units))
        bare = [u for u, m in zip(units, minutes) if m < enough]
        out = [(s["subject_id"], i + 1, s["concept_id"], s["phase"], s["unit_no"], s["cost"], s["expected_marks"], total, reserve_of(budget), worth, minutes, bare) for i, s in enumerate(steps)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in PLAN.split(", ")]).astype({"unit_no": "Int32"})

    return concepts.groupBy("subject_id").applyInPandas(one, PLAN)
