"""The leveled compaction policy, as a function of the levels, and as a query over a manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import StoreOptions


@dataclass(frozen=True)
class Task:
    """Merge all runs of two neighbouring levels into the lower one."""

    upper: int
    lower: int
    upper_runs: tuple = field(default=())
    lower_runs: tuple = field(default=())
    bottom: bool = False


def pick(levels: list[list[int]], options: StoreOptions) -> Task | None:
    """``levels``: run ids of level 0, 1, ... The first rule that applies: level 0 has reached its trigger;
    a filled level's next one has less than ``size_ratio`` times its runs."""
    levels = levels + [[] for _ in range(options.max_levels + 1 - len(levels))]

    def task(upper: int) -> Task:
        deeper = any(levels[upper + 2 :])
        return Task(upper, upper + 1, tuple(levels[upper]), tuple(levels[upper + 1]), not deeper)

    if len(levels[0]) >= options.l0_trigger:
        return task(0)
    for i in range(1, options.max_levels):
        if levels[i] and len(levels[i + 1]) / len(levels[i]) < options.size_ratio:
            return task(i)
    return None


def apply(levels: list[list[int]], task: Task, output: list[int]) -> list[list[int]]:
    out = [list(x) for x in levels] + [[] for _ in range(task.lower + 1 - len(levels))]
    out[task.upper] = [r for r in out[task.upper] if r not in task.upper_runs]
    out[task.lower] = [r for r in out[task.lower] if r not in task.lower_runs] + list(output)
    return out


def pick_query(manifest: DataFrame, options: StoreOptions) -> DataFrame:
    """(upper_level) that is due, from rows (level, run_id): none or one."""
    counts = manifest.groupBy("level").agg(F.count("*").alias("runs"))
    # A row per level, so this window is over a handful of rows.
    order = Window.orderBy("level")
    following = F.when(F.lead("level").over(order) == F.col("level") + 1, F.lead("runs").over(order)).otherwise(F.lit(0))
    due = counts.withColumn("following", following).filter(
        ((F.col("level") == 0) & (F.col("runs") >= options.l0_trigger))
        | ((F.col("level") > 0) & (F.col("level") < options.max_levels) & (F.col("following") / F.col("runs") < options.size_ratio))
    )
    return due.agg(F.min("level").alias("upper_level")).filter("upper_level IS NOT NULL")
