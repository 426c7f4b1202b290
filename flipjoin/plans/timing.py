"""How long each phase of a strategy takes, from one run of it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.cell_joins import cell_steps
from ..operators.codes import with_words, word_names
from ..session import discard, stored
from .strategy import Strategy

TIMING_SCHEMA = ("strategy STRING, param INT, phase STRING, rep INT, ms BIGINT, rows BIGINT, "
                 "tasks BIGINT, task_ms BIGINT, shuffle_rows BIGINT, shuffle_kb BIGINT")
PHASES = ("map", "group", "reduce")
METRICS = ("tasks", "task_ms", "shuffle_rows", "shuffle_kb")


def timing_profile(df: DataFrame, strategies: Iterable[Strategy], reps: int = 3, code: str = "x",
                   mode: str = "raw") -> DataFrame:
    """Run every strategy ``reps`` times on its own cells; one row a phase, as ``TIMING_SCHEMA``.

    A run is one chain: ``map`` reads ``df`` and stores the distinct codes with their cells,
    ``group`` reads those and stores what each cell holds, ``reduce`` reads that and finds
    the pairs (in mode ``raw`` all emissions), which are discarded.  No phase is run
    again for another, so their ms add up to those of ``overall``, planning included.
    ``rows`` are those a phase hands on.  The last four columns come from the stages of the
    phase's jobs: their tasks, the time these ran, and what was written to shuffles.
    """
    rows = []
    for s in strategies:
        for rep in range(reps):
            rows += [(s.name, s.param, phase, rep, *found) for phase, found in _run(df, s, code, mode == "raw").items()]
    return df.sparkSession.createDataFrame(rows, TIMING_SCHEMA)


def _run(df: DataFrame, s: Strategy, code: str, raw: bool) -> dict[str, tuple[int, ...]]:
    """ms, rows and metrics of each phase of one run, and of all together."""
    spark = df.sparkSession
    names = word_names(s.layout)
    marks, found, held = [_now()], {}, []

    def phase(name: str, work: Callable[[], DataFrame], keep: bool) -> DataFrame | None:
        group = f"{s.name}-{name}-{uuid.uuid4().hex}"
        counted = Observation()
        spark.sparkContext.setJobGroup(group, f"{s.name}: {name}")
        try:
            step = work().observe(counted, F.count(F.lit(1)).alias("rows"))
            out = stored(step, name) if keep else step.write.format("noop").mode("overwrite").save()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        marks.append(_now())
        found[name] = (counted.get["rows"], group)
        return out

    try:
        mapped, grouped, reduced = cell_steps(with_words(df, code, s.layout).select(*names).distinct(), s, raw)
        held.append(phase("map", mapped, True))
        held.append(phase("group", lambda: grouped(held[0]), True))
        phase("reduce", lambda: reduced(held[1]), False)
    finally:
        discard(*held)
    out = {name: (marks[k + 1] - marks[k], found[name][0], *_metrics(spark, found[name][1])) for k, name in enumerate(PHASES)}
    sums = [sum(out[name][k] for name in PHASES) for k in range(2, 2 + len(METRICS))]
    return out | {"overall": (marks[-1] - marks[0], found["reduce"][0], *sums)}


def _metrics(spark: SparkSession, group: str) -> tuple[int, ...]:
    """What the stages of a job group took, from the driver's status store."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    jobs = spark.sparkContext.statusTracker()
    stages = {stage for job in jobs.getJobIdsForGroup(group) for stage in jobs.getJobInfo(job).stageIds}
    ran = [stage for stage in stages if jobs.getStageInfo(stage)]  # the store keeps no others in a long session
    data = [d for d in map(context.statusStore().lastStageAttempt, ran) if d.numCompleteTasks()]  # skipped ones have none
    return (sum(d.numCompleteTasks() for d in data), sum(d.executorRunTime() for d in data),
            sum(d.shuffleWriteRecords() for d in data), sum(d.shuffleWriteBytes() for d in data) // 1000)


def _now() -> int:
    return round(time.perf_counter() * 1000)


def timing_summary(profile: DataFrame) -> DataFrame:
    """Fastest, mean and slowest run per strategy, parameter and phase."""
    return profile.groupBy("strategy", "param", "phase").agg(
        F.count(F.lit(1)).alias("reps"),
        F.min("ms").alias("ms_min"),
        F.avg("ms").alias("ms_avg"),
        F.max("ms").alias("ms_max"),
    )
