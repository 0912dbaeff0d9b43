"""The render queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake.functions import text
from rawlake.operators.ordered import next_matching


def unfinished(queue: DataFrame) -> DataFrame:
    """drop completed and failed jobs."""
    return queue.where(~F.col("status").isin("Completed", "Failed"))


def first_selected(queue: DataFrame, group: list[str], order: str) -> DataFrame:
    """First selected job of each queue."""
    picked = queue.where("selected")
    rest = [c for c in queue.columns if c not in (*group, order)]
    best = F.min(F.struct(order, *rest)).alias("_j")
    return picked.groupBy(*group).agg(best).select(*group, "_j.*")


def next_job(queue: DataFrame, group: list[str], order: list[str], job: str = "job_id", **kw) -> DataFrame:
    """The first later job that is selected and waiting."""
    ready = F.col("selected") & (F.col("status") == "Waiting")
    return next_matching(queue, group, order, F.col(job), ready, "next_job", **kw)


def batch_progress(queue: DataFrame, group: list[str]) -> DataFrame:
    """Completed and total jobs among the selected ones."""
    done = F.count_if(F.col("selected") & (F.col("status") == "Completed"))
    return queue.groupBy(*group).agg(done.alias("done"), F.count_if(F.col("selected")).alias("total"))


def outcome(kind: Column, cancelled: Column) -> Column:
    """Status after a finished run; a cancelled job waits again."""
    return F.when(cancelled, "Waiting").when(kind == "ok", "Completed").otherwise("Failed")


def queue_state(queue: DataFrame, events: DataFrame, key: str = "job_id") -> DataFrame:
    """Status and progress after the latest event of each job.

    Events: ``seq``, ``kind`` (start, progress, ok, error), ``percent``,
    ``cancelled``, ``error``. Any finished run sets the progress to 100.
    """
    latest = events.groupBy(key).agg(
        F.max_by(F.struct("kind", "percent", "cancelled", "error"), "seq").alias("e")
    )
    j = queue.join(latest, key, "left")
    over = F.coalesce(F.col("e.kind").isin("ok", "error"), F.lit(False))
    running = F.coalesce(F.col("e.kind").isin("start", "progress"), F.lit(False))
    status = (
        F.when(over, outcome(F.col("e.kind"), F.col("e.cancelled"))).when(running, "Rendering").otherwise(F.col("status"))
    )
    progress = F.when(over, F.lit(100.0)).when(running, F.coalesce("e.percent", F.lit(0.0))).otherwise(F.col("progress"))
    failed = over & ~F.col("e.cancelled") & (F.col("e.kind") == "error")
    changed = {"status": status, "progress": progress, "error": F.when(failed, F.col("e.error"))}
    kept = [c for c in queue.columns if c not in changed]
    return j.select(*kept, *[e.alias(n) for n, e in changed.items()])


def progress_times(runs: DataFrame) -> DataFrame:
    """Elapsed and remaining time of running jobs as ``MM:SS``."""
    left = text.remaining_seconds(F.col("elapsed"), F.col("percent"))
    return runs.withColumns(
        {"elapsed_label": text.clock(F.floor("elapsed")), "eta_seconds": left, "eta_label": text.clock(left)}
    )
