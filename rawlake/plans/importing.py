"""Import of a batch of clips, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawlake.functions import text
from rawlake.operators.timeline import clip_timeline
from rawlake.session import written
from rawlake.sources import containers


def cleaned_paths(dropped: DataFrame, home: str, raw: str = "raw") -> DataFrame:
    """Paths of dropped text, in their order."""
    out = dropped.withColumn("path", text.clean_path(F.col(raw), home))
    return out.where(F.lower("path").endswith(containers.vocab.CLIP_SUFFIX))


def scanned(paths: DataFrame) -> DataFrame:
    """Raw headers of each distinct path, written to a table: a catalog reads them several times, no file is opened twice."""
    return written(containers.scan_paths(paths.select("path").distinct()))


def catalog(raw: DataFrame) -> DataFrame:
    """Clips of both generations with their timelines."""
    base = containers.clips(raw)
    timeline = clip_timeline(containers.frame_index(base))
    return containers.clips(raw, timeline)
