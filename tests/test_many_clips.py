"""What must not grow with the number of clips: listings on the driver, openings of a file, batches."""

import pytest
from pyspark.sql import functions as F

from rawlake.plans import importing
from rawlake.queries.sources import headed_bytes, legacy_bytes
from rawlake.sources import containers

FRAMES = [(i, 1_000_000_000 + i * 40_000_000, 100.0 + i, 50 + i) for i in range(5)]


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        inner = tmp_path / f"{k % 2}" / "deep" if k % 3 else tmp_path
        inner.mkdir(parents=True, exist_ok=True)
        (inner / f"{k}.mcraw").write_bytes(legacy_bytes(8, 600) if k == 5 else headed_bytes(9, FRAMES))
        (inner / f"{k}.txt").write_bytes(b"note")
    (tmp_path / "_hidden.mcraw").write_bytes(b"x")
    (tmp_path / ".trash").mkdir()
    (tmp_path / ".trash" / "old.mcraw").write_bytes(b"x")
    return tmp_path


def names(paths):
    return sorted(r.path.rsplit("/", 1)[-1] for r in paths.collect())


def test_paths_are_listed_by_tasks(spark, folder):
    listed = containers.clip_paths(spark, str(folder), recursive=True)
    assert names(listed) == [f"{k}.mcraw" for k in range(6)]
    assert names(containers.clip_paths(spark, f"file://{folder}")) == ["0.mcraw", "3.mcraw"]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
    want = reader.where(F.lower("path").endswith(".mcraw")).select("path", "length", "modificationTime")
    assert sorted(map(repr, listed.collect())) == sorted(map(repr, want.collect()))
    assert listed.inputFiles() == []


def test_a_catalog_reads_what_one_scan_wrote(spark, folder):
    raw = importing.scanned(containers.clip_paths(spark, str(folder), recursive=True))
    assert raw.inputFiles() and all(f.endswith(".parquet") for f in raw.inputFiles())
    rows = importing.catalog(raw).select("frame_count", "fps").collect()
    assert sorted((r.frame_count, round(r.fps)) for r in rows) == [(5, 25)] * 5 + [(600, 25)]


@pytest.mark.parametrize("table", ["frame_index", "frame_meta"])
def test_short_clips_share_batches(folder, table):
    reader = containers.ClipReader({"path": str(folder), "table": table, "recursivefilelookup": "true"})
    (part,) = reader.partitions()
    (batch,) = reader.read(part)
    assert batch.num_rows == 25
