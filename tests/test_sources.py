"""Containers, dumps, documents and streams on small files."""

import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import curves
from rawlake.operators import tiles, timeline
from rawlake.operators.stats import phase_snapshot
from rawlake.queries.sources import headed_bytes, legacy_bytes
from rawlake.session import small_table
from rawlake.sources import containers, documents, dumps, listing
from rawlake.streaming import imports, live


@pytest.fixture
def clips(tmp_path):
    rows = [(i, 1_000_000_000 + i * 40_000_000, 100.0 + i, 50 + i) for i in range(5)]
    (tmp_path / "a.mcraw").write_bytes(headed_bytes(9, rows))
    (tmp_path / "b.MCRAW").write_bytes(legacy_bytes(8, 600))
    (tmp_path / "short.mcraw").write_bytes(b"0123456789")
    (tmp_path / "wrong.mcraw").write_bytes(b"X" * 36)
    (tmp_path / "cut.mcraw").write_bytes(headed_bytes(9, rows)[:-30])
    (tmp_path / "note.txt").write_bytes(b"x")
    return tmp_path


def test_folder_source(spark, clips):
    containers.register(spark)
    raw = spark.read.format("rawclips").load(str(clips))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in raw.collect()}
    assert set(rows) == {"a.mcraw", "b.MCRAW", "short.mcraw", "wrong.mcraw", "cut.mcraw"}
    assert rows["short.mcraw"].error and rows["wrong.mcraw"].error and not rows["a.mcraw"].error
    assert rows["cut.mcraw"].index_count is None
    assert containers.failures(raw).count() == 2
    paths = containers.clip_paths(spark, str(clips)).select(F.regexp_replace("path", "^file:", "").alias("path"))
    again = containers.scan_paths(paths).drop("first_ts")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, raw.drop("first_ts").collect()))


class Counted:
    """An open file that adds up what is read of it."""

    def __init__(self, handle, tally):
        self.handle, self.tally = handle, tally

    def __enter__(self):
        return self

    def __exit__(self, *problem):
        self.handle.close()

    def size(self):
        return self.handle.size()

    def read_at(self, length, offset):
        self.tally["bytes"] += length
        return self.handle.read_at(length, offset)


@pytest.fixture
def reads(monkeypatch):
    tally = {"files": [], "bytes": 0}
    real = containers.open_clip

    def opened(path):
        tally["files"].append(path.rsplit("/", 1)[-1])
        return Counted(real(path), tally)

    monkeypatch.setattr(containers, "open_clip", opened)
    return tally


def read_all(folder, **options):
    reader = containers.ClipReader({"path": str(folder), **options})
    return [row for part in reader.partitions() for row in reader.read(part)]


def test_conditions_open_fewer_files_and_read_fewer_bytes(clips, reads):
    assert len(read_all(clips)) == len(reads["files"]) == 5
    for pattern in ("a.mcraw", "a*", "[ab].mcraw"):
        reads["files"].clear()
        assert [r[0] for r in read_all(clips, pathglobfilter=pattern)] == [str(clips / "a.mcraw")] and reads["files"] == ["a.mcraw"]

    reads["bytes"] = 0
    legacy = read_all(clips, kind="legacy")
    few, reads["bytes"] = reads["bytes"], 0
    headed = read_all(clips, kind="headed")
    assert [r[2] for r in legacy] == ["legacy"] and {r[2] for r in headed} == {"headed"} and few < reads["bytes"] / 2
    assert len(read_all(clips, kind="legacy,headed")) == 3

    reads["bytes"] = 0
    whole = read_all(clips, table="frame_meta")
    all_bytes, reads["bytes"] = reads["bytes"], 0
    one = read_all(clips, table="frame_meta", firstframe="2", lastframe="2")
    assert [b.num_rows for b in whole] == [5] and [b.column("ordinal").to_pylist() for b in one] == [[2]]
    assert reads["bytes"] < all_bytes / 2


def test_a_large_clip_is_read_in_shares(clips):
    parts = containers.ClipReader({"path": str(clips), "table": "frame_index", "sharebytes": "200"})
    shares = [f for p in parts.partitions() for f in p.files if f[0].endswith("/a.mcraw")]
    assert len(shares) > 5 and all(of == len(shares) for _, _, of in shares)
    assert len(containers.ClipReader({"path": str(clips)}).partitions()) == 1
    rows = read_all(clips, table="frame_index", sharebytes="200")
    assert [n for b in rows for n in b.column("ordinal").to_pylist()] == list(range(5))


def test_frame_tables_of_the_folder_source(spark, clips):
    containers.register(spark)
    source = spark.read.format("rawclips")
    index = source.option("table", "frame_index").load(str(clips))
    meta = containers.typed_frames(source.option("table", "frame_meta").load(str(clips)))
    base = containers.clips(source.option("table", "clips").load(str(clips)))
    want = containers.frame_index(base)
    assert sorted(map(repr, index.collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, meta.collect())) == sorted(map(repr, containers.frame_meta(want).collect()))
    two = spark.read.format("rawclips").options(table="frame_index", pathGlobFilter="a*", firstFrame=1, lastFrame=2).load(str(clips))
    assert sorted(r.ordinal for r in two.collect()) == [1, 2]
    raw = spark.read.format("rawclips").load(str(clips))
    both = raw.where("kind = 'legacy'").union(raw.where("kind IS NULL"))
    assert both.count() == 3
    old = spark.read.format("rawclips").option("kind", "legacy").load(str(clips))
    assert [r.path.rsplit("/", 1)[-1] for r in old.collect()] == ["b.MCRAW"]
    with pytest.raises(Exception, match="table must be one of"):
        source.option("table", "frames").load(str(clips)).collect()


def test_both_generations(spark, clips):
    containers.register(spark)
    raw = spark.read.format("rawclips").load(str(clips))
    base = containers.clips(raw)
    index = containers.frame_index(base, entries_per_task=2)
    assert [r.ordinal for r in index.orderBy("ordinal").collect()] == list(range(5))
    full = {r.path.rsplit("/", 1)[-1]: r for r in containers.clips(raw, timeline.clip_timeline(index)).collect()}
    a, b = full["a.mcraw"], full["b.MCRAW"]
    assert a.frame_count == 5 and a.fps == pytest.approx(25.0) and a.first_ts == 1_000_000_000
    assert (a.width, a.height, a.pattern) == (4000, 3000, "BGGR")
    assert a.wb_gains == pytest.approx([2.0, 1.0, 5.0])
    assert (b.frame_count, b.fps, b.camera_model, b.sensor_make) == (600, 25.0, "Cam3", "Maker")
    assert b.frame_offsets == [5, 9] and b.color_matrix is None
    meta = containers.frame_meta(index).orderBy("ordinal").collect()
    assert [m.iso for m in meta] == [0.0, 510.0, 0.0, 530.0, 0.0]
    assert [m.dynamic_black for m in meta] == [None, None, None, [53.0, 2.0, 3.0, 4.0], None]


def test_legacy_header_of_ten_frames(spark, tmp_path):
    head = b"MCRAW" + struct.pack(">IIHHdB", 2, 10, 1920, 1080, 30.0, 0) + struct.pack(">IHHBB", 0, 0, 0, 0, 0)
    (tmp_path / "x.mcraw").write_bytes(head)
    row = containers.legacy_clips(containers.scan_paths(small_table(spark, [(str(tmp_path / "x.mcraw"),)], "path string"))).first()
    assert (row.frame_count, row.width, row.height, row.fps, row.pattern, row.has_audio) == (10, 1920, 1080, 30.0, "RGGB", False)


def test_dump_round_trip(spark, tmp_path):
    rows = [(c, i, [(c * 1000 + i * 24 + k) % 65536 for k in range(24)]) for c in (1, 2) for i in range(7)]
    frames = small_table(spark, rows, "clip_id int, ordinal int, px array<int>").repartition(3)
    parts = dumps.write_raw16(frames, str(tmp_path)).collect()
    for c in (1, 2):
        mine = sorted((p for p in parts if p.clip == str(c)), key=lambda p: p.first)
        words = b"".join(open(p.path, "rb").read() for p in mine)
        assert struct.unpack(f"<{7 * 24}H", words) == tuple(v for r in rows if r[0] == c for v in r[2])
    files = small_table(spark, [(p.clip, p.path, p.frames * 48, 4, 6) for p in parts], "clip_id string, path string, length bigint, frame_w int, frame_h int")
    got = tiles.mosaic_pixels(dumps.read_raw16(spark, files, strip_rows=4, halo=1))
    assert got.count() == 14 * 24
    assert got.agg(F.sum("v")).first()[0] == sum(sum(r[2]) for r in rows)


def test_presets_missing_corrupt_and_round_trip(spark, tmp_path):
    assert documents.read_presets(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert documents.read_presets(spark, str(tmp_path / "bad.json")).count() == 0
    good = {"name": "A", "color_space": "Rec.709", "transfer_function": "S-Log3", "codec_family": "HEVC", "rate_control": "Custom: [50M]"}
    body = {"schema_version": 1, "presets": [good, {**good, "name": "B", "codec_family": "odd"}, {"name": "C"}]}
    (tmp_path / "p.json").write_text(json.dumps(body, indent=2))
    first = documents.read_presets(spark, str(tmp_path / "p.json"))
    assert [r.name for r in first.collect()] == ["A"]
    assert first.first().prores_profile == "HQ"
    documents.write_presets(first, str(tmp_path / "out"))
    back = documents.read_presets(spark, str(tmp_path / "out"))
    assert back.drop("pos").collect() == first.drop("pos").collect()


def test_listing_order(spark):
    paths = small_table(
        spark, [("/r/b.txt", 5), ("/r/A.txt", 3), ("/r/.x", 1), ("/r/sub/c.txt", 9), ("/q/z", 1)], "path string, size bigint"
    )
    assert [r.name for r in listing.entries_of(paths, "/r").collect()] == ["..", "A.txt", "b.txt", "sub"]
    assert ".x" in [r.name for r in listing.entries_of(paths, "/r/", True).collect()]


def test_sidecar_defaults(spark, tmp_path):
    (tmp_path / "c1.json").write_text('{"contrast": 1.5}')
    clips = small_table(spark, [("c1",), ("c2",)], "clip_id string")
    got = {r.clip_id: r for r in documents.with_sidecars(clips, documents.read_sidecars(spark, str(tmp_path))).collect()}
    assert (got["c1"].contrast, got["c1"].white_balance_kelvin, got["c2"].contrast, got["c2"].enabled) == (1.5, 5500, 1.0, False)
    none = documents.read_sidecars(spark, str(tmp_path / "missing"))
    assert documents.with_sidecars(clips, none).where("gain_r = 1.0").count() == 2


def drops(spark, folder, rows, ddl="path string, seq int"):
    """Each list of rows as one file, so that each is a batch of the stream."""
    for batch in rows:
        small_table(spark, batch, ddl).coalesce(1).write.mode("append").parquet(str(folder))
    schema = small_table(spark, [], ddl).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def counted(rows):
    return imports.counts_of(rows).first().asDict()


def test_repeated_import_adds_nothing(spark, tmp_path):
    rows = [("a.mcraw", 1, True), ("a.mcraw", 2, True), ("b.mcraw", 3, False), ("c.mcraw", 4, True), ("c.mcraw", 2, False), ("n.txt", 5, True), (None, 6, True), ("d.mcraw", 7, None)]
    stream = drops(spark, tmp_path / "in", [rows], "path string, seq int, ok boolean")
    first = imports.run_import(stream, str(tmp_path / "one"), ok="ok")
    assert sorted((r.path, r.seq) for r in imports.pool_of(first).collect()) == [("a.mcraw", 1), ("c.mcraw", 4)]
    assert counted(first) == {"imported": 2, "failed": 3, "duplicate": 1}
    # offered again to the same stream, and to a new one that knows the pool
    same = imports.run_import(stream, str(tmp_path / "one"), ok="ok")
    assert counted(same) == counted(first)
    again = imports.run_import(stream, str(tmp_path / "two"), ok="ok", pool=imports.pool_of(first))
    assert counted(again) == {"imported": 0, "failed": 3, "duplicate": 3} and imports.pool_of(again).count() == 0


def test_import_opens_clips_and_tells_why_one_failed(spark, clips, tmp_path):
    at = {n: str(clips / n) for n in ("a.mcraw", "b.MCRAW", "short.mcraw", "wrong.mcraw", "cut.mcraw", "late.mcraw", "note.txt")}
    src = tmp_path / "drops"
    stream = drops(spark, src, [[(path, i) for i, path in enumerate(at.values())]])
    folder = str(tmp_path / "run")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in imports.run_import(stream, folder).collect()}
    assert set(rows) == set(at) - {"note.txt"}
    assert {n for n, r in rows.items() if r.imported} == {"a.mcraw", "b.MCRAW", "cut.mcraw"}
    assert rows["late.mcraw"].error.startswith("FileNotFoundError") and rows["wrong.mcraw"].error == "BadClip: unknown magic"
    assert rows["short.mcraw"].error == "BadClip: file ends early" and rows["cut.mcraw"].index_offset is None

    # the missing file appears, a known one vanishes; the stream goes on from its state
    (clips / "a.mcraw").rename(clips / "late.mcraw")
    drops(spark, src, [[(at["a.mcraw"], 20), (at["late.mcraw"], 22), (at["late.mcraw"], 21)], [(at["late.mcraw"], 30), (at["wrong.mcraw"], 31)]])
    told = imports.run_import(stream, folder)
    assert counted(told) == {"imported": 4, "failed": 4, "duplicate": 3}
    assert {r.path: r.seq for r in imports.pool_of(told).collect()}[at["late.mcraw"]] == 21
    assert imports.failures_of(told).where(F.col("path") == at["wrong.mcraw"]).count() == 2

    got = {r.path: r for r in imports.clips_of(told).collect()}
    late = got[at["late.mcraw"]]
    assert (late.frame_count, late.first_ts, late.width) == (5, 1_000_000_000, 4000) and late.fps == pytest.approx(25.0)
    assert got[at["b.MCRAW"]].fps == 25.0 and len(got) == 4


def test_import_state_is_one_row_per_path(spark, clips, tmp_path):
    """A path dropped in every batch is opened once and is one row of state; its drops are combined before the shuffle."""
    path = str(clips / "a.mcraw")
    stream = drops(spark, tmp_path / "drops", [[(path, 100 * b + i) for i in range(50)] for b in range(3)])
    told = imports.run_import(stream, str(tmp_path / "run"))
    assert sorted(r.duplicate for r in told.collect()) == [49, 50, 50]
    state = spark.read.format("statestore").option("stateVarName", "imported").load(str(tmp_path / "run" / "checkpoint"))
    assert state.count() == 1
    batch = pa.RecordBatch.from_pydict({"path": [path] * 9, "seq": list(range(9)), "ok": [None] * 9})
    assert [b.num_rows for b in imports._combined(iter([batch]))] == [1]


def test_import_of_nothing(spark, tmp_path):
    stream = drops(spark, tmp_path / "drops", [[]])
    told = imports.run_import(stream, str(tmp_path / "run"))
    assert counted(told) == {"imported": 0, "failed": 0, "duplicate": 0} and imports.clips_of(told).collect() == []


def test_streams_over_several_batches_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    data = [(i % 3, vocab.PHASES[i % 11], (i * 7919) % 100_000 + 1) for i in range(600)]
    events = small_table(spark, data, "run_id int, phase string, ns bigint")
    events.repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    phases = live.live_phases(stream)
    out = live.run_to_end(phases, "update", str(tmp_path / "run"))
    got = live.latest(spark, out, phases.schema, ["run_id", "phase"])
    want = phase_snapshot(events)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_live_rate_carries_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    counts = {(c, s): 1 + (s * 7 + c) % 5 for c in (1, 2) for s in range(1000, 1060, 2) if c == 1 or s > 1030}
    for start in (1000, 1020, 1040):
        rows = [(c, s * 1000 + k) for (c, s), n in counts.items() if start <= s < start + 20 for k in range(n)]
        df = small_table(spark, rows, "clip_id int, ms bigint").withColumn("at", F.timestamp_millis("ms")).drop("ms")
        df.coalesce(1).write.mode("append").parquet(src)
        schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    folder = str(tmp_path / "run")
    got = {(r.clip_id, r.second): (r.n, r.rate) for r in live.rates_to_end(stream, folder, late="5 seconds").collect()}
    want = {}
    for c in (1, 2):
        rate = None
        for (clip, s), n in sorted(counts.items()):
            if clip == c:
                rate = float(n) if rate is None else rate * 0.9 + n * 0.1
                want[c, s] = (n, pytest.approx(rate))
    # the last seconds too, which no later frame closes
    assert got == want
    told = spark.read.parquet(f"{folder}/out").count()
    assert 30 < told < len(want)


def test_job_state_is_a_row_per_job(spark, tmp_path):
    src = str(tmp_path / "in")
    ddl = "job_id int, seq int, kind string, percent double, cancelled boolean, error string"
    rows = [(j, 10 * s + b, "progress" if s < 3 else ("ok" if j % 2 else "error"), 25.0 * s, j == 3, f"e{s}") for b in range(3) for s in range(4) for j in range(5)]
    for part in range(4):
        small_table(spark, rows[part::4], ddl).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    checkpoint = live.run_keyed(live.job_states(stream), str(tmp_path / "run"))
    got = {r.job_id: (r.seq, r.kind, r.percent, r.error, r.outcome) for r in live.job_table(spark, checkpoint).collect()}
    ends = ["Failed", "Completed", "Failed", "Waiting", "Failed"]
    assert got == {j: (32, "ok" if j % 2 else "error", 75.0, "e3", ends[j]) for j in range(5)}
    # four batches, one row per job
    assert spark.read.format("statestore").load(checkpoint).count() == 5


def test_encode_by_clip_uses_each_clips_curve(spark):
    px = small_table(spark, [(1, 0.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5)], "clip_id int, r double, g double, b double")
    params = small_table(spark, [(1, "Linear"), (2, "Gamma 2.4")], "clip_id int, transfer string")
    got = {r.clip_id: r.r for r in curves.encode_by_params(px, params).collect()}
    assert got == {1: 0.5, 2: pytest.approx(0.5 ** (1 / 2.4))}


def test_from_files_to_colour(spark, tmp_path):
    """Containers, dumps, parameters, crop, lens grid and develop, end to end."""
    from rawlake.operators import develop, params

    w, h, n = 12, 10, 3
    rows = [(i, 10**9 + i * 40_000_000, 250.0, 80) for i in range(n)]
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "a.mcraw").write_bytes(headed_bytes(9, rows))
    path = str(tmp_path / "clips" / "a.mcraw")
    paths = small_table(spark, [(path,)], "path string")
    raw = containers.scan_paths(paths)
    index = containers.frame_index(containers.clips(raw))
    clips = containers.clips(raw, timeline.clip_timeline(index))
    clips = clips.withColumns({"width": F.lit(w), "height": F.lit(h), "active_offset_x": F.lit(2), "active_offset_y": F.lit(1),
                               "active_width": F.lit(8), "active_height": F.lit(6),
                               "lens_grid": F.array(*[F.array(*[F.lit(1.0)] * 4)] * 4), "grid_w": F.lit(2), "grid_h": F.lit(2)})
    mosaics = small_table(spark, [("a", i, [500] * (w * h)) for i in range(n)], "clip_id string, ordinal int, px array<int>")
    parts = dumps.write_raw16(mosaics.coalesce(1), str(tmp_path / "raw"))
    files = parts.select(F.lit(path).alias("clip_id"), "path", (F.col("frames") * w * h * 2).alias("length"), F.lit(w).alias("frame_w"), F.lit(h).alias("frame_h"))
    files = small_table(spark, [tuple(r) for r in files.collect()], "clip_id string, path string, length bigint, frame_w int, frame_h int")
    clip = params.clip_params(clips, "Rec.709")
    frames = params.frame_params(clip, containers.frame_meta(index))
    strips = dumps.read_raw16(spark, files, strip_rows=4, halo=2)
    area = tiles.cropped(strips, clip)
    for mode in ("Off", "Full", "ColorOnly"):
        got = develop.develop(area, frames, "S-Log3", lens_mode=mode, grids=clips)
        assert got.count() == n * 8 * 6
        bounds = got.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        assert tuple(bounds) == (2, 9, 1, 6)
        assert got.select("r", "g", "b").distinct().count() == 1
