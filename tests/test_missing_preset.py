"""Jobs of a batch without a preset are told, not dropped."""

from rawlake.plans import export
from rawlake.queries import planning


def test_jobs_without_a_preset_are_rejected(spark, sf, monkeypatch):
    real = planning.nation_presets
    every = {r.seq: r.rejected for r in planning.e7(spark, sf).collect()}
    monkeypatch.setattr(planning, "nation_presets", lambda spark, sf: real(spark, sf).where("batch <> 4"))
    got = {r.seq: r.rejected for r in planning.e7(spark, sf).collect()}
    batch = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    assert export.NO_PRESET not in every.values() and 4 in {batch[s] for s in every}
    assert got == {s: export.NO_PRESET if batch[s] == 4 else why for s, why in every.items()}
