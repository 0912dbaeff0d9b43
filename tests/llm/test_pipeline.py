"""The stages one after another, on planted cases."""

import random

import corpus_pipeline
from rawlake.llm.common import stage

ITEM = "which of these seven rivers runs through the oldest town of the valley and meets the sea behind the white stone harbour wall"


def planted(spark, folder):
    rng = random.Random(11)

    def prose(n):
        return " ".join(f"word{rng.randrange(3000)}" for _ in range(n)) + "."

    clean = [(d, prose(rng.randrange(60, 200))) for d in range(120)]
    base = prose(150).split()
    near = [(300 + k, " ".join(base[:70] + [f"edit{k}"] + base[71:])) for k in range(6)]
    junk = [(400 + k, " ".join(x + "###" for x in prose(40).split())) for k in range(60)]
    line = "this footer line is long enough and stands in many documents here"
    lined = [(500 + k, prose(80) + "\n" + line) for k in range(8)]
    leaked = [(600 + k, f"{prose(30)} {ITEM} {prose(30)}") for k in range(3)]
    rows = clean + near + junk + lined + leaked + [(700, clean[0][1]), (701, None), (702, "")]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 1) for d, _ in clean] + [(d, 0) for d, _ in junk]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d for d, _ in clean}, {d for d, _ in near}, {d for d, _ in junk}, {d for d, _ in lined}, {d for d, _ in leaked}


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    clean, near, junk, lined, leaked = planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = set(seen["quality_rules"])
    assert not kept & junk and clean | near | lined | leaked <= kept and not kept & {701, 702}
    texts = {d: r.text for d, r in seen["line_dedup"].items()}
    assert {d for d in lined if "footer" in texts[d]} == {max(lined)}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    left = set(seen["near_dedup"])
    assert left & near == {min(near)} and 700 not in left and clean <= left
    assert set(seen["decontamination"]) == left - leaked
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(seen["packing"])


def test_nothing_else_imports_these_operators():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("rawlake/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "rawlake.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
