"""Queries against their SQL on rows that larger tables have, and on tables of several files."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import test_queries
from test_queries import canonical, entry

SF = test_queries.Path("/root/testdata/sf0.001")
# frames whose colours lie within a last bit of a half millionth
EDGES = {
    21045: "8892 8454 8168 6621 8947 7298 8435 9331 9521 7512 7230 7120 8837 8750 8228 5837 7516 9263 9710 7351 8190 8737 7997 8519 7669 7375 7648 8215 8417 9055 8173 8690 8282 7507 9770 7976 7887 9680 9018 9583 7806 8967 9430 10442 7735 7815 8611 9364 9635 7850 7422 7447 10523 7795 7991 7273 8391 9525 10301 8520 6169 7664 7927 10561",
    24835: "7023 9885 7635 9694 7515 7206 8862 7983 7970 7796 9589 6284 10525 7419 9962 9400 7723 8596 8987 8368 8899 8819 8735 9543 8663 8307 6963 8169 9200 6581 6065 8667 8249 8525 7305 9482 9317 9459 8785 8972 9109 10108 8441 7411 8783 7204 8215 6449 8035 7911 9664 8882 6678 8502 8520 8093 7828 9691 9316 7545 8893 7974 6992 8931",
    41468: "7886 8412 7812 9192 6999 9398 8267 7821 9699 9664 7907 8837 7903 9894 8801 8052 7536 9402 8673 7746 8420 7897 8596 9082 8984 8587 7233 8626 6678 8010 7536 7195 7289 6608 7454 8410 5424 6619 6925 8503 8184 7439 8227 9049 7601 6337 8413 9700 9740 6506 8655 9340 6603 6580 7777 7522 8851 8360 6950 8476 8617 8888 9806 6094",
}


def folder_with(path, **tables):
    """The smallest tables, some of them replaced."""
    for file in os.listdir(SF):
        if file.removesuffix(".parquet") not in tables:
            os.symlink(SF / file, path / file)
    for name, table in tables.items():
        pq.write_table(table, path / f"{name}.parquet")
    return str(path)


def assert_equal(spark, folder, name):
    con = duckdb.connect()
    for table in test_queries.TABLES.split():
        file = f"{folder}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{file + '/*.parquet' if os.path.isdir(file) else file}'")
    df = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert len(rows) > 0
    assert canonical(df.collect(), df.columns) == canonical(rows, columns)


def test_edge_colours_have_the_last_bits_of_the_sql(spark, tmp_path):
    frames = {
        "vec_id": pa.array(list(EDGES), pa.int64()),
        "embedding": pa.array([[int(v) / 8192 - 1 for v in px.split()] for px in EDGES.values()], pa.list_(pa.float32())),
        "label": pa.array([0] * len(EDGES), pa.int32()),
    }
    assert_equal(spark, folder_with(tmp_path, embeddings=pa.table(frames)), "p7_demosaic_edges")


def test_streams_read_tables_of_several_files(spark, tmp_path):
    folder = folder_with(tmp_path, documents=pa.table({}))
    rows = pq.read_table(SF / "documents.parquet")
    os.remove(tmp_path / "documents.parquet")
    os.mkdir(tmp_path / "documents.parquet")
    for k in range(3):
        pq.write_table(rows.slice(k * 70, 70 if k < 2 else None), tmp_path / f"documents.parquet/part-{k}.parquet")
    assert_equal(spark, folder, "r1_import_stream")


def test_red_gain_of_a_first_frame_without_blue(spark, tmp_path):
    rows = pq.read_table(SF / "events.parquet")
    value = pa.array([0.0 if k % 2 else v for k, v in enumerate(rows.column("value").to_pylist())])
    rows = rows.set_column(rows.schema.get_field_index("value"), "value", value)
    assert_equal(spark, folder_with(tmp_path, events=rows), "s1_headed_clips")
