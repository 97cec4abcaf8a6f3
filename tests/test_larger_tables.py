"""Cases that only larger tables bring, cut down to what shows them."""

import os

import duckdb
import numpy as np

from skyanchor.catalogue import ORACLES, QUERIES

from .oracle import compare, connect, TABLES

SF = "/root/testdata/sf0.001"


def tables(folder, **sql):
    """A folder with the given tables by DuckDB's SQL and the others of SF."""
    os.makedirs(folder)
    for t in TABLES:
        if t in sql:
            duckdb.sql(f"COPY ({sql[t]}) TO '{folder}/{t}.parquet'")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def same_as_sql(spark, name, folder) -> str:
    return compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name])


def test_a_window_that_happens_to_hold_all_points_gives_way_to_the_zoom_of_the_altitude(spark, tmp_path):
    # frame 3473 is turned by one degree, and its 60 points fit into the first window
    folder = tables(tmp_path / "t", embeddings=f"SELECT vec_id + 3470 AS vec_id, embedding, label FROM '{SF}/embeddings.parquet' WHERE vec_id < 4")
    assert same_as_sql(spark, "localize_pipeline", folder) == ""


def test_blocks_are_read_row_by_row_and_give_k_rows_a_frame():
    import pyarrow as pa

    from skyanchor.operators import retrieval

    x = np.arange(6, dtype="<f4")
    batch = pa.RecordBatch.from_arrays([pa.array([np.arange(3).tobytes()] * 2, pa.binary()), pa.array([x.tobytes()] * 2, pa.binary())], names=["c_ids", "c_m"])
    ids, m = next(retrieval._each([batch], "c_ids", "c_m"))
    assert ids.tolist() == [0, 1, 2] and m.tolist() == x.tolist()
    # two frames that find all of 1,000 cells alike
    i, j = np.divmod(np.arange(2000), 1000)
    some = retrieval._firsts(i, np.ones(2000), 999 - j, 3)
    assert (i[some].tolist(), (999 - j[some]).tolist()) == ([0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2])


def test_the_cell_of_the_truth_is_not_looked_for_among_pairs_of_rows(spark):
    from skyanchor.operators import retrieval

    f = spark.createDataFrame([(1, 10.0, 20.0, [1.0, 0.0]), (2, -50.0, 179.9999, [0.6, 0.8])], "frame_id bigint, true_lat double, true_lon double, embedding array<float>")
    rows = [(k, 10.0 + k * 1e-6, 20.0, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(1, 9)] + [(2**60, -50.0, -179.9999, [0.6, 0.8]), (2**60 + 1, -50.0, -179.9999, [0.6, 0.8]), (50, None, 3.0, [1.0, 1.0])]
    r = retrieval.true_cell_rank(f, spark.createDataFrame(rows, "cell_id bigint, lat double, lon double, embedding array<float>"))
    got = {x.frame_id: (x.true_cell_rank, round(x.true_cell_m, 1)) for x in r.collect()}
    assert got == {1: (1, 0.1), 2: (2, 14.3)}
    assert "ASIN" not in r._jdf.queryExecution().optimizedPlan().toString().upper()


def test_a_poor_guess_of_the_projections_gives_no_wrong_cell(spark, tmp_path, monkeypatch):
    from skyanchor.operators import vectors

    whole = vectors.lsh_topk
    monkeypatch.setattr(vectors, "lsh_topk", lambda f, c, k: whole(f, c.filter("cell_id % 5 = 0"), k).filter("frame_id % 2 = 0"))
    assert same_as_sql(spark, "retrieval_lsh_nearest", SF) == ""


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_tables_of_much_work_are_dealt_to_many_tasks(spark):
    # by number, which adaptive planning leaves alone
    assert QUERIES["metadata_exif_read"](spark, SF).rdd.getNumPartitions() >= 3
    assert plan_of(QUERIES["geo_haversine_pairs"](spark, SF)).count("RepartitionByExpression [g") == 2
    assert "RepartitionByExpression [pair_id" in plan_of(QUERIES["signal_nmi"](spark, SF))


def test_gradient_signals_hold_one_pair_of_rasters_at_a_time():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from skyanchor.operators import signals

    got = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    x = np.random.default_rng(1).normal(size=(120, 1024)) * 50 + 128
    rasters = pa.array(list(x), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), *[pa.array([32] * 120)] * 2, rasters, rasters], names=["pair_id", "height", "width", "a", "b"])
    tracemalloc.start()
    try:
        out = list(signals.gradient_signals(got)([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out[0].num_rows == 120 and abs(out[0].column("grad_ncc")[7].as_py() - 1) < 1e-9
    assert most < 3 << 20


def test_steps_of_a_user_are_plain_rows_in_order_whatever_frames_they_come_in():
    import pandas as pd

    from skyanchor.operators.sequence import FIELDS
    from skyanchor.streaming.ekf import _steps

    row = dict(zip(FIELDS, (0, 1.0, 2.0, 3.0, 1.0, False, None, None, None, None, None)))
    frames = [pd.DataFrame([row | {"i": 2}, row | {"i": 1, "fix_east_m": 4.0}]), pd.DataFrame([row])]
    got = _steps(frames)
    assert [x[0] for x in got] == [0, 1, 2] and got[1][6] == 4.0 and got[0][6:] == (None,) * 5 and got[2][6] is None
