"""Rows on which constants that fit small tables, or the order of a sum, would show."""

import datetime

from oratorio.operators import vectors as V
from oratorio.plans import registry
from tests.oracle import connect, rows_of, rows_of_sql


def _both(spark, folder, name):
    return rows_of(registry.queries()[name](spark, str(folder))), rows_of_sql(connect(str(folder)), registry.oracle_sql()[name])


def test_choices_with_ids_over_a_million(spark, tmp_path):
    ids = [5 + 13 * 1_000_000, 4 + 2 * 13 * 1_000_000, 13 * 3_000_000_000 + 7, 13 * 3_000_000_000 + 8, 13 * 3_000_000_000 + 14]
    rows = [(i, datetime.datetime(2024, 1, 1), u, "signup" if k % 2 else "view", 1.0, "{}") for u in (1, 2) for k, i in enumerate(x + u * 91 for x in ids)]
    rows += [(42 + 21 * k, datetime.datetime(2024, 1, 1), 3, "view", 0.5, "{}") for k in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("g41_oracle_choice", "o8_argmax"):
        got, wanted = _both(spark, tmp_path, name)
        assert got == wanted, name


def test_mean_vectors_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = [(k, [1.0 / (k + 1), float(k % 7) - 3.1, 1e-3 * k], k % 2) for k in range(400)]
    rows += [(900, [0.0, 0.0, 0.0], 0), (901, [1.0, None, 2.0], 1), (902, [float("nan"), 1.0, 1.0], 0), (903, [float("inf"), 1.0, 1.0], 1), (904, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    exact = lambda x: {r.label: tuple(r.centroid) for r in V.mean_vectors(x, "label", "embedding").collect()}
    one = exact(df.coalesce(1).sortWithinPartitions("vec_id"))
    assert one == exact(df.repartition(7, "vec_id")) == exact(df.coalesce(1).sortWithinPartitions(-df.vec_id))
    con = connect(str(tmp_path))
    assert one == {r[0]: tuple(r[1]) for r in con.execute(registry.oracle_sql()["d15_voice_prints"]).fetchall()}
