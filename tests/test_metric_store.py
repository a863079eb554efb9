"""The metric store: replay, compaction, and what is left in its folder."""

import uuid
from datetime import datetime, timedelta
from decimal import Decimal

from riskspark.operators import counters as ct
from riskspark.session import checkpoint_path
from riskspark.sources import folders, metric_store as ms

METRIC = "batch_id long, name string, kind string, value decimal(38,6), ts timestamp"


def batch(n, factor=1):
    ts = datetime(2024, 1, 1) + timedelta(seconds=n)
    return [(n, "rows", "counter", Decimal(n * factor), ts), (n, "size", "gauge", Decimal(n * 10 * factor), ts)] + (
        [(n, "rare", "counter", Decimal("0.5"), ts)] if n % 7 == 0 else [])


def folded(spark, path):
    return {r.name: (float(r.value), r.n_batches) for r in ct.metric_fold(ms.read_metrics(spark, path)).collect()}


def expected(n):
    rare = len([b for b in range(n) if b % 7 == 0])
    return {"rows": (float(sum(range(n))), n), "size": (10.0 * (n - 1), n), "rare": (0.5 * rare, rare)}


def test_compaction_bounds_the_folder_and_survives_replay(spark):
    path = checkpoint_path(spark, "test-store", uuid.uuid4().hex)
    assert folded(spark, path) == {} and ms.high_water(spark, path) is None
    write = lambda ns, factor=1: ms.write_metrics(spark.createDataFrame([r for n in ns for r in batch(n, factor)], METRIC), path)
    for at in range(0, 120, 20):
        write(range(at, at + 20))
        assert folded(spark, path) == expected(at + 20)
        ms.compact_metrics(spark, path, at + 14)
        assert ms.high_water(spark, path) == at + 14 and folded(spark, path) == expected(at + 20)
    assert folders.numbers(spark, path, "batch_id", finished=False) == [*range(95, 120)]  # of the last two compactions
    assert folders.numbers(spark, f"{path}/_base", "upto") == [94, 114]
    write([100, 5], factor=9)                      # closed batches again, even with other values: nothing changes
    assert folded(spark, path) == expected(120)
    write([119, 117])                              # open ones are replaced
    assert folded(spark, path) == expected(120)
    ms.compact_metrics(spark, path, 114)
    ms.compact_metrics(spark, path, 50)
    assert folded(spark, path) == expected(120)
    rows = ms.history(spark, path)
    assert rows.count() == sum(len(batch(n)) for n in range(120))
    assert {r.batch_id for r in rows.collect()} == set(range(120))


def test_a_compaction_that_broke_off_is_run_again(spark):
    path = checkpoint_path(spark, "test-store", uuid.uuid4().hex)
    ms.write_metrics(spark.createDataFrame([r for n in range(10) for r in batch(n)], METRIC), path)
    # history and base half written: no commit marker
    for part in ("_history", "_base"):
        ms.fold_rows(ms.read_metrics(spark, path)).write.parquet(f"{path}/{part}/upto=6")
        folders.remove(spark, f"{path}/{part}/upto=6/_SUCCESS")
    assert ms.high_water(spark, path) is None and folded(spark, path) == expected(10)
    ms.compact_metrics(spark, path, 6)
    assert ms.high_water(spark, path) == 6 and folded(spark, path) == expected(10)
