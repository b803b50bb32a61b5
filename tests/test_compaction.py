"""Latest-record tables: compaction beside appends, and what readers see."""

import random

import pytest

from strandframe.streaming import incremental

KEY, ORDER = ["id"], ["v"]


def write(spark, folder, number, rows):
    """A batch as the stream writes it."""
    spark.createDataFrame(rows, "id long, v long, w string").write.mode("overwrite").parquet(f"{folder}/table/upsert_version={number}")


def latest(batches):
    out = {}
    for n, rows in sorted(batches.items()):
        for i, v, w in rows:
            if i not in out or (v, n) >= out[i][:2]:
                out[i] = (v, n, w)
    return {i: (v, w) for i, (v, n, w) in out.items()}


@pytest.mark.parametrize("delete", [False, True])
def test_compaction_keeps_the_latest(spark, tmp_path, delete):
    rng, folder, batches = random.Random(1), str(tmp_path / "t"), {}
    assert incremental.read_latest(spark, folder, KEY, ORDER) is None and incremental.compact_latest(spark, folder, KEY, ORDER) is None
    for n in range(6):
        ids = rng.sample(range(40), 15)
        batches[n] = [(i, rng.randrange(5), f"b{n}") for i in ids]
        write(spark, folder, n, batches[n])
        if n in (1, 2, 4):
            before = incremental.read_latest(spark, folder, KEY, ORDER)
            assert incremental.compact_latest(spark, folder, KEY, ORDER, delete) == n
            after = incremental.read_latest(spark, folder, KEY, ORDER)
            assert "Exchange" not in after._jdf.queryExecution().executedPlan().toString()
            if not delete:  # a reader that began before still has its files
                assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
        got = {r["id"]: (r["v"], r["w"]) for r in incremental.read_latest(spark, folder, KEY, ORDER).collect()}
        assert got == latest(batches)
    assert incremental._numbers(spark, f"{folder}/table", "upsert_version") == ([5] if delete else list(range(6)))


def test_unfinished_batches_wait(spark, tmp_path):
    """A batch that is being written is not compacted, nor are those after it; a second compaction to the same batch is refused."""
    folder = str(tmp_path / "t")
    for n in range(3):
        write(spark, folder, n, [(1, n, f"b{n}")])
    (tmp_path / "t" / "table" / "upsert_version=1" / "_SUCCESS").unlink()
    assert incremental.compact_latest(spark, folder, KEY, ORDER) == 0
    assert incremental.compact_latest(spark, folder, KEY, ORDER) is None
    assert [tuple(r) for r in incremental.read_latest(spark, folder, KEY, ORDER).collect()] == [(1, 2, "b2")]
