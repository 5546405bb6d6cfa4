import numpy as np
import pytest

from tessera.llm.common import global_rank, joined_bytes, shared_dir, with_small, words_of, written
from tessera.llm.hilbert import hilbert_index


def test_words_do_not_cross_texts():
    texts = ["ab c", None, "", "d\x0be", "f", "g h "]
    data, offsets = joined_bytes(texts)
    starts, ends, counts = words_of(data, offsets)
    assert counts.tolist() == [2, 0, 0, 2, 1, 2]
    assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends)] == ["ab", "c", "d", "e", "f", "g", "h"]


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_each_point_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    h = hilbert_index(grid, bits)
    assert sorted(h) == list(range(len(grid)))
    path = grid[np.argsort(h)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_global_rank_and_small_join(spark):
    df = spark.createDataFrame([(i * 7 % 50, f"k{i % 3}") for i in range(50)], "v int, k string")
    ranked = global_rank(df, ["v"], "place").collect()
    assert all(r["place"] == r["v"] for r in ranked)
    assert global_rank(df.limit(0), ["v"], "place").count() == 0
    import tessera.llm.common as common

    small = spark.createDataFrame([("k0", 1), ("k1", 2)], "k string, n int")
    want = sorted(map(tuple, with_small(df, small, "k", "left").select("v", "n").collect()), key=str)
    before, common.BROADCAST_ROWS = common.BROADCAST_ROWS, 1
    try:
        assert sorted(map(tuple, with_small(df, small, "k", "left").select("v", "n").collect()), key=str) == want
    finally:
        common.BROADCAST_ROWS = before


def test_tables_go_to_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert written(spark.range(3), "t").inputFiles()[0].startswith("file:")
