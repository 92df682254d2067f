import pytest

from codewhiff.llm import common
from codewhiff.llm import sharding as S
from helpers import rows_of, table


@pytest.fixture
def store(spark):
    return S.ShardStore(spark, common.fresh_path(spark, "store"))


def shard(n, size):
    return {"file": f"f{n:03d}", "bytes": size, "rows": 1}


def test_plan_merges_similar_sizes_only():
    assert S.ShardStore.plan([shard(i, 100) for i in range(3)], 1000, 4, 4.0) == []
    assert [len(r) for r in S.ShardStore.plan([shard(i, 100) for i in range(8)], 400, 4, 4.0)] == [4, 4]
    assert S.ShardStore.plan([shard(1, 1), shard(2, 10), shard(3, 100), shard(4, 900)], 1000, 2, 4.0) == []
    assert S.ShardStore.plan([shard(i, 900) for i in range(9)], 1000, 2, 4.0) == []


def test_rows_survive_appends_and_merges(spark, store):
    for k in range(5):
        store.append(table(spark, [(k * 100 + i, f"text {i}") for i in range(50)]).repartition(3), rows_each=10)
    before = store.manifest()
    version = store.compact(target=1 << 20, fan_in=2)
    after = store.manifest()
    assert version == before["version"] + 1 == after["version"] and len(after["shards"]) < len(before["shards"]) / 4
    assert rows_of(store.read().select("doc_id")) == [(k * 100 + i,) for k in range(5) for i in range(50)]
    assert rows_of(store.read(before["version"]).select("doc_id")) == rows_of(store.read().select("doc_id"))
    assert store.vacuum() == len(before["shards"])
    assert rows_of(store.read().select("doc_id")) == [(k * 100 + i,) for k in range(5) for i in range(50)]
    assert store.compact(target=1 << 20, fan_in=2) == version


def test_commits_are_atomic(spark, store):
    base = store.manifest()
    store.append(table(spark, [(1, "a")]))
    with pytest.raises(S.Conflict):
        store.commit(base, [], [], "{}")
    assert store.version() == 1 and rows_of(store.read().select("doc_id")) == [(1,)]


def test_files_that_no_manifest_names_are_ignored(spark, store):
    store.append(table(spark, [(1, "a")]))
    table(spark, [(2, "b")]).write.parquet(f"{store.path}/shards/lost")
    assert rows_of(store.read().select("doc_id")) == [(1,)]


def test_odd_rows(spark):
    rows = [(1, None), (None, "x"), (2, ""), (3, "a"), (3, "a"), (4, "long " * 100_000)]
    df = table(spark, rows, clash=True)
    path = common.fresh_path(spark, "odd")
    out = S.shard_documents(df, rows_each=1, fan_in=2, path=path)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((i for i, _ in rows), key=str)
    back = S.ShardStore(spark, path).read()
    assert back.columns == df.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert S.shard_documents(table(spark, [])).collect() == []
