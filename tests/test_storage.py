"""Tables and folders that queries keep, and when they go."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from cliploom import storage


def there(path):
    return Path(path.removeprefix("file://")).exists()


def test_stored_tables_go_when_discarded(spark):
    since = len(storage.folders())
    one, two = (storage.stored(spark.range(n), "numbers") for n in (3, 5))
    path = storage.fresh_folder(spark, "files")
    spark.range(2).write.parquet(path)
    assert one.count() == 3 and there(one.stored_path) and storage.folders()[since:] == [one.stored_path, two.stored_path, path]
    storage.discard(one, spark.range(1))  # what was not stored is left alone
    assert not there(one.stored_path) and two.count() == 5
    storage.sweep(since)
    assert not there(two.stored_path) and not there(path) and len(storage.folders()) == since


def test_a_stored_empty_table_keeps_its_columns(spark):
    df = storage.stored(spark.createDataFrame([], "a long, b array<string>"), "none")
    assert df.columns == ["a", "b"] and df.collect() == []
    storage.discard(df)


@pytest.mark.parametrize(("master", "ok"), [("local", True), ("local[4]", True), ("yarn", False), ("spark://host:7077", False), ("local-cluster[2,1,1024]", False)])
def test_folders_of_one_machine_serve_local_masters_only(monkeypatch, master, ok):
    conf = {}
    spark = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    monkeypatch.setattr(storage, "_kept", {})
    if ok:
        assert there(storage.shared_folder(spark)) and storage.shared_folder(spark) == conf["spark.checkpoint.dir"]
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            storage.shared_folder(spark)
    conf["spark.checkpoint.dir"] = "hdfs://store/shared/"
    assert storage.shared_folder(spark) == "hdfs://store/shared"
