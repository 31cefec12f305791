"""The commit log: several writers lose and repeat nothing; removed tenants go from all tables, and from their files alone."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from footfall.sources.table import Conflict, Site, Table

SCHEMA = T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("n", T.LongType())])


def rows(spark, tenants, start=0, each=10):
    return spark.createDataFrame([(t, start + k) for t in tenants for k in range(each)], SCHEMA)


def test_writers_in_threads_lose_and_repeat_nothing(spark, tmp_path):
    root, failed = str(tmp_path / "t"), []

    def write(writer):
        try:
            table = Table(spark, root, SCHEMA)
            for k in range(5):
                table.append(spark.createDataFrame([(f"w{writer}", 100 * writer + k)], SCHEMA))
        except Exception as error:  # noqa: BLE001 - shown by the assertion below
            failed.append(error)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    table = Table(spark, root, SCHEMA)
    assert sorted(r.n for r in table.read().collect()) == sorted(100 * w + k for w in range(4) for k in range(5))
    assert table.state().number == 20


def test_a_number_is_taken_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), SCHEMA)
    entry = {"added": [], "removed": [], "key": None}
    assert table._put(1, entry) and not table._put(1, entry) and table._put(2, entry)


def test_a_number_is_taken_once_by_renaming(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "t"), SCHEMA)

    class Other:
        """The local file system under another name."""

        def __init__(self, files):
            self.files = files

        def getScheme(self):
            return "other"

        def __getattr__(self, name):
            return getattr(self.files, name)

    plain = Table._hadoop
    monkeypatch.setattr(Table, "_hadoop", lambda self, path: (lambda p, f: (p, Other(f)))(*plain(self, path)))
    entry = {"added": [], "removed": [], "key": None}
    assert table._put(1, entry) and not table._put(1, entry) and table._put(2, entry)


def test_a_key_counts_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), SCHEMA)
    assert table.read().count() == 0
    for _ in range(3):
        table.append(rows(spark, ["a"]), key="batch 1")
    table.append(rows(spark, ["a"], 50), key="batch 2")
    assert table.read().count() == 20 and table.state().number == 2


def test_data_without_an_entry_does_not_count(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), SCHEMA)
    table.append(rows(spark, ["a"]))
    table._written(rows(spark, ["b"]))  # a writer that died before its entry
    assert {r.tenant_id for r in table.read().collect()} == {"a"}


def test_only_files_with_removed_tenants_are_replaced(spark, tmp_path):
    site = Site(spark, str(tmp_path), events=SCHEMA, sessions=SCHEMA)
    tenants = [f"t{k:02}" for k in range(40)]
    for k in range(0, 40, 10):
        site["events"].append(rows(spark, tenants[k : k + 10], each=50))
    site["sessions"].append(rows(spark, tenants[:20]))
    site["sessions"].append(rows(spark, tenants[20:]))
    before = dict(site["events"].state().files)
    assert len(before) >= 4
    site.remove(spark.createDataFrame([("t03",), ("t99",), (None,)], "tenant_id string"))
    kept = Counter({t: 50 for t in tenants if t != "t03"})
    assert Counter(r.tenant_id for r in site["events"].read().collect()) == kept
    assert Counter(r.tenant_id for r in site["sessions"].read().collect()) == Counter({t: 10 for t in tenants if t != "t03"})
    # A late row of a removed tenant is not seen either.
    site["events"].append(rows(spark, ["t03", "t50"], 7, 1))
    assert Counter(r.tenant_id for r in site["events"].read().collect()) == kept + Counter({"t50": 1})
    late = len(site["events"].state().files) - len(before)
    replaced = site.rewrite()
    holding = [f for f in before.values() if f["low"] <= "t03" <= f["high"]]
    assert replaced["events"] <= len(holding) + late < len(before) and replaced["sessions"] == 1
    after = site["events"].state().files
    assert all(path in after for path, f in before.items() if not f["low"] <= "t03" <= f["high"])
    assert site["events"]._scan(list(after)).where("tenant_id = 't03'").count() == 0
    assert Counter(r.tenant_id for r in site["events"].read().collect()) == kept + Counter({"t50": 1})
    assert site.rewrite() == {"events": 0, "sessions": 0}


def test_of_two_rewrites_one_gives_up(spark, tmp_path):
    site = Site(spark, str(tmp_path), events=SCHEMA)
    site["events"].append(rows(spark, ["a", "b"]))
    site.remove(spark.createDataFrame([("a",)], "tenant_id string"))
    slow, first = site["events"], Table(spark, site["events"].root, SCHEMA, gone=site.removed)
    written = slow._written

    def overtaken(df):
        first.rewrite()
        return written(df)

    slow._written = overtaken
    with pytest.raises(Conflict):
        slow.rewrite()
    assert Counter(r.tenant_id for r in first.read().collect()) == Counter({"b": 10})
    # An append meanwhile is no conflict.
    first.append(rows(spark, ["c"]))
    assert first.read().where(F.col("tenant_id") == "c").count() == 10
