import struct

import pytest

from glyphmill.sources import tables, xlog
from glyphmill.sources.errors import CorruptRecordError, ExperienceFormatError, VersionMismatchError
from glyphmill.streaming import live


def rows(n):
    return [dict(id=i, ticks=i * 10, episode=i // 10, step=i % 10, reward=0.5, terminal=i % 10 == 9, obs_kind=1, act_kind=1, obs=struct.pack("<2f", 1, i), act=struct.pack("<i", i % 3), next_obs=struct.pack("<f", i) if i % 2 else None, tags=["a", "é"] if i % 5 == 0 else None) for i in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    w = xlog.Writer(path, rotate=8000)
    for r in rows(300):
        w.append(r)
    w.close()
    return path


def test_round_trip(spark, folder):
    xlog.register(spark)
    assert len(xlog.files(folder, "xlog")) > 2
    got = spark.read.format("xlog").load(folder).orderBy("id").collect()
    for r, want in zip(got, rows(300), strict=True):
        assert r.asDict() == {**want, "obs": bytearray(want["obs"]), "act": bytearray(want["act"]), "next_obs": want["next_obs"] and bytearray(want["next_obs"])}
    log = xlog.from_envelopes(spark.read.format("xlog").load(folder)).orderBy("id").collect()
    assert log[3].obs == [1.0, 3.0] and log[3].act == 0 and log[4].next_obs is None


def test_time_range_and_index(spark, folder):
    xlog.register(spark)
    got = spark.read.format("xlog").option("start", 100).option("end", 200).load(folder)
    assert sorted(r.id for r in got.collect()) == list(range(10, 21))
    index = spark.read.format("fidx").load(folder).orderBy("id").collect()
    assert len(index) == 300 and index[19].flags == 1
    assert xlog.read_at(xlog.files(folder, "xlog")[0], index[5].file_offset)[0] == 5


def test_spark_writes(spark, folder, tmp_path):
    xlog.register(spark)
    out = str(tmp_path)
    spark.read.format("xlog").load(folder).repartition(3).write.format("xlog").mode("append").option("rotateBytes", 4000).save(out)
    back = spark.read.format("xlog").load(out)
    assert back.count() == 300 and back.select("id").distinct().count() == 300
    assert {r.ticks for r in back.collect()} == {i * 10 for i in range(300)}


def test_broken_files(spark, folder, tmp_path):
    data = open(xlog.files(folder, "xlog")[0], "rb").read()
    cut = tmp_path / "a-00000.xlog"
    cut.write_bytes(data[:-3])
    read = []
    with pytest.raises(CorruptRecordError):
        for _, payload in xlog.scan(str(cut)):
            read.append(xlog.decode(payload))
    assert len(read) > 10
    cut.write_bytes(b"NOPE" + data[4:])
    with pytest.raises(ExperienceFormatError):
        list(xlog.scan(str(cut)))
    cut.write_bytes(data[:4] + b"\x09\x00" + data[6:])
    with pytest.raises(VersionMismatchError):
        list(xlog.scan(str(cut)))
    with pytest.raises(VersionMismatchError):
        xlog.decode(b"\x02\x00" + xlog.encode(rows(1)[0])[2:])


def test_stages_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    first = tables.stage(df, str(tmp_path / "s"))
    assert tables.stage(df.limit(0), str(tmp_path / "s")).count() == first.count() == 2
    tables.export_lines(df, str(tmp_path / "t"))
    assert sorted(r.value for r in tables.lines(spark, str(tmp_path / "t")).collect()) == ["a", "b"]


def test_streams_equal_batches(spark, tmp_path):
    log = spark.createDataFrame([(e, s, (s // (2 + e)) % 3, float(s)) for e in range(3) for s in range(12)], "episode int, step int, act int, reward double")
    for part, where in enumerate(["step < 5", "step >= 5"]):
        log.where(where).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    from glyphmill.operators import experience

    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.sink(live.streaks(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {(r.episode, r.step): r.streak for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.episode, r.step): r.streak for r in experience.streaks(log).collect()}
    assert live.counters(q)["enqueued"] == 36


def test_settings_make_a_writer_and_a_policy(tmp_path):
    from glyphmill.config import AgentSettings

    settings = AgentSettings(data_dir=str(tmp_path / "d"))
    w = settings.writer()
    assert [w.append(r) for r in rows(3)] == [0, 1, 2]
    w.close()
    assert len(list(xlog.index_rows(w.paths[0] + ".fidx"))) == 3 and settings.policy().weights.shape == (3, 4)


def test_latest_file_and_a_process_that_ends_without_close(tmp_path):
    import subprocess
    import sys

    assert xlog.latest(str(tmp_path)) is None
    code = f"import sys; sys.path.insert(0, '.')\nfrom tests.test_sources import rows\nfrom glyphmill.sources import xlog\nw = xlog.Writer({str(tmp_path)!r}, flush_every=1000)\n[w.append(r) for r in rows(5)]"
    subprocess.run([sys.executable, "-c", code], check=True)
    again = xlog.Writer(str(tmp_path))
    again.close()
    assert xlog.latest(str(tmp_path)).endswith("exp-00001.xlog")
    assert len(list(xlog.scan(f"{tmp_path}/exp-00000.xlog"))) == 5 and len(list(xlog.index_rows(f"{tmp_path}/exp-00000.fidx"))) == 5


def test_a_time_range_is_planned_from_mapped_indexes_and_opens_a_chunk_once(tmp_path, monkeypatch):
    import builtins

    import numpy as np

    from glyphmill.sources import xlog

    writer = xlog.Writer(str(tmp_path))
    for i in range(50):
        writer.append({"ticks": i * 10, "episode": 1, "step": i, "reward": 1.0, "terminal": False, "obs_kind": 1, "act_kind": 1, "obs": b"x", "act": b"y"})
    writer.close()
    monkeypatch.setattr(xlog, "RECORDS_A_TASK", 20)
    monkeypatch.setattr(xlog, "INDEX_READ", 7)
    reader = xlog._Reader(str(tmp_path), 100, 300)
    spans = reader.partitions()
    assert [len(s.wanted) for s in spans] == [10, 11] and isinstance(spans[0].wanted, np.ndarray)
    assert len(list(xlog.index_rows(xlog.files(str(tmp_path), "fidx")[0]))) == 50
    opened = []
    real = builtins.open
    monkeypatch.setattr(builtins, "open", lambda *a, **k: opened.append(a[0]) or real(*a, **k))
    assert [r[1] for s in spans for r in reader.read(s)] == list(range(100, 301, 10)) and len(opened) == 2
