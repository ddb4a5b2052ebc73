from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from sensorloom.schema import EEG_CHANNELS
from sensorloom.sources import checksums, scratch
from sensorloom.sources.checksums import file_checksums, parse_manifest, verify_checksums
from sensorloom.sources.files import csv_scans
from sensorloom.sources.numeric import STREAM_FILES, eeg_marks, load_eeg, load_samples, scan_numeric_csv
from sensorloom.sources.scratch import scratch_root
from sensorloom.sources.sessions import (
    expected_files,
    list_files,
    missing_files,
    require_complete,
    session_index,
)
from sensorloom.sources.tables import cached_table, read_samples, store_samples


def _write_raw(root, participants=(0, 12)):
    for participant in participants:
        for condition in ("baseline", "cognitive_load"):
            folder = root / str(participant) / condition
            folder.mkdir(parents=True)
            (folder / "empatica_bvp.csv").write_text("bvp,time\n1.0,2.0\nbad,1.0\n3.0,\n")
            (folder / "empatica_eda.csv").write_text("eda,time\n0.5,1.0\n")
            (folder / "empatica_temp.csv").write_text("temp,time\n30.5,1.0\n")
            header = ["Other", "time", "HeadBandOn", *EEG_CHANNELS]
            lines = [",".join(header)]
            for worn in ("1.0", "0.0", ""):
                lines.append(",".join(["x", "1.0", worn, *["0.25"] * 19, ""]))
            (folder / "muse_eeg.csv").write_text("\n".join(lines) + "\n")


def test_raw_layout(spark, tmp_path):
    _write_raw(tmp_path)
    samples = load_samples(spark, str(tmp_path))
    rows = sorted(map(tuple, samples.where("patient_id = 'p_12' AND condition = 'baseline'").collect()), key=str)
    assert rows == [
        ("p_12", "baseline", "bvp", 1.0, None),
        ("p_12", "baseline", "bvp", 2.0, 1.0),
        ("p_12", "baseline", "eda", 1.0, 0.5),
        ("p_12", "baseline", "temperature", 1.0, 30.5),
    ]
    eeg = load_eeg(spark, str(tmp_path))
    assert eeg.count() == 4
    row = eeg.first()
    assert row["Gamma_AF8"] == 0.25 and row["Gamma_TP10"] is None
    marks = eeg_marks(eeg)
    assert marks.columns == samples.columns and marks.count() == 4


def test_stored_samples_prune_by_stream(spark, tmp_path):
    _write_raw(tmp_path / "raw")
    samples = load_samples(spark, str(tmp_path / "raw"))
    store_samples(samples, str(tmp_path / "stored"))
    stored = read_samples(spark, str(tmp_path / "stored"))
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, samples.collect()), key=str)
    plan = stored.where("stream = 'bvp'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stream" in plan


def test_only_named_columns_are_read(spark, tmp_path):
    _write_raw(tmp_path, [1])
    path = f"{tmp_path}/1/baseline/muse_eeg.csv"
    plan = scan_numeric_csv(spark, path, ["time", "Alpha_AF7"])._jdf.queryExecution().executedPlan().toString()
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "Alpha_AF7" in read_schema and "Alpha_AF8" not in read_schema
    with pytest.raises(ValueError, match="absent"):
        scan_numeric_csv(spark, path, ["time", "absent"])


def test_headers_decide_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,"value",other\n1,2,x\n')
    (tmp_path / "b.csv").write_text("\ufeffother,extra,value,time\ny,z,4,3\nq,q,,5\nlate,q,7,\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as packed:
        packed.write("value,Value,x,x,time\n6,9,9,9,5.5\n")
    found = scan_numeric_csv(spark, str(tmp_path), ["time", "value"])
    assert sorted(map(tuple, found.collect())) == [(1.0, 2.0), (3.0, 4.0), (5.0, None), (5.5, 6.0)]
    assert scan_numeric_csv(spark, f"{tmp_path}/b.csv", ["time"], ["other"]).columns == ["other", "time"]
    (tmp_path / "d.csv").write_text("time,value,value\n1,2,3\n")
    with pytest.raises(ValueError, match="twice.*d.csv"):
        scan_numeric_csv(spark, str(tmp_path), ["time", "value"])
    (tmp_path / "d.csv").write_text("\n1,2\n")
    with pytest.raises(ValueError, match="not found: time, value.*d.csv"):
        scan_numeric_csv(spark, str(tmp_path), ["time", "value"])


def test_headers_of_many_files_take_one_scan_each(spark, tmp_path):
    for i in range(12):
        columns = ["time", "value"] if i % 3 else ["value", "time"]
        (tmp_path / f"{i}.csv").write_text(",".join(columns) + f"\n{i},{i}\n")
    assert len(csv_scans(spark, str(tmp_path), ["time", "value"])) == 2
    assert scan_numeric_csv(spark, str(tmp_path), ["time", "value"]).count() == 12


def test_completeness(spark, tmp_path):
    _write_raw(tmp_path, [0, 1, 2])
    for condition in ("baseline", "cognitive_load"):
        (tmp_path / "1" / condition / "empatica_eda.csv").unlink()
    participants = spark.createDataFrame([(0,), (1,), (2,), (3,)], "participant_number long")
    index = session_index(participants, str(tmp_path))
    assert index.count() == 8 and len([c for c in index.columns if c.endswith("_path")]) == len(STREAM_FILES)
    listing = list_files(spark, str(tmp_path))
    absent = missing_files(expected_files(index), listing)
    assert absent.count() == 10
    with pytest.raises(FileNotFoundError) as error:
        require_complete(expected_files(index), listing)
    assert str(error.value).count("\n") == 8
    present = session_index(participants.where("participant_number IN (0, 2)"), str(tmp_path))
    require_complete(expected_files(present), listing)


def test_checksums_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"three")
    digest = hashlib.sha256(b"one").hexdigest()
    lines = spark.createDataFrame([(f"{digest}   a.txt ",), ("00 b.txt",)], "value string")
    status = verify_checksums(file_checksums(spark, str(tmp_path), str(tmp_path)), parse_manifest(lines))
    found = {r["path"]: r["status"] for r in status.collect()}
    assert found == {"a.txt": "verified", "b.txt": "mismatch", "c.txt": "unlisted"}


def test_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    large = random.Random(1).randbytes(3 * (1 << 20) + 17)
    (tmp_path / "in" / "deep folder").mkdir(parents=True)
    (tmp_path / "in" / "deep folder" / "la%20rge.bin").write_bytes(large)
    (tmp_path / "in" / "empty.bin").write_bytes(b"")
    found = {r["path"]: r["checksum"] for r in file_checksums(spark, str(tmp_path), f"{tmp_path}/in/").collect()}
    # Spark lists no file without bytes.
    assert found == {"deep folder/la%20rge.bin": hashlib.sha256(large).hexdigest()}
    sizes = []

    class Watched:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, size):
            sizes.append(size)
            return self.stream.read(size)

    monkeypatch.setattr(checksums, "opened", lambda uri: Watched(open(uri, "rb")))
    assert checksums.file_digest(f"{tmp_path}/in/deep folder/la%20rge.bin") == hashlib.sha256(large).hexdigest()
    assert set(sizes) == {checksums.BLOCK_BYTES} and len(sizes) == 5


def test_cache_depends_on_the_input_files(spark, tmp_path):
    source, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    def cached():
        return cached_table(spark, str(tmp_path / "out"), "t", {}, build, inputs=[source]).count()

    spark.range(3).write.parquet(source)
    assert [cached(), cached(), len(built)] == [3, 3, 1]
    spark.range(4).write.mode("append").parquet(source)
    assert [cached(), cached(), len(built)] == [7, 7, 2]


def test_scratch_of_a_scope_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(tmp_path))
    outside = scratch.materialize(spark.range(2))
    with scratch.scratch_scope():
        scratch.materialize(outside).count()
    assert outside.count() == 2 and len({p.parent for p in tmp_path.rglob("*.parquet")}) == 1
    scratch.release(outside)
    assert not any(tmp_path.rglob("*.parquet"))


def test_cache_depends_on_parameters(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert cached_table(spark, str(tmp_path), "t", {"n": n}, lambda n=n: build(n)).count() == n
    assert built == [3, 4]
    cached_table(spark, str(tmp_path), "t", {"n": 3}, lambda: build(3), rebuild=True)
    assert built == [3, 4, 3]


def test_scratch_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(tmp_path))
    kept = scratch.materialize(spark.range(3))
    assert kept.count() == 3 and any(tmp_path.rglob("*.parquet"))
    scratch.clear_scratch(spark)
    assert not any(tmp_path.rglob("*.parquet"))


def test_scratch_follows_the_session_setting(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before or scratch_root(spark)

    class Configured:
        class conf:
            @staticmethod
            def get(name, default=None):
                return "/shared/place/" if name == "spark.checkpoint.dir" else default

    assert scratch_root(Configured) == "/shared/place"
