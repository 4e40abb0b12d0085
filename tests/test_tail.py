"""Files followed while they grow."""

import json
import os

import pytest

from sessionloom.sources import agent_logs, tail
from sessionloom.streaming.sessions import shared_folder


def take(spark, folder, state, **options):
    """Values that one trigger brings, in order of file and place."""
    got = []
    query = tail.tail_lines(spark, str(folder), **options).writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.select("session_id", "at", "value").collect())))
    query.option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
    return [v for _, _, v in sorted(got)]


def test_growth(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    for s in ("a", "b"):
        os.makedirs(logs / s)
    (logs / "a/x.jsonl").write_bytes("one\ntwö\nthr".encode())
    (logs / "b/x.jsonl").write_bytes(b"")
    (logs / "b/x.txt").write_bytes(b"not asked for\n")
    assert take(spark, logs, state) == ["one", "twö"]
    # a partial line gets its end, an empty file its first lines, and there is a new file
    with open(logs / "a/x.jsonl", "ab") as f:
        f.write(b"ee\r\nfour\n\n")
    (logs / "b/x.jsonl").write_bytes(b"b1\n\xff\xfeb2\n" + b"no end")
    assert take(spark, logs, state) == ["three", "four", "", "b1", "��b2"]
    # nothing new, and another query object: a restart
    assert take(spark, logs, state) == []
    os.makedirs(logs / "c/d")
    (logs / "c/d/y.jsonl").write_bytes(b"c1\n")
    assert take(spark, logs, state) == ["c1"]


def test_truncated_replaced_renamed(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    os.makedirs(logs / "s")
    (logs / "s/x.jsonl").write_bytes(b"1\n2\n3\n")
    assert take(spark, logs, state) == ["1", "2", "3"]
    with open(logs / "s/x.jsonl", "r+b") as f:  # shorter
        f.truncate(0)
        f.write(b"4\n")
    assert take(spark, logs, state) == ["4"]
    with open(logs / "s/x.jsonl", "r+b") as f:  # longer, but another beginning
        f.truncate(0)
        f.write(b"5\n6\n7\n8\n")
    assert take(spark, logs, state) == ["5", "6", "7", "8"]
    os.rename(logs / "s/x.jsonl", logs / "s/x.1.jsonl")  # rotated: the old goes on, the new starts
    with open(logs / "s/x.1.jsonl", "ab") as f:
        f.write(b"9\n")
    (logs / "s/x.jsonl").write_bytes(b"n\n")
    assert sorted(take(spark, logs, state)) == ["9", "n"]
    os.remove(logs / "s/x.1.jsonl")
    with open(logs / "s/x.jsonl", "ab") as f:
        f.write(b"m\n")
    assert take(spark, logs, state) == ["m"]


@pytest.mark.parametrize("split", [1, 7, 1000])
def test_ranges_of_a_file(spark, tmp_path, split):
    """Every line comes once, however the file is cut."""
    logs = tmp_path / "logs"
    os.makedirs(logs / "s")
    lines = ["x" * (k % 13) for k in range(60)]
    (logs / "s/x.jsonl").write_text("\n".join(lines) + "\n")
    reader = tail.TailReader({"path": str(logs), "splitBytes": str(split)})
    end = reader.latestOffset()
    got = [v for p in reader.partitions({}, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert got == lines and json.loads(json.dumps(end)) == end
    assert reader.partitions(end, end) == []


def test_parsed_like_a_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    os.makedirs(logs / "s1")
    lines = [{"type": "session_start", "ts": 1, "attrs": {"modelLimit": 9}}, {"type": "tool_call", "name": "read_file", "ts": 2, "attrs": {"args": "{\"path\": \"p\"}"}}, {"kind": "request", "timestamp": 3, "promptTokens": 5}]
    (logs / "s1/x.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + "no json\n")
    got = []
    query = tail.tail_log(spark, str(logs)).writeStream.foreachBatch(lambda b, n: got.extend(map(str, b.collect())))
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == sorted(map(str, agent_logs.parse(agent_logs.read_lines(spark, str(logs))).collect())) and len(got) == 3


def test_other_stores_are_refused(spark):
    with pytest.raises(ValueError):
        tail.local_path("s3://bucket/logs")
    assert tail.local_path("file:///a/b") == "/a/b"
    assert shared_folder(spark, "x")
