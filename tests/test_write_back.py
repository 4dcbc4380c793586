"""Changed transcripts on disk, copies of a conversation, and what limits leave out."""

import json
import os
import time

import pytest
from conftest import rows

from chainloom.operators import codecheck as cc
from chainloom.operators import rewrite as rw
from chainloom.sources import projects as pj
from chainloom.sources import transcripts as tr


def put(folder, name, entries):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(e if isinstance(e, str) else json.dumps(e) + "\n" for e in entries)


def entry(uuid, parent, text, role="user", **more):
    return {"uuid": uuid, "parentUuid": parent, "type": role, "timestamp": "2026-01-01T00:00:01Z", "message": {"role": role, "content": text, "id": 7}, **more}


def test_changed_lines_keep_every_other_field(spark, tmp_path):
    put(str(tmp_path / "in"), "c1.jsonl", [entry("u1", None, "one", extra={"a": [1, None]}), "{broken\n", entry("u2", "u1", "two", "assistant")])
    m = tr.read_transcripts(spark, str(tmp_path / "in"))
    new = spark.createDataFrame([("c1", "u2", None, "new \"text\"")], "conv string, uuid string, parent_uuid string, text string")
    added = spark.createDataFrame([("c1", 3, "u3", "u2", "user", "more")], "conv string, line long, uuid string, parent_uuid string, type string, text string")
    out, _ = rw.rewrite(m, replace=new, append=added)
    tr.write_transcripts(out, str(tmp_path / "out"))
    again = {r.line: r for r in tr.read_transcripts(spark, str(tmp_path / "out")).collect()}
    assert [(again[i].uuid, again[i].parent_uuid, again[i].text) for i in (0, 2, 3)] == [("u1", None, "one"), ("u2", None, 'new "text"'), ("u3", "u2", "more")]
    assert again[1].is_corrupt and again[1].raw == "{broken"
    assert json.loads(again[0].raw)["extra"] == {"a": [1, None]}
    assert json.loads(again[2].raw)["message"] == {"role": "assistant", "content": 'new "text"', "id": 7}
    added_line = json.loads(again[3].raw)
    assert added_line["message"] == {"role": "user", "content": "more"} and added_line["isSidechain"] is False


def test_a_row_without_its_line_is_refused(spark, tmp_path):
    lost = spark.createDataFrame([("c1", 0, None)], "conv string, line long, raw string")
    with pytest.raises(Exception, match="no line text"):
        tr.write_transcripts(lost, str(tmp_path / "out"))


def test_one_copy_of_a_conversation_is_read(spark, tmp_path):
    put(str(tmp_path / "p1"), "c1.jsonl", [entry("u1", None, "old")])
    put(str(tmp_path / "p2"), "c1.jsonl", [entry("u1", None, "new"), entry("u2", "u1", "more")])
    put(str(tmp_path / "p1"), "c2.jsonl", [entry("v1", None, "other")])
    past = time.time() - 1000
    os.utime(str(tmp_path / "p1" / "c1.jsonl"), (past, past))
    assert rows(tr.read_transcripts(spark, str(tmp_path)), "conv", "uuid", "text") == [("c1", "u1", "new"), ("c1", "u2", "more"), ("c2", "v1", "other")]
    assert rows(tr.read_transcripts(spark, str(tmp_path), "p1"), "conv", "text") == [("c1", "old"), ("c2", "other")]


def test_bare_calls_of_built_ins_are_no_references(spark):
    code = "const { readFile } = require('fs'); emit(1); get(2); dirname(3); inspect(4); Widget(5); ab(6); ours(7);"
    files = spark.createDataFrame([("p", "a.js", code)], "project string, path string, scan_text string")
    assert rows(cc.extract_references(files), "name") == [("ours",)]


def test_limits_say_what_they_leave_out(spark):
    listing = spark.createDataFrame(
        [("p", "a.py", 10), ("p", "b/c/d.py", 10), ("p", "big.py", 10_000), ("p", "page.html", 10_000), ("p", "x.txt", 1)], "project string, path string, size long"
    )
    assert len(rows(pj.select_files(listing), "path")) == 4
    assert rows(pj.select_files(listing, max_bytes=100), "path") == [("a.py",), ("b/c/d.py",), ("page.html",)]
    assert rows(pj.over_limits(listing, max_depth=1, max_html_bytes=100), "path") == [("b/c/d.py",), ("page.html",)]
    assert rows(pj.over_limits(listing, max_files=1), "path") == [("b/c/d.py",), ("big.py",), ("page.html",)]
