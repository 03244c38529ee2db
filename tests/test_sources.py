import json
import os
import random
import re

import duckdb
import pytest

from pyspark.sql import functions as F

from quillveil import tables
from quillveil.operators import jsontext
from quillveil import provenance
from quillveil.__main__ import main
from quillveil.functions import identifiers
from quillveil.operators import detection, evaluation
from quillveil.plans import catalog
from quillveil.sources import catalogs, corpora, directory, files, settings

SF = "/root/testdata/sf0.001"


def test_directory_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"mail a@x.com\r\nIBAN DE89370400440532013000\r\n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe a@x.com")
    os.symlink(tmp_path / "d/a.txt", tmp_path / "link.txt")
    os.mkfifo(tmp_path / "pipe")
    listed = directory.entries(spark, str(tmp_path))
    assert {(os.path.basename(r["path"]), r["kind"], r["bytes"]) for r in listed.collect()} == {("bad.txt", "file", 10), ("a.txt", "file", 43), ("link.txt", "link", None), ("pipe", "special", None)}
    assert {(os.path.basename(r["path"]), r["kind"], (r["text"] or "")[-2:]) for r in directory.contents(listed).collect()} == {("bad.txt", "not_utf8", ""), ("a.txt", "text", "\r\n"), ("link.txt", "link", ""), ("pipe", "special", "")}
    assert files.scan(spark, str(tmp_path), local=True)[1].first().asDict() == {"findings": 2, "files": 1, "skipped": 1, "unreadable": 0}
    assert files.scan(spark, str(tmp_path / "none"), local=True)[1].first().asDict() == {"findings": 0, "files": 0, "skipped": 0, "unreadable": 1}
    assert [tuple(r) for r in directory.entries(spark, str(tmp_path / "d/a.txt")).select("kind", "bytes").collect()] == [("file", 43)]
    os.remove(tmp_path / "pipe")
    os.remove(tmp_path / "link.txt")
    found, totals, skipped = files.scan(spark, str(tmp_path))
    assert {(r["entity_type"], r["start"], r["value"]) for r in found.collect()} == {("EMAIL", 5, "…"), ("IBAN", 19, "DE89…00")}
    assert totals.first().asDict() == {"findings": 2, "files": 1, "skipped": 1, "unreadable": 0} and skipped.count() == 1
    assert files.render(found, totals).splitlines() == ["1 files, 2 findings, 1 skipped, 0 unreadable", "EMAIL: 1", "IBAN: 1", "named-entity layer: off (no weights)"]
    parts = files.report(found, totals, files.texts(spark, str(tmp_path))[0]).collect()
    by_path = {r["path"]: json.loads(r["report"]) for r in parts}
    assert by_path[None]["summary"] == {"files_scanned": 1, "files_skipped": 1, "files_unreadable": 0, "ner": False, "ner_off_reason": "no weights", "total_findings": 2, "by_type": {"EMAIL": 1, "IBAN": 1}}
    (own,) = (v for k, v in by_path.items() if k)
    assert [(f["type"], f["start"], f["masked_value"]) for f in own["findings"]] == [("EMAIL", 5, "…"), ("IBAN", 19, "DE89…00")]


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_each_entry_is_listed_once(spark, tmp_path, levels):
    want = set()
    for n in range(60):
        folder = tmp_path.joinpath(*(f"d{n % k}" for k in range(2, 2 + n % 5)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n}.txt").write_text(str(n))
        want.add(str(folder / f"{n}.txt"))
    odd = os.fsencode(str(tmp_path)) + b"/odd\xff.txt"
    with open(odd, "wb") as f:
        f.write(b"odd")
    (tmp_path / "empty").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path)
    got = directory.entries(spark, str(tmp_path), levels)
    assert sorted(r["path"] for r in got.where("kind = 'file'").collect()) == sorted([*want, f"{tmp_path}/odd\ufffd.txt"]) and got.where("kind <> 'file'").count() == 1
    assert {(r["path"], r["text"]) for r in directory.contents(got).where("text is not null").collect()} == {(p, p.rpartition("/")[2][:-4]) for p in want} | {(f"{tmp_path}/odd\ufffd.txt", "odd")}


def test_unreadable_entries_are_rows(tmp_path, monkeypatch):
    for d in ("a/b/c", "shut/x"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("a/b/c/1", "a/2", "shut/x/3"):
        (tmp_path / f).write_text("x")
    scandir, access = os.scandir, os.access

    def refusing(path):
        if path.endswith(b"/shut"):
            raise PermissionError
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refusing)
    monkeypatch.setattr(os, "access", lambda p, mode: not p.endswith(b"/2") and access(p, mode))
    root = os.fsencode(str(tmp_path))
    for levels in (1, 2, 9):
        for tasks in (1, 3):
            rows = [r for i in range(tasks) for r in directory.Reader(str(tmp_path), tasks, levels).read(directory.InputPartition(i))]
            got = sorted((x["raw"].removeprefix(root + b"/"), x["kind"]) for b in rows for x in b.to_pylist())
            assert got == [(b"a/2", "unreadable"), (b"a/b/c/1", "file"), (b"shut", "unreadable")]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.txt").write_text("mail a@x.com")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert main(["scan", str(tmp_path), "--json", "--show-values"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["files"][0]["findings"][0]["value"] == "a@x.com" and out["summary"]["total_findings"] == 1
    assert main(["scan", str(tmp_path), "--no-ner"]) == 0 and "off (disabled)" in capsys.readouterr().out
    assert main(["scan", str(tmp_path), "--ner"]) == 2 and main(["scan", str(tmp_path / "none")]) == 2
    assert directory.display_path("a\udcff") == "a\ufffd"


def test_settings():
    got = settings.load('[sessions]\nmost_values = 5\n[stream]\nclient_format = "json5"')
    assert got["sessions"]["most_values"] == 5 and got["sessions"]["idle_seconds"] == 1800 and got["stream"]["client_format"] == "json5" and settings.load("")["tools"]["most_calls"] == 40
    for text, says in (("x", "not TOML"), ('[secret]\nkey = "hunter2"', "no section secret"), ('[sessions]\nkey = "hunter2"', "no setting sessions.key"), ('[sessions]\nmost_values = "hunter2"', "a whole number"), ("[sessions]\nmost_values = true", "a whole number"), ('[callers]\ncredentials_sha256 = ["hunter2"]', "digests"), ('sessions = "hunter2"', "no section")):
        with pytest.raises(settings.Wrong, match=says) as e:
            settings.load(text)
        assert "hunter2" not in str(e.value)


def test_generated_corpora(spark):
    rows = corpora.sentences(spark, 300, seed=7).collect()
    assert [tuple(r) for r in corpora.sentences(spark, 300, seed=7).repartition(3).orderBy("id").collect()] == [tuple(r) for r in sorted(rows, key=lambda r: r["id"])]
    find = detection.Finder()
    assert {e["entity_type"] for r in rows for e in r["entities"]} == set(corpora.MAKERS)
    for r in rows:
        spans = find(r["text"])
        for e in r["entities"]:
            value = r["text"][e["start"] : e["end"]]
            name = next((x.validator for x in find.rules if x.entity_type == e["entity_type"]), None)
            assert name is None or identifiers.VALIDATORS[name](value)
            assert any(s.start <= e["start"] and e["end"] <= s.end for s in spans)
    docs = corpora.documents(spark, 40, seed=7)
    leaks, refused = evaluation.document_leaks(docs)
    assert leaks.count() == 0 and refused.count() == 0
    hidden = spark.createDataFrame([("d", [("k", "see a@x.com and Ann", [("EMAIL", 4, 11), ("PERSON", 16, 19)])])], "id string, leaves array<struct<key:string,text:string,entities:array<struct<entity_type:string,start:int,end:int>>>>")
    leaks, _ = evaluation.document_leaks(hidden)
    assert [tuple(r) for r in leaks.collect()] == [("d", 0, 16, "PERSON", "Ann")] and evaluation.leak_figures(leaks).first().asDict() == {"occurrences": 1, "entities": 1}


def test_digests(tmp_path, monkeypatch):
    (tmp_path / "a").write_text("1")
    one = provenance.weights(tmp_path)
    (tmp_path / "b").write_text("2")
    assert provenance.weights(tmp_path) != one and len(one) == 64 and provenance.sources() == provenance.sources() != provenance.sources(tmp_path)
    monkeypatch.setenv(provenance.WEIGHTS_VARIABLE, str(tmp_path))
    assert provenance.weights_folder() == tmp_path and provenance.libraries(["pyspark"]) != provenance.libraries(["pyspark", "none-such"])
    monkeypatch.setenv(provenance.WEIGHTS_VARIABLE, str(tmp_path / "none"))
    assert provenance.weights_folder() is None
    assert catalogs.vocabulary_differences(["A", "B"], ["B", "C"]) == (["A"], ["C"])


@pytest.mark.parametrize("change", [{"validator": "odd"}, {"confidence": 0.9}, {"threshold": 2}, {"pattern": None}, {"tier": True}, {"boost": {"value": 2, "window": 1, "triggers": ["x"]}}, {"boost": {"value": 0.1, "window": 0, "triggers": ["x"]}}, {"boost": {"value": 0.1, "window": 1, "triggers": ["-"]}}, {"boost": {"value": 0.1, "window": 1, "triggers": []}}, {"boost": [1]}])
def test_catalog_entries_are_checked(change):
    with pytest.raises(ValueError, match="iban"):
        catalogs.rules([catalogs.IDENTIFIERS[0] | change])


def test_layers(spark):
    assert detection.layers(None, (False, "no weights")) == ("deterministic",) and detection.layers(None, (True, None)) == ("deterministic", "ner")
    for wrong in ([], ["ner"], ["deterministic", "deterministic"], ["deterministic", "odd"]):
        with pytest.raises(ValueError):
            detection.layers(wrong, (True, None))
    with pytest.raises(RuntimeError, match="no weights"):
        detection.layers(["deterministic", "ner"], (False, "no weights"))
    row = detection.answered(spark.createDataFrame([("a@x.com",)], "text string")).first()
    assert row["layers_run"] == ["deterministic"] and not row["complete"] and row["version"] == detection.version() and len(row["spans"]) == 1


def test_gates_hold_of_every_match():
    rng = random.Random(6)
    for kind, make in corpora.MAKERS.items():
        for _ in range(300):
            text = f"x {make(rng)} y"
            for rule in catalogs.built_in():
                assert not rule.pattern.search(text) or rule.gate.search(text), (kind, text)
            if any(s.entity_type == kind for s in detection.Finder()(text)):
                assert re.search(detection.PLAIN_CANDIDATE, text)


def test_corpus(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"1","lang":"fr","text":"x","entities":[{"entity_type":"EMAIL","start":0,"end":1}]}\n')
    assert [tuple(r) for r in files.gold(files.corpus(spark, str(tmp_path / "c.jsonl"))).collect()] == [("1", "fr", "EMAIL", 0, 1)]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_equal_sql(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert rows.count() >= 0
        return
    con = duckdb.connect()
    for t in ("customer", "documents", "pages", "events", "lineitem", "conversations", "orders", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in rows.collect())
    where = {c: i for i, c in enumerate(want.columns)}
    assert got == sorted(str(tuple(r[where[c]] for c in columns)) for r in want.fetchall())


def test_vocabulary_gaps(spark):
    used, declared = (spark.createDataFrame([(t,) for t in x], "entity_type string") for x in (["A", "B", "B", None], ["B", "C", None, None]))
    assert sorted(tuple(r) for r in catalogs.vocabulary_gaps(used, declared).collect()) == [("A", "undeclared"), ("C", "unused")]
    assert catalogs.vocabulary_gaps(used, used).count() == 0 == catalogs.vocabulary_gaps(used.limit(0), used.limit(0)).count()


def test_long_json_texts_are_given_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jsontext, "MOST_AT_ONCE", 50)
    rows = [(i, None if i % 7 == 3 else '{"a":"' + "x" * (i % 9 * 20) + '"}') for i in range(60)]
    got = jsontext.json_leaves(spark.createDataFrame(rows, "k int, body string").coalesce(1), "body", ["k"]).collect()
    assert [(r.k, len(r.leaves[0].value) if r.leaves else None) for r in got] == [(k, None if t is None else len(t) - 8) for k, t in rows]


def test_rows_are_dealt_by_their_work(spark):
    got = tables.spread(spark.range(100).coalesce(1), F.col("id"), 1000)
    assert got.rdd.getNumPartitions() == 5 and sorted(r.id for r in got.collect()) == list(range(100))


def test_large_streamed_work_is_dealt_to_fewer_tasks(spark):
    rows = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    got = [tables.spread(rows, F.lit(1), 1, streamed=most).rdd.getNumPartitions() for most in (1, 50, 10_000)]
    assert got == [1000, max(20, 4 * cores), 4 * cores]  # tasks grow, but not beyond their bound, nor below a few for each core
    assert tables.spread(rows, F.lit(1), 500, streamed=10_000).rdd.getNumPartitions() == 2  # few rows as before


def test_odd_json_makes_a_number_for_its_rows_only(spark, tmp_path):
    # no memory holds the number of a row that asks for none: 2 GB of digits
    spark.createDataFrame([(2_000_000_000,), (1,), (2,), (1_999_999_999,), (None,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    rows = {r["k"]: (r["error_class"], r["leaves"]) for r in catalog.odd_json(spark, str(tmp_path)).collect()}
    assert rows == {2_000_000_000: ("shape_request", ""), 1: (None, "7" * 5001), 2: (None, "\U0001f600/\\ud800"), 1_999_999_999: ("shape_request", ""), None: (None, "")}


def test_json_leaves_by_columns(spark):
    rows = [(0, '{"a":[1,"x",{"b":-0.50}],"c":""}'), (1, '{"a":"\\ud800"}'), (2, None), (3, "[true]"), (4, '"z"')]
    got = jsontext.json_leaves(spark.createDataFrame(rows, "k int, body string").coalesce(1), "body", ["k"]).collect()
    want = [[(0, "a", "number", "1"), (1, "a", "string", "x"), (2, "b", "number", "-0.50"), (3, "c", "string", "")], [], [], [], [(0, None, "string", "z")]]
    assert [([tuple(x) for x in r["leaves"]], r["error_class"]) for r in got] == [(w, "shape_request" if i == 1 else None) for i, w in enumerate(want)]
