"""Framed reports, file sets, artifacts and the collector: round trips on small folders and hand-made streams."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import sinks
from factloom.sources import artifacts, universe
from factloom.streaming import collector

FINDING = "id string, file string, line int, classification string, confidence string, definition_id string, symbol_id string, logical_fingerprint string, physical_fingerprint string"


def findings(spark, n):
    rows = [(f"A#m{i}", f"f{i % 3}.rb", i % 7, ["unreachable", "unused"][i % 2], ["high", "low"][i % 2], f"d{i}", f"A#m{i}", f"l{i}", f"p{i}") for i in range(n)]
    return spark.createDataFrame(rows, FINDING).repartition(5)


@pytest.mark.parametrize("n", [0, 1, 200])
def test_sarif_is_one_ordered_document(spark, tmp_path, n):
    lost = spark.createDataFrame([("z.rb", 4, "cannot be read")], "file string, line int, message string")
    sinks.write_sarif(findings(spark, n), str(tmp_path / "s"), "tool", "degraded", lost)
    log = json.loads("\n".join(sinks.read_framed(spark, str(tmp_path / "s"))))
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and run["properties"] == {"analysisHealth": "degraded"}
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == (["unreachable", "unused"][: min(n, 2)]) + ["parse_incomplete"]
    places = [(x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], x["locations"][0]["physicalLocation"]["region"]["startLine"], x.get("properties", {}).get("definitionId")) for x in run["results"]]
    assert len(places) == n + 1 and places[-1] == ("z.rb", 4, None)
    want = sorted((r.file, r.line, r.id, r.definition_id) for r in findings(spark, n).collect())
    assert places[:-1] == [(f, line, d) for f, line, _, d in want]


def test_report_rows_in_order(spark, tmp_path):
    sinks.write_report(findings(spark, 50), str(tmp_path / "r"), {"root": "/app"})
    lines = sinks.read_framed(spark, str(tmp_path / "r"))
    told = json.loads("".join(lines))
    assert told["root"] == "/app" and len(told["findings"]) == 50
    keys = [(x["node"]["file"], x["node"]["line"], x["node"]["id"]) for x in told["findings"]]
    assert keys == sorted(keys)
    sinks.write_report(findings(spark, 0), str(tmp_path / "e"))
    assert json.loads("".join(sinks.read_framed(spark, str(tmp_path / "e")))) == {"findings": []}


def test_universe(spark):
    rows = [("lib/a.rb", False, None, None), ("spec/a_spec.rb", False, None, None), ("vendor/x.rb", False, None, None), ("lib/vendor/y.rb", False, None, None), ("bin/run", False, None, "#!/usr/bin/env ruby"), ("bin/sh", False, None, "#!/bin/sh"), ("link.rb", True, None, None), ("bad.rb", False, "EACCES", None), (".hid/z.rb", False, None, None), ("doc/readme.md", False, None, None), ("old/b.rb", False, None, None), ("lib/tasks/t.rake", False, None, None), ("lib/a.rb", False, None, None), (None, False, None, None)]
    files = spark.createDataFrame(rows, "path string, symlink boolean, error string, first_line string")
    got = {r.path: r for r in universe.universe(files, universe.Scopes(reference=("lib/**", "doc/**"), exclude=("old/**",))).collect()}
    assert set(got) == {"lib/a.rb", "spec/a_spec.rb", "bin/run", "bin/sh", "link.rb", "bad.rb", ".hid/z.rb", "doc/readme.md", "lib/tasks/t.rake"}
    assert {p for p, r in got.items() if r.analyzed} == {"lib/a.rb", "spec/a_spec.rb", "bin/run", "lib/tasks/t.rake"}
    assert got["doc/readme.md"].domain == "reference" and got[".hid/z.rb"].domain == "excluded" and got["spec/a_spec.rb"].test
    assert {p: r.issue for p, r in got.items() if r.issue} == {"link.rb": "symlink", "bad.rb": "inspection_error"}
    narrow = universe.universe(files, universe.Scopes(analyze=("lib/*.rb",), reference=("doc/**",)))
    told = universe.scope_diagnostics(narrow).first()
    assert (told.n_analyzed, told.n_referenced, told.n_outside, told.n_outside_runtime, told.n_entries_outside, told.n_issues_runtime) == (1, 2, 5, 4, 2, 2)
    assert told.samples == [".hid/z.rb", "bin/run", "lib/tasks/t.rake", "old/b.rb", "spec/a_spec.rb"]
    assert {(r.kind, r.n_files) for r in universe.scope_blockers(narrow).collect()} == {("reference_scope_incomplete", 4), ("source_discovery_incomplete", 2)}


def test_listing(spark, tmp_path):
    for p in ("lib/a.rb", "lib/deep/b c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * 5)
    assert sorted((r.path, r["size"]) for r in universe.listing(spark, str(tmp_path)).collect()) == [("lib/a.rb", 5), ("lib/deep/b c.txt", 5)]


def test_artifacts(spark, tmp_path):
    def put(name, value):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        (folder / "a.json").write_text(value if isinstance(value, str) else json.dumps(value))
        return str(folder)

    entry = {"fingerprint": "f", "definition_id": "d", "classification": "unused"}
    got = artifacts.read_artifact(spark, put("b2", {"schema_version": 2, "findings": [entry]}), "baseline").first()
    assert (got.schema_version, got.fingerprint, got.classification) == (2, "f", "unused")
    assert artifacts.read_artifact(spark, put("b1", {"findings": [entry, entry]}), "baseline").count() == 2
    assert artifacts.read_artifact(spark, put("g", {"labels": [{"corpus": "c", "id": "x", "label": "dead"}]}), "gold").first().label == "dead"
    assert artifacts.read_artifact(spark, put("t", {"tool": "q", "corpus": "c", "candidates": [{"id": "x", "line": 3}]}), "tool").first().line == 3
    assert artifacts.read_artifact(spark, put("r", {"nodes": ["a"], "edges": [{"caller_id": "a", "callee_id": "b"}], "observation": {"run_id": "1"}}), "trace").first().observation.run_id == "1"
    for name, value, why in [("v", {"schema_version": 2, "version": 1, "findings": [entry]}, "version"), ("w", {"schema_version": "x", "findings": [entry]}, "version"), ("n", {"schema_version": 9, "findings": [entry]}, "version"), ("o", "[1]", "no JSON object"), ("j", "{broken", "no JSON object"), ("m", {"findings": {}}, "no array")]:
        with pytest.raises(Exception, match=why):
            artifacts.read_artifact(spark, put(name, value), "baseline").collect()
    with pytest.raises(Exception, match="more than 10 bytes"):
        artifacts.read_artifact(spark, put("b1", {"findings": [entry]}), "baseline", max_bytes=10).collect()


EVENT = "run string, thread string, seq long, event string, symbol_id string, file string, line int"


def test_collector(spark, tmp_path):
    """Two runs over a restart: open calls outlive it, a batch written twice counts once, budgets drop and samples leave out."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    first = [("r1", "t", 1, "call", "A#a", "/app/a.rb", 1), ("r1", "t", 3, "call", "A#c", "/app/a.rb", 3), ("r1", "t", 2, "call", "A#b", "/app/a.rb", 2), ("r2", "t", 1, "call", "B#b", "/app/b.rb", 1), ("r1", "t", 4, "call", "Out#x", "/gem/x.rb", 1)]
    late = [("r1", "t", 5, "return", "A#b", "/app/a.rb", 2), ("r1", "t", 6, "call", "A#d", "/app/a.rb", 4), ("r2", "t", 2, "return", "never", "/app/b.rb", 1), ("r2", "t", 3, "call", "B#c", "/app/b.rb", 2), ("r2", "t", 4, "call", "B#d", "/app/b.rb", 2), ("r2", "t", 5, "call", "B#e", "/app/b.rb", 2)]
    taken = []

    def once(rows, k):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip([c.split()[0] for c in EVENT.split(", ")], r))) for r in rows))
        stream = spark.readStream.schema(EVENT).json(str(source))
        seen = collector.observations(stream, depth=3, root="/app")

        def sink(batch, batch_id):
            staged = f"{tmp_path}/staged-{batch_id}"
            batch.write.parquet(staged)
            for _ in range(2):  # as after a failure between the write and its record
                collector.take_batch(out)(spark.read.parquet(staged), batch_id)
            taken.append(batch_id)

        q = seen.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    once(first, 0)
    once(late, 1)
    assert taken == [0, 1]
    got = {(r.run, r.kind, r.caller, r.callee): r.n for r in collector.collected(spark, out).collect()}
    nodes = {("r1", "node", None, f"A#{x}"): 1 for x in "abcd"} | {("r2", "node", None, f"B#{x}"): 1 for x in "bcd"}
    edges = {("r1", "edge", "A#a", "A#b"): 1, ("r1", "edge", "A#b", "A#c"): 1, ("r1", "edge", "A#a", "A#d"): 1, ("r2", "edge", "B#b", "B#c"): 1, ("r2", "edge", "B#c", "B#d"): 1}
    assert got == nodes | edges | {("r2", "dropped", None, None): 1}


def test_samples(spark):
    rows = spark.range(4000).select(F.lit("r").alias("run"), F.lit("t").alias("thread"), F.col("id").alias("seq"))
    share = lambda rate: rows.filter(collector.sampled(rate)).count() / 4000
    assert share(1.0) == 1.0 and share(0.0) == 0.0 and abs(share(0.25) - 0.25) < 0.04
