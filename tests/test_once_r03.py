"""Work that is done once a row, and short ways that agree with the long ones."""

from pyspark.sql import functions as F

from sourceassay.operators import json_contracts, snapshots, structure


def test_a_snapshot_computes_the_index_once(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def hashed(path):
        passes.add(1)
        return path
    index = spark.range(40, numPartitions=2).select(
        F.lit("p").alias("project"), F.lit("i").alias("project_identifier"), F.concat(F.lit("f"), "id").alias("path_relative"))
    snapshots.write_snapshot(index.withColumn("hash", hashed("path_relative")), str(tmp_path / "s"), "2024-05-01")
    assert passes.value == 40
    assert snapshots.read_snapshot(spark, str(tmp_path / "s")).count() == 40


def test_members_of_a_document_come_of_one_parse(spark):
    payloads = spark.createDataFrame([
        ("a", '{"findings": [{"id": "x", "n": [1]}, 4, {}], "request_metadata": {"user_id": null}, "more": 1.5}'),
        ("b", '{"findings": {"id": 1}}'), ("c", "no json"), ("d", "[1]"), ("e", None)], "project string, body string")
    found = json_contracts.keys(payloads, "B")
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    rows = [(r.project, r.idx, r.path, r.value) for r in found.withColumn("value", F.to_json("value")).collect()]
    assert sorted(rows, key=str) == sorted([
        ("a", None, "findings", '[{"id":"x","n":[1]},4,{}]'), ("a", None, "request_metadata", '{"user_id":null}'), ("a", None, "more", "1.5"),
        ("a", None, "request_metadata.user_id", "null"), ("a", 0, "findings.id", '"x"'), ("a", 0, "findings.n", "[1]"),
        ("b", None, "findings", '{"id":1}')], key=str)


def test_short_files_are_read_like_long_ones(code, monkeypatch):
    deep = "".join(f"function f{i}() {{\nif (a{i}) {{\nx = {i};\n" for i in range(9)) + "y = 1;\n" + "}\n}\n" * 9
    texts = {"deep.js": deep, "flat.js": "function f() {\nx = 1;\n}\n" * 30, "odd.js": "}\n}\nif (a) {\nb = 1;\n",
             "b.py": "def f():\n    if x:\n        y = 1\n    z = 2\ndef g():\n    return 1\n", "none.js": "x = 1;\n", "empty.js": ""}

    def read():
        return sorted(map(str, structure.statements(code(texts), scoped=True).collect()))
    short = read()
    monkeypatch.setattr(structure, "_FEW", -1)
    monkeypatch.setattr(structure, "_CHUNK", 1)
    assert short == read() and len(short) > 100
