"""Trees that are written, walked and removed one after another."""

import os

import pytest

from sourceassay.plans import queries
from sourceassay.sources import scan


def test_trees_stay_within_their_disk(spark, monkeypatch):
    rows = [(f"p{i % 2}", f"{'node_modules' if i % 7 == 0 else 'src'}/F{i}.js", bytearray(b"x" * i), i % 5 == 0) for i in range(60)]
    files = spark.createDataFrame(rows, "project string, path string, raw binary, is_symlink boolean")
    most, write = [], queries._write_tree

    def watched(own, base):
        write(own, base)
        parent = os.path.dirname(base)
        most.append(sum(len(names) for d in os.listdir(parent) if d.isdigit() for _, _, names in os.walk(os.path.join(parent, d))))
    monkeypatch.setattr(queries, "_write_tree", watched)
    found = queries.scan_in_trees(files, "unused", tree_bytes=200_000).collect()
    assert sorted(map(tuple, found)) == sorted(
        (p, path, None if link else len(raw), link) for p, path, raw, link in rows if path.startswith("src"))
    assert len(most) > 2 and max(most) < 40 and sum(most) == 60


def test_directories_are_listed_once(spark, tmp_path):
    """A checkpoint walks every directory twice, and a piece for every directory given is one more data frame."""
    listed, pieces = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    roots = [(f"p{i}", str(tmp_path / f"p{i}")) for i in range(40)]
    for name, root in roots:
        os.makedirs(f"{root}/src")
        open(f"{root}/src/{name}.js", "w").close()
    build = scan._lister

    def counted(skip, budget):
        run = build(skip, budget)

        def counting(batches):
            for piece in run(batches):
                listed.add(len(piece))
                pieces.add(1)
                yield piece
        return counting
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(scan, "_lister", counted)
        found = scan.list_corpus(spark.createDataFrame(roots, "project string, root string"))
    assert sorted((r.project, r.path, r.kind) for r in found.collect()) == sorted((name, f"src/{name}.js", "file") for name, _ in roots)
    assert listed.value == 40
    assert pieces.value <= spark.sparkContext.defaultParallelism
