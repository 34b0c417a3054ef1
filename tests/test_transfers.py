"""Pointers, rebuild plans, downloads, requests and snapshots."""

import os
import random

import pytest

from strandmill.operators import artifacts, network, pointers, segments
from strandmill.sources import snapshots


def walk(links, node):
    seen, at = [], node
    while at is not None and at not in seen:
        seen.append(at)
        at = links.get(at)
    return (seen[-1], len(seen) - 1, False) if at is None else (None, None, at == node or node in seen[seen.index(at):])


@pytest.mark.parametrize("kind", ["random", "chain", "cycle", "star", "empty"])
def test_pointers(spark, kind):
    rng = random.Random(2)
    links = {
        "random": {i: rng.randrange(400) if rng.random() < 0.97 else None for i in range(300)}, "chain": {i: i + 1 for i in range(1_000)},
        "cycle": {i: (i + 1) % 37 for i in range(37)} | {100: 3, 101: 100, 200: 200}, "star": {i: 0 if i else None for i in range(500)}, "empty": {},
    }[kind]
    df = spark.createDataFrame(list(links.items()), "node long, next long")
    got = {r.node: (r.end, r.steps, r.on_cycle) for r in pointers.resolve(df).collect()}
    every = set(links) | {x for x in links.values() if x is not None}
    assert got == {n: walk(links, n) for n in every}
    start = [7, 101] if kind != "empty" else [5]
    reach = set()
    for at in start:
        while at is not None and at not in reach:
            reach.add(at)
            at = links.get(at)
    assert {r.node for r in pointers.reached(spark.createDataFrame([(s,) for s in start], "node long"), df).collect()} == reach


def test_plan_and_closure(spark):
    entries = spark.createDataFrame(
        [("base", "manifest"), ("base", "recipe"), ("one", "recipe"), ("one", "delta"), ("two", "delta"), ("lost", "recipe"), ("x", "delta"), ("y", "recipe"),
         ("z", "delta"), ("lone", "delta"), ("junk", "other")], "assembly string, kind string")
    needs = spark.createDataFrame([("one", "base"), ("two", "one"), ("lost", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("base", "two")], "assembly string, reference string")
    got = {r.assembly: (r.kind, r.base, r.level, r.state) for r in artifacts.rebuild_plan(entries, needs).collect()}
    assert got == {
        "base": ("manifest", "base", 0, "ready"), "one": ("recipe", "base", 1, "ready"), "two": ("delta", "base", 2, "ready"), "lost": ("recipe", "gone", 1, "missing"),
        "x": ("delta", None, None, "cycle"), "y": ("recipe", None, None, "cycle"), "z": ("delta", None, None, "behind_cycle"), "lone": ("delta", "lone", 0, "missing")}
    served = {r.assembly: r.delta for r in artifacts.serves_delta(entries).collect()}
    assert served["base"] and served["two"] and not served["junk"]
    contents = spark.createDataFrame([("base", "h1", 5), ("base", "h2", 6), ("one", "h3", 1), ("one", "h1", 5), ("two", "h4", 2), ("x", "h9", 1)], "assembly string, hash string, length long")
    held = spark.createDataFrame([("h2",), ("h2",)], "hash string")
    wanted = spark.createDataFrame([("two",), ("two",)], "assembly string")
    found = {(r.hash, r.state) for r in artifacts.download_closure(wanted, entries, needs, contents, held).collect()}
    assert found == {("h1", "missing"), ("h2", "have"), ("h3", "missing"), ("h4", "missing")}


def test_chromosomes_and_requests(spark):
    m = spark.createDataFrame([("g", "c1", "sha256:a", 1), ("g", "c1", "sha256:a", 1), ("g", "c2", "sha256:b", 2), ("h", "c1", "sha256:b", 2)],
                              "assembly string, chrom string, hash string, length long")
    names = spark.createDataFrame([("g", "c1"), ("g", "c9")], "assembly string, chrom string")
    assert [tuple(r) for r in segments.chromosome_hashes(m, names).collect()] == [("g", "sha256:a", 1)]
    assert segments.chromosome_hashes(m).count() == 3 and segments.only_chromosome(m, "c1").count() == 3
    refs = segments.references(m)
    left = segments.drop_reference(refs, spark.createDataFrame([("sha256:b", "g"), ("none", "g")], "hash string, assembly string"))
    assert {(r.hash, r.assembly) for r in left.collect()} == {("sha256:a", "g"), ("sha256:b", "h")}
    paths = ["/segments/sha256:b", "/segments/b", "/segments/zz", "/segments/", "/deltas/D", "/genomes/G/manifest", "/other", None]
    got = {r.path: r.assembly for r in network.attribute_requests(spark.createDataFrame([(p,) for p in paths], "path string"), refs).collect()}
    assert got == dict(zip(paths, ["g", "g", None, None, "D", "G", None, None], strict=True))
    nodes = spark.createDataFrame([(1,), (2,)], "node int")
    announced = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "node int, hash string")
    assert {r.node: r.held for r in network.node_views(nodes, announced).collect()} == {1: 2, 2: 0}


GENOMES = "assembly string, organism string, chrom_idx long, chrom string, seq string"


def test_snapshots(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    root, shared = f"file://{tmp_path}/s", text(4_000)
    first = [("a", "o", 0, "1", shared + text(500)), ("a", "o", 1, "2", ""), ("b", "o", 0, "1", shared)]
    put = lambda rows: snapshots.import_genomes(spark, root, spark.createDataFrame(rows, GENOMES), (64, 512))
    assert snapshots.read(spark, root).number == 0 and snapshots.read(spark, root).manifest().count() == 0
    one = put(first)
    assert one.number == 1
    whole = one.manifest().join(one.store().select("hash", "data"), "hash").collect()
    for assembly, _, idx, _, seq in first:
        parts = sorted((r.seg_idx, bytes(r.data)) for r in whole if (r.assembly, r.chrom_idx) == (assembly, idx))
        assert b"".join(p for _, p in parts).decode() == seq
    assert one.store().count() == one.store().select("hash").distinct().count() == one.index().select("hash").distinct().count()
    stored = one.store().count()
    # Again: nothing is added, not even a commit.
    assert put(first).number == 1 and len(os.listdir(tmp_path / "s" / "data")) == 1
    # Another text for one genome replaces its manifest and adds its new segments only.
    two = put([("b", "o", 0, "1", shared + "ACGT" * 100)])
    assert two.number == 2 and 0 < two.store().count() - stored < 10
    assert {(r.assembly, r.snapshot) for r in two.manifest().select("assembly", "snapshot").distinct().collect()} == {("a", 1), ("b", 2)}
    assert {r.assembly for r in two.sketches().collect()} == {"a", "b"} and two.log().count() == 3
    # The old view stays readable, and files without a commit or with half of one are not seen.
    assert snapshots.read(spark, root, 1).manifest().where("assembly = 'b' AND snapshot = 2").count() == 0
    os.makedirs(tmp_path / "s" / "data" / "dead" / "store")
    (tmp_path / "s" / "commits" / f"{3:020d}.json").write_text('{"number": 3, "fol')
    assert snapshots.read(spark, root).number == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, 2, "other")
    with pytest.raises(ValueError):
        snapshots.read(spark, root, 9)
