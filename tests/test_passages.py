"""Passages end to end, custom splitters, interval joins and proposals on small tables."""

import random

import pytest

from lodestack.operators import content, tree, workspace


def test_custom_parts_keep_the_splitters_text(spark):
    files = spark.createDataFrame([("/a.md", bytearray(b"one  two"))], "path string, data binary")
    got = content.split_custom(files, lambda text: ["one", "TWO"]).orderBy("ordinal").collect()
    assert [(r.byte_start, r.byte_end, bytes(r.bytes)) for r in got] == [(0, 3, b"one"), (3, 6, b"TWO")]


def test_converted_text_falls_back_to_fixed_windows(spark):
    body = bytes(random.Random(1).randrange(97, 123) for _ in range(5_000))
    rows = [("/a.md", body), ("/b.pdf", b"\xff\xfe"), ("/c.bin", b"\xff"), ("/d.bin", b"plain"), ("/e.md", b""), ("/f.md", None)]
    files = spark.createDataFrame([(p, None if d is None else bytearray(d)) for p, d in rows], "path string, data binary")
    got = content.extract_passages(files, "content_defined", 512, converter=lambda p, d, m: "x" * 1_100 if p.endswith("pdf") else None).collect()
    by = {p: sorted((r.byte_start, r.byte_end) for r in got if r.path == p) for p in {r.path for r in got}}
    assert set(by) == {"/a.md", "/b.pdf", "/d.bin"}  # /c.bin is not text; empty and null files have no passages
    assert by["/b.pdf"] == [(0, 512), (512, 1_024), (1_024, 1_100)]
    cuts = content.cdc_cuts(body, (128, 512, 2_048))
    assert by["/a.md"] == list(zip([0, *cuts], cuts))
    assert {r.converter is None for r in got if r.path == "/b.pdf"} == {False}


@pytest.mark.parametrize("width", [1, 7, 1_000])
def test_overlapping_equals_brute_force(spark, width):
    rng = random.Random(width)
    some = [[("p" + str(rng.randrange(2)), k, a := rng.randrange(60), a + rng.randrange(0, 30)) for k in range(40)] for _ in range(2)]
    left = spark.createDataFrame(some[0], "path string, i int, a0 long, a1 long")
    right = spark.createDataFrame(some[1], "path string, j int, b0 long, b1 long")
    got = sorted((r.i, r.j) for r in content.overlapping(left, right, "path", ("a0", "a1"), ("b0", "b1"), width).collect())
    assert got == sorted((i, j) for p, i, a0, a1 in some[0] for q, j, b0, b1 in some[1] if p == q and a0 < b1 and a1 > b0)


def test_proposals_and_their_differences(spark):
    current = spark.createDataFrame([("/a", "h1"), ("/b", None)], "path string, content_hash string")
    changes = spark.createDataFrame([(1, 7, "/a", bytearray(b"new\n")), (2, 7, "/c", bytearray(b"x")), (3, 7, "/b", None)], "id long, actor_id long, path string, data binary")
    own = workspace.propose(changes, current, 5)
    assert [(r.id, r.base_hash, r.kind, r.content_hash is None) for r in own.orderBy("id").collect()] == [(1, "h1", "bytes", False), (2, None, "bytes", False), (3, None, "delete", True)]
    assert [r.id for r in workspace.listed(own, "pending").collect()] == [3, 2, 1]
    with pytest.raises(Exception, match="not found"):
        workspace.propose(changes.where("id = 3").selectExpr("id", "actor_id", "'/z' AS path", "data"), current, 5).collect()
    content_of = own.where("id = 1").selectExpr("content_hash AS hash", "'new\n' AS text").union(spark.createDataFrame([("h1", "old\n")]))
    told = {r.path: r.diff for r in workspace.proposal_diff(own.where("id = 1"), content_of).collect()}
    assert told["/1"].endswith("-old\n+new\n")


def test_tally_counts_empty_directories(spark):
    paths = spark.createDataFrame([("/a", "dir", 0), ("/a/b", "dir", 0), ("/a/f", "file", 3), ("/a/b/g", "symlink", 4), ("/e", "dir", 0)], "path string, kind string, size long")
    assert sorted(map(tuple, tree.tally(paths).collect())) == [("/a", 2, 1, 7), ("/a/b", 1, 0, 4), ("/e", 0, 0, 0)]
