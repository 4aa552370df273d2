"""Small fixtures and properties of the operators that need more than an SQL comparison."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import expressions as E
from lodestack.operators import attribution, content, feed, history, merge, tree, workspace


def values(df):
    return [tuple(r) for r in df.collect()]


def test_fixed_windows(spark):
    one = spark.range(1)
    assert one.select(content.windows(F.lit(10), 4, 1)).first()[0] == [0, 3, 6]
    assert one.select(content.windows(F.lit(0), 4, 1)).first()[0] == []
    assert one.select(content.windows(F.lit(3), 2, 9)).first()[0] == [0, 1]


def test_line_windows():
    assert content.line_cuts(b"", 2) == []
    assert content.line_cuts(b"\n", 2) == [(0, 1)]
    assert content.line_cuts(b"a\nb\nc", 2) == [(0, 4), (4, 5)]
    assert content.line_cuts(b"a\nb\nc\n", 2, 1) == [(0, 4), (2, 6)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.sampled_from([(64, 256, 1_024), (256, 1_024, 4_096)]))
def test_cdc_tiles(data, sizes):
    cuts = content.cdc_cuts(data, sizes)
    lengths = [b - a for a, b in zip([0, *cuts], cuts)]
    assert sum(lengths) == len(data) and all(0 < n <= sizes[2] for n in lengths) and all(n >= sizes[0] for n in lengths[:-1])


def test_cdc_is_stable_under_edits_and_fixed_is_not():
    body = "".join(f"line {i} of the file, {i * i}\n" for i in range(400)).encode()
    edited = b"new first line\n" + body

    def pieces(data, cuts):
        return {data[a:b] for a, b in zip([0, *cuts], cuts)}

    sizes = (64, 256, 1_024)
    kept = pieces(body, content.cdc_cuts(body, sizes)) & pieces(edited, content.cdc_cuts(edited, sizes))
    assert len(kept) > 0.8 * len(content.cdc_cuts(body, sizes))
    fixed = {body[i : i + 256] for i in range(0, len(body), 256)} & {edited[i : i + 256] for i in range(0, len(edited), 256)}
    assert len(fixed) <= 1


def test_empty_and_null_files_have_no_passages(spark):
    files = spark.createDataFrame([("/a", bytearray()), ("/b", None)], "path string, data binary")
    for strategy in ("whole", "fixed", "lines", "content_defined"):
        assert content.cut_passages(files, strategy, 256).count() == 0


def test_pack_round_trip(spark):
    entries = [("ab" * 32, 0, 5), ("cd" * 32, 5, 7)]
    packs = spark.createDataFrame([("p", bytearray(b"x" * 12 + content.pack_trailer(entries)))], "pack string, data binary")
    assert values(content.parse_trailers(packs)) == [("p", *e) for e in entries]


def test_packs_are_sealed_at_the_target(spark):
    chunks = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(10).cast("long").alias("len"))
    got = content.assign_packs(chunks, 50, 2)
    assert got.count() == 200
    assert got.groupBy("lane", "pack_no").agg(F.sum("len").alias("n")).where("n > 50").count() == 0


def test_custom_splitter_falls_back_to_the_cursor():
    assert content.custom_spans("abc def", ["abc", "zzz", "def"]) == [(0, 3), (3, 6), (6, 7)]


def test_reads(spark):
    body = bytes(random.Random(1).randbytes(5_000))
    files = spark.createDataFrame([("/x", bytearray(body))], "path string, data binary")
    cut = content.cut_passages(files, "content_defined", 256)
    manifests, chunks = content.build_manifests(cut), content.distinct_chunks(cut)
    assert bytes(content.read_files(manifests, chunks).first().data) == body
    wanted = spark.createDataFrame([("/x", 1, 1_000, 3_333)], "path string, request int, start long, end long")
    plan = content.range_plan(content.extents(manifests), wanted)
    assert bytes(content.read_ranges(plan, chunks).first().data) == body[1_000:3_333]
    assert b"".join(content.read_stream(plan, chunks)) == body[1_000:3_333]
    with pytest.raises(Exception, match="missing chunk"):
        content.read_ranges(plan, chunks.limit(0)).collect()


def test_corrupt_manifest_is_an_error(spark):
    bad = spark.sql("SELECT '/x' AS path, 'm' AS mhash, 5L AS size, array(named_struct('hash', 'h', 'len', 4L)) AS chunks")
    with pytest.raises(Exception, match="corrupt manifest"):
        content.check_manifests(bad).collect()


# attribution --------------------------------------------------------------------------------------------------------


def test_two_authors():
    first = attribution.attribute(b"", [], b"l1\nl2\nl3\nl4\n", (1, 0))
    assert first == [(1, 0, 12)]
    assert attribution.attribute(b"l1\nl2\nl3\nl4\n", first, b"l1\nnew\nl3\nl4\n", (2, 5)) == [(1, 0, 3), (2, 5, 4), (1, 0, 6)]


def test_moved_and_indented_lines_keep_their_author():
    old, runs = b"a\nb\nc\n", [(1, 0, 6)]
    assert attribution.attribute(old, runs, b"c\na\nb\n", (2, 0)) == [(1, 0, 6)]
    assert attribution.attribute(old, runs, b"a\n    b\nc\n", (2, 0)) == [(1, 0, 10)]


def test_unattributed_content_goes_to_the_writer():
    assert attribution.attribute(b"a\nb\n", [], b"a\nb\nc\n", (2, 0)) == [(2, 0, 6)]
    assert attribution.attribute(b"\xff", [(1, 0, 1)], b"\xff\xfe", (2, 0)) == [(2, 0, 2)]


def test_coalescing_drops_empty_runs(spark):
    runs = spark.createDataFrame([("/a", 0, 1, 0, 3), ("/a", 1, 2, 0, 0), ("/a", 2, 1, None, 4)], "path string, ordinal int, actor long, session long, len long")
    assert [tuple(r)[2:] for r in attribution.coalesce_runs(runs).collect()] == [(1, 0, 7)]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_common_lines_is_a_longest_common_subsequence(a, b):
    pairs = attribution.common_lines(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == lcs(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a\n", "b\n", " a\n", "c"]), max_size=9), st.lists(st.sampled_from(["a\n", "b\n", " a\n", "d"]), max_size=9))
def test_runs_always_cover_the_content(old, new):
    a, b = "".join(old).encode(), "".join(new).encode()
    first = attribution.attribute(b"", [], a, (1, 1))
    assert sum(r[2] for r in attribution.attribute(a, first, b, (2, 2))) == len(b)


def test_missing_actor_and_bad_lengths_are_errors(spark):
    spans = spark.createDataFrame([("/a", 9)], "path string, actor long")
    actors = spark.createDataFrame([(1, "human", "x")], "id long, kind string, display_name string")
    with pytest.raises(Exception, match="no actor 9"):
        attribution.with_actors(spans, actors).collect()
    blame = spark.sql("SELECT '/a' AS path, array(named_struct('actor', 1L, 'session', 0L, 'len', 4L)) AS runs")
    with pytest.raises(Exception, match="corrupt blame"):
        attribution.check_lengths(blame, spark.createDataFrame([("/a", 5)], "path string, size long")).collect()


# merge --------------------------------------------------------------------------------------------------------------


def test_text_merges():
    assert merge.merge_text("a\nb\nx\nc\n", "a\nB\nx\nc\n", "a\nb\nx\nC\n") == ("a\nB\nx\nC\n", False)
    text, conflict = merge.merge_text("a\nb\nc\n", "a\nX\nc\n", "a\nY\nc\n")
    assert conflict and "<<<<<<<" in text
    assert merge.merge_text("", "x\n", "x\n") == ("x\n", False)


def test_binary_merges_by_side(spark):
    rows = [("/1", b"\xff1", b"\xff1", b"\xff2"), ("/2", b"\xff1", b"\xff2", b"\xff1"), ("/3", b"\xff1", b"\xff2", b"\xff3")]
    got = merge.merge_files(spark.createDataFrame([(p, *map(bytearray, x)) for p, *x in rows], "path string, base binary, ours binary, theirs binary"))
    assert [(r.path, bytes(r.data), r.conflict, r.theirs and bytes(r.theirs)) for r in got.orderBy("path").collect()] == [
        ("/1", b"\xff2", False, None), ("/2", b"\xff2", False, None), ("/3", b"\xff2", True, b"\xff3"),
    ]


E1, E2, E3 = (0o644, "file", "h1"), (0o644, "file", "h2"), (0o644, "file", "h3")
D1, D2, D3, L1, L2 = (0, "dir", "d1"), (0, "dir", "d2"), (0, "dir", "d3"), (0, "symlink", "l1"), (0, "symlink", "l2")


@pytest.mark.parametrize(
    "b, o, t, action, entry, conflict",
    [
        (None, E1, None, "keep", E1, None), (E1, E1, None, "drop", None, None), (E2, E1, None, "keep", E1, "modify/delete"),
        (None, None, E1, "keep", E1, None), (E1, None, E1, "drop", None, None), (E2, None, E1, "keep", E1, "delete/modify"),
        (E2, E1, E1, "keep", E1, None), (E1, E1, E2, "keep", E2, None), (E1, E2, E1, "keep", E2, None), (E1, (0o755, "file", "h1"), E1, "keep", (0o755, "file", "h1"), None),
        (D1, D2, D3, "recurse", None, None), (E1, E2, E3, "merge_file", None, None), (None, L1, L2, "keep", L1, "symlink"), (E1, D1, L1, "keep", D1, "type"),
    ],
)
def test_merge_table(spark, b, o, t, action, entry, conflict):
    def level(e):
        return spark.createDataFrame([("/", "x", *e)] if e else [], "dir string, name string, mode int, kind string, hash string")

    (got,) = merge.merge_level(level(b), level(o), level(t)).collect()
    assert (got.action, got.conflict) == (action, conflict)
    if entry:
        assert tuple(got.entry) == entry


def test_deleted_directory_that_the_other_side_changed_is_one_conflict(spark):
    schema = "dir string, name string, mode int, kind string, hash string"
    base, ours = (spark.createDataFrame([("/", "d", 0, "dir", h)], schema) for h in ("t1", "t2"))
    entries = spark.createDataFrame([("t1", "a", 0, "file", "1"), ("t2", "a", 0, "file", "2")], "tree_hash string, name string, mode int, kind string, hash string")
    got = merge.merge_trees(base, ours, ours.limit(0), entries).collect()
    assert [(r.name, r.conflict) for r in got] == [("d", "modify/delete")]


def test_nested_merge_is_per_level(spark):
    schema = "dir string, name string, mode int, kind string, hash string"
    roots = [spark.createDataFrame([("/", "d", 0, "dir", h)], schema) for h in ("tb", "to", "tt")]
    rows = [(t, n, 0, "file", h) for t, n, h in [("tb", "a", "1"), ("tb", "b", "1"), ("to", "a", "2"), ("to", "b", "1"), ("tt", "a", "1"), ("tt", "b", "3")]]
    entries = spark.createDataFrame(rows, "tree_hash string, name string, mode int, kind string, hash string")
    got = merge.merge_trees(*roots, entries).where("dir = '/d'").orderBy("name").collect()
    assert [(r.name, r.action, r.entry.hash) for r in got] == [("a", "keep", "2"), ("b", "keep", "3")]


def test_hunks(spark):
    rows = spark.createDataFrame([("/a", "1\n2\n3\n4\n", "1\nx\n3\ny\n", [1])], "path string, old string, new string, keep array<int>")
    assert merge.apply_hunks(rows).first().text == "1\n2\n3\ny\n"


# history ------------------------------------------------------------------------------------------------------------


def graph(spark, edges):
    return spark.createDataFrame([(h, list(p)) for h, p in edges.items()], "hash string, parents array<string>")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_merge_base_of_a_criss_cross(spark):
    commits = graph(spark, {"r": "", "a": "r", "b": "r", "c": ["a", "b"], "d": ["b", "a"]})
    got = history.merge_base(commits, ids(spark, "c"), ids(spark, "d")).collect()
    assert [r.id for r in got] == ["a"]
    assert history.merge_base(graph(spark, {"x": "", "y": ""}), ids(spark, "x"), ids(spark, "y")).count() == 0


def test_merge_outcomes(spark):
    commits = graph(spark, {"r": "", "a": "r", "b": "r"})
    assert history.merge_outcome(commits, ids(spark, "a"), ids(spark, "r")) == "up_to_date"
    assert history.merge_outcome(commits, ids(spark, "r"), ids(spark, "a")) == "fast_forward"
    assert history.merge_outcome(commits, ids(spark, "a"), ids(spark, "b")) == "merge"


def test_missing_object_is_an_error_and_short_grace_is_refused(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    objects = spark.createDataFrame([("a", 1, 0)], "hash string, size long, mtime long")
    with pytest.raises(ValueError, match="missing"):
        history.mark(ids(spark, "a"), edges, objects)
    with pytest.raises(ValueError, match="refused"):
        history.sweep(objects, ids(spark, "a"), 100, 30)


def test_resync_outcomes(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a")], "src string, dst string")
    heads = spark.createDataFrame([("n", None, "a"), ("u", "a", "a"), ("f", "a", "b"), ("o", "b", "a"), ("d", "b", "c")], "branch string, local string, remote string")
    got = dict(values(history.resync_outcome(heads, edges)))
    assert got == {"n": "new", "u": "up_to_date", "f": "fast_forward", "o": "behind", "d": "diverged"}


def test_refs(spark):
    h = "a" * 64
    refs = spark.createDataFrame([("HEAD", "ref:main"), ("main", h), ("MERGE_HEAD", h), ("x", "ref:main")], "name string, value string")
    assert [r.name for r in history.branches(refs).collect()] == ["MERGE_HEAD", "main"]
    commits = graph(spark, {h: ""})
    assert [history.resolve_name(refs, commits, n).first().id for n in ("main", "HEAD", h)] == [h] * 3


def test_recovery_report(spark):
    rows = [("1", b"ORGC\x01x"), ("2", b"ORGC\x09x"), ("3", b"ORGT\x00"), ("4", b"data")]
    got = history.scan_report(spark.createDataFrame([(h, bytearray(b)) for h, b in rows], "hash string, bytes binary")).first()
    assert tuple(got) == (4, 1, 1, 1, ["commit", "tree"])


# namespace, feed, functions ------------------------------------------------------------------------------------------


def tree_of(spark, *paths):
    return spark.createDataFrame([(p, "dir" if p.endswith("/") else "file") for p in paths], "path string, kind string").withColumn("path", F.rtrim(F.col("path"), F.lit("/")))


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_namespace(spark):
    t = tree_of(spark, "/a/", "/a/x", "/b/", "/f")
    assert sorted(r.path for r in workspace.mkdir_missing(t, paths(spark, "/a/n/m", "/b")).collect()) == ["/a/n", "/a/n/m"]
    for bad, call in (("exists", lambda: workspace.mkdir(t, paths(spark, "/a"))), ("not a directory", lambda: workspace.mkdir_missing(t, paths(spark, "/f/x"))), ("not empty", lambda: workspace.rmdir(t, paths(spark, "/a"))), ("cannot", lambda: workspace.rename(t, "/a", "/a/y")), ("cannot", lambda: workspace.rename(t, "/f", "/a"))):
        with pytest.raises(Exception, match=bad):
            call().collect()
    assert sorted(r.path for r in workspace.rename(t, "/a", "/b").collect()) == ["/b", "/b/x", "/f"]
    assert sorted(r.path for r in workspace.rmdir(t, paths(spark, "/b")).collect()) == ["/a", "/a/x", "/f"]
    assert [r.path for r in workspace.removal_plan(t, "/a").orderBy("step").collect()] == ["/a/x", "/a"]
    assert sorted(r.path for r in workspace.copy_subtree(t, "/a", "/c").collect()) == ["/a", "/a/x", "/b", "/c", "/c/x", "/f"]


def test_unlink_keeps_hard_links(spark):
    d = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", 6)], "parent_ino long, name string, ino long")
    left, dead = workspace.unlink(d, spark.createDataFrame([(1, "a"), (1, "c")], "parent_ino long, name string"))
    assert [r.name for r in left.collect()] == ["b"] and [r.ino for r in dead.collect()] == [6]


def test_tree_round_trip(spark):
    files = spark.createDataFrame([("/a/b/c", 1, "file", "1"), ("/a/d", 1, "file", None), ("/e", 1, "file", "3")], "path string, mode long, kind string, hash string")
    built = tree.build_tree(files, "empty")
    (root,) = {r.tree_hash for r in built.where("path = ''").collect()}
    got = tree.flatten_tree(built, root)
    assert sorted(values(got.select("path", "hash"))) == [("/a/b/c", "1"), ("/a/d", "empty"), ("/e", "3")]


def test_feed_coalescing(spark):
    rows = [(1, "write", "/a", None), (2, "write", "/a", None), (3, "remove", "/a", None), (4, "rename", "/b", "/c"), (5, "write", "/c", None), (6, "commit", "/", None), (7, "rename", "/d", None)]
    f = spark.createDataFrame(rows, "seq long, kind string, path string, detail string")
    assert sorted((r.path, r.op, r.seq) for r in feed.coalesced(f).collect()) == [("/a", "delete", 3), ("/b", "delete", 4), ("/c", "upsert", 5), ("/d", "delete", 7)]
    tree_rows = paths(spark, "/c", "/z")
    assert sorted((r.path, r.seq) for r in feed.bootstrap(f, tree_rows, "snapshot").collect()) == [("/c", 7), ("/z", 7)]


def test_stale_proposals_treat_null_as_equal(spark):
    s = spark.createDataFrame([(1, "/n", None, "pending", "bytes"), (2, "/x", "h", "pending", "bytes"), (3, "/gone", "h", "pending", "bytes")], "id long, path string, base_hash string, status string, kind string")
    current = spark.createDataFrame([("/n", None), ("/x", "h")], "path string, content_hash string")
    assert [r.id for r in workspace.stale_suggestions(s, current).collect()] == [3]


def test_unknown_policy_is_restrictive(spark):
    got = spark.createDataFrame([(0,), (1,), (7,), (None,)], "p int").select(E.may_write(F.col("p")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False]


def test_expressions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(E.decode_runs(F.lit("1,0,5;bad;2,3,4"))) == [(1, 0, 5), (2, 3, 4)]
    assert value(E.encode_runs(E.decode_runs(F.lit("1,0,5;2,3,4")))) == "1,0,5;2,3,4"
    assert not value(E.runs_well_formed(F.lit("1,0,5;bad")))
    assert value(E.extension(F.lit("/a.b/c"))) == "" and value(E.extension(F.lit("/a/c.MD"))) == "md"
    assert value(E.document_extension(F.lit("/a.b/c"))) == "" and value(E.document_extension(F.lit("/a/.x"))) == "x"
    assert value(E.utf16_length(F.lit("a\U0001f600"))) == 3
    assert value(E.parent_path(F.lit("/a/b"))) == "/a" and value(E.parent_path(F.lit("/a"))) == "/"
    assert value(E.normal_dir(F.lit(" a/ "))) == "/a" and value(E.normal_dir(F.lit("/"))) == "/"
    assert value(E.lfs_oid(E.lfs_pointer(F.lit("a" * 64), F.lit(3)))) == "a" * 64
    assert value(E.lossy_text(F.unhex(F.lit("61FF62")))) == "a�b"
    assert value(E.is_hash(F.lit("A" * 64))) is False and value(E.is_hash(F.lit("a" * 64))) is True
    assert value(E.git_oid("blob", F.lit("hello\n").cast("binary"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert value(E.http_range(F.lit(None).cast("string"), F.lit(9))).status == "full"


@settings(max_examples=40, deadline=None)
@given(st.integers(-12, 12) | st.none(), st.integers(-12, 12) | st.none())
def test_slices_are_pythons(spark, a, b):
    data = bytes(range(9))
    low, high = E.slice_bounds(F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(9))
    x, y = spark.range(1).select(low, high).first()
    assert data[x:y] == data[a:b]


def test_splices(spark):
    data, new = F.lit(b"abcdef"), F.lit(b"XY")
    got = spark.range(1).select(E.splice(data, F.lit(1), new), E.splice(data, F.lit(5), new), E.splice(data, F.lit(8), new), E.truncated(data, F.lit(2)), E.truncated(data, F.lit(8))).first()
    assert [bytes(x) for x in got] == [b"aXYdef", b"abcdeXY", b"abcdef\0\0XY", b"ab", b"abcdef\0\0"]
