"""Dependencies against the small programs of the reference's tests and against step-by-step simulation."""

import random

import pytest

from taskloom.operators import deps

LOG = "handle long, seq long, mode int, concurrency string"


def simulate(log):
    """Edges of one location: [(seq, mode)] in order."""
    last, reads, out = None, [], set()
    for seq, mode in log:
        if mode & 2:
            out |= {(r, seq, "WAR") for r in reads}
            if not reads and last is not None:
                out.add((last, seq, "WAW"))
            last, reads = seq, []
        else:
            if last is not None:
                out.add((last, seq, "RAW"))
            reads.append(seq)
    return out


def edges(df):
    return {(r.pred, r.succ, r.kind) for r in df.collect()}


def handle_log(spark, modes, concurrency="SEQUENTIAL"):
    return spark.createDataFrame([(0, i, m, concurrency) for i, m in enumerate(modes)], LOG)


@pytest.mark.parametrize(
    ("modes", "expected"),
    [
        ([2, 1, 3], {(0, 1, "RAW"), (1, 2, "WAR")}),
        ([2, 1, 2, 3], {(0, 1, "RAW"), (1, 2, "WAR"), (2, 3, "WAW")}),
        ([2] + [1] * 16, {(0, i, "RAW") for i in range(1, 17)}),
        ([3] * 32 + [1], {(i, i + 1, "WAW") for i in range(31)} | {(31, 32, "RAW")}),
        ([], set()),
        ([1], set()),
    ],
)
def test_handle_programs(spark, modes, expected):
    assert edges(deps.handle_edges(handle_log(spark, modes), ["handle"])) == expected


def test_commutative_writers_are_in_order(spark):
    log = handle_log(spark, [2] * 64, "COMMUTATIVE")
    assert edges(deps.concurrent_edges(log, ["handle"])) == {(i, i + 1, "WAW") for i in range(63)}


def test_concurrent_writers_and_a_reader(spark):
    log = handle_log(spark, [2] * 64, "CONCURRENT").union(handle_log(spark, [1]).selectExpr("handle", "64L", "mode", "concurrency"))
    got = deps.empty_node_edges(log, ["handle"]).collect()
    assert len(got) == 65
    assert {(r.pred, r.succ) for r in got} == {(i, -65) for i in range(64)} | {(-65, 64)}


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_random_handles(spark, block):
    rng = random.Random(block)
    rows = [(rng.randrange(3), i, rng.choice([1, 1, 1, 2, 3]), "SEQUENTIAL") for i in range(300)]
    log = spark.createDataFrame(rows, LOG)
    got = deps.epochs(log, ["handle"], block).collect()
    for r in got:
        before = [x for x in rows if x[0] == r.handle and x[1] < r.seq and x[2] & 2]
        assert r.ep == len(before)
        assert r.lw == (before[-1][1] if before else None)
    expected = set()
    for h in range(3):
        expected |= simulate([(s, m) for hh, s, m, _ in rows if hh == h])
    assert edges(deps.handle_edges(log, ["handle"])) == expected


def test_segments_of_the_reference_program(spark):
    log = spark.createDataFrame([(0, 0, 2, 0, 32), (0, 1, 1, 16, 35), (0, 2, 3, 13, 28)], "domain_id long, seq long, mode int, a long, b long")
    got = {(r.pred, r.succ) for r in deps.segment_edges(log, ["domain_id"]).collect()}
    assert got == {(0, 1), (1, 2), (0, 2)}


def test_random_segments_and_rects(spark):
    rng = random.Random(5)
    segs = [(0, i, rng.choice([1, 1, 2]), a := rng.randrange(40), a + rng.randrange(1, 12)) for i in range(60)]
    expected = set()
    for cell in range(60):
        expected |= simulate([(s, m) for _, s, m, a, b in segs if a <= cell < b])
    assert edges(deps.segment_edges(spark.createDataFrame(segs, "domain_id long, seq long, mode int, a long, b long"), ["domain_id"])) == expected
    rects = [(0, i, rng.choice([1, 1, 2]), x := rng.randrange(8), x + rng.randrange(1, 5), y := rng.randrange(8), y + rng.randrange(1, 5)) for i in range(40)]
    expected = set()
    for cx in range(14):
        for cy in range(14):
            expected |= simulate([(s, m) for _, s, m, x0, x1, y0, y1 in rects if x0 <= cx < x1 and y0 <= cy < y1])
    log = spark.createDataFrame(rects, "domain_id long, seq long, mode int, x0 long, x1 long, y0 long, y1 long")
    assert edges(deps.rect_edges(log, ["domain_id"])) == expected


def test_virtual_reads_leave_no_trace_in_matrices(spark):
    cols = "domain_id long, seq long, mode int, x0 long, x1 long, y0 long, y1 long"
    log = spark.createDataFrame([(0, 0, 2, 0, 4, 0, 4), (0, 1, 5, 0, 4, 0, 4), (0, 2, 2, 0, 4, 0, 4)], cols)
    assert edges(deps.rect_edges(log, ["domain_id"])) == {(0, 1, "RAW"), (0, 2, "WAW")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [1, 20, 1 << 15])
def test_rects_in_parts_and_cells_that_are_not_shuffled(spark, hot):
    rng = random.Random(hot)
    rects = [(d, i, rng.choice([1, 1, 2, 5]), x := rng.randrange(20), x + rng.randrange(0, 6), y := rng.randrange(20), y + rng.randrange(1, 6)) for i in range(60) for d in (0, 1)]
    expected = set()
    for d, cx, cy in ((d, cx, cy) for d in (0, 1) for cx in range(26) for cy in range(26)):
        here = [(s, m) for dd, s, m, x0, x1, y0, y1 in rects if dd == d and x0 <= cx < x1 and y0 <= cy < y1]
        expected |= {(d, *e) for e in simulate([(s, m) for s, m in here if m != 5])}
        for s, m in here:
            before = [t for t, n in here if n == 2 and t < s]
            expected |= {(d, before[-1], s, "RAW")} if m == 5 and before else set()
    got = deps.rect_edges(spark.createDataFrame(rects, "domain_id long, seq long, mode int, x0 long, x1 long, y0 long, y1 long"), ["domain_id"], hot=hot)
    assert {(r.domain_id, r.pred, r.succ, r.kind) for r in got.collect()} == expected
    assert "SortMergeJoin" not in plan(got)


def test_tiles_and_segments_of_one_matrix_take_one_shuffle_of_the_log(spark):
    import __spark_entry__ as entry

    p = plan(entry.queries()["dep_cross"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" not in p
    # the log by part, a count and the bounds of large domains, the distinct edges
    assert 1 <= p.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 5


def test_tiles_of_a_matrix_take_one_shuffle_of_the_log(spark):
    import __spark_entry__ as entry

    p = plan(entry.queries()["dep_matrix"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" not in p
    assert 1 <= p.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 5


@pytest.mark.parametrize("hot", [1, 1 << 15])
def test_segments_in_parts(spark, hot):
    rng = random.Random(hot)
    segs = [(0, i, rng.choice([1, 1, 2]), a := rng.randrange(90), a + rng.randrange(0, 25)) for i in range(80)]
    log = spark.createDataFrame(segs, "domain_id long, seq long, mode int, a long, b long")
    cuts = sorted({c for s in segs for c in s[3:] if s[3] < s[4]})
    cells = [simulate([(s, m) for _, s, m, a, b in segs if a <= c < b]) for c in cuts]
    expected = set().union(*cells)
    got = deps.segment_edges(log, ["domain_id"], hot=hot)
    assert edges(got) == expected
    assert "SortMergeJoin" not in plan(got)
    found = {(r.reader, r.writer) for r in deps.conflicting_writers(log, ["domain_id"], hot=hot).collect()}
    assert found == {(s, p) for p, s, k in expected if k == "RAW"}
    counted = deps.dedupe(deps.cell_edges(deps.cells(log, ["domain_id"], [("a", "b")], hot), ["domain_id"]), ["domain_id"]).collect()
    assert [(r.set_edges, r.skipped) for r in counted] == [(len({e[:2] for e in expected}), sum(map(len, cells)) - len({e[:2] for e in expected}))]


def test_dedupe_counts_edges_where_the_log_is(spark):
    import __spark_entry__ as entry

    assert "SortMergeJoin" not in plan(entry.queries()["dep_dedupe"](spark, "/root/testdata/sf0.001"))


def test_segments_take_one_shuffle_of_the_log(spark):
    import __spark_entry__ as entry

    assert "SortMergeJoin" not in plan(entry.queries()["dep_segment"](spark, "/root/testdata/sf0.001"))
