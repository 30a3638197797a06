"""Interval sets, rectangles, placement, graphs and scalars against brute force and small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from taskloom.functions import scalar, trace
from taskloom.operators import coherence, deps, graph, intervals, kernels, placement, rects
from taskloom.operators.registry import Registry
from taskloom.sources import files, logs


def ivs(df):
    return sorted((r.a, r.b) for r in df.collect())


def test_fill_keeps_touching_apart(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 4, 8), (0, 8, 9), (0, 20, 20), (0, 12, 13)], "key long, a long, b long")
    assert ivs(intervals.fill(df, ["key"])) == [(0, 8), (8, 9), (12, 13)]


def test_unfill_and_gaps(spark):
    rng = random.Random(1)
    rows = [(0, a := rng.randrange(80), a + rng.randrange(1, 9)) for _ in range(12)]
    holes = [(0, a := rng.randrange(80), a + rng.randrange(1, 9)) for _ in range(8)]
    kind = "key long, a long, b long"
    left = {c for _, a, b in rows for c in range(a, b)} - {c for _, a, b in holes for c in range(a, b)}
    got = ivs(intervals.unfill(spark.createDataFrame(rows, kind), spark.createDataFrame(holes, kind), ["key"]))
    assert {c for a, b in got for c in range(a, b)} == left
    assert all(b not in left for _, b in got)
    got = ivs(intervals.gaps(spark.createDataFrame(rows, kind), ["key"], 10, 70))
    assert {c for a, b in got for c in range(a, b)} == set(range(10, 70)) - {c for _, a, b in rows for c in range(a, b)}


def test_overlap_counts_each_pair_once(spark):
    rng = random.Random(2)
    rows = [(0, i, a := rng.randrange(100), a + rng.randrange(0, 30)) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, id long, a long, b long")
    got = sorted((r.left_id, r.right_id) for r in intervals.overlap(df, df, ["key"], 7).collect())
    assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])


@pytest.mark.parametrize("most", [2, 1000])
def test_equal_rectangles_are_compared_once(spark, most):
    rng = random.Random(most)
    rows = [("p", i, x := rng.randrange(6), x + rng.randrange(0, 9), y := rng.randrange(6), y + 3) for i in range(120)]
    df = spark.createDataFrame(rows, "plane string, id long, x0 long, x1 long, y0 long, y1 long")
    got = rects.overlap(df, df, ["plane"], 4, 2, most=most).collect()
    full = [r for r in rows if r[2] < r[3]]
    assert sorted((r.l_id, r.r_id) for r in got) == sorted((a[1], b[1]) for a in full for b in full if a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5])
    assert all((r.l_x0, r.l_x1, r.r_y0) == (rows[r.l_id][2], rows[r.l_id][3], rows[r.r_id][4]) for r in got)


def test_tiles_cover_the_union(spark):
    tiles = [(0, i * s, i * s + s, j * s, j * s + s) for s, k in ((15, 4), (10, 6)) for i in range(k) for j in range(k)]
    got = rects.partite(spark.createDataFrame(tiles, "key long, x0 long, x1 long, y0 long, y1 long"), ["key"]).collect()
    cells = [(x, y) for r in got for x in range(r.x0, r.x1) for y in range(r.y0, r.y1)]
    assert len(cells) == len(set(cells)) == 3600


@pytest.mark.parametrize(("a", "b"), [(0, 100), (3, 9), (7, 8), (5, 21), (8, 16), (6, 17)])
def test_segment_rects(spark, a, b):
    got = rects.segment_rects(spark.createDataFrame([(a, b)], "a long, b long"), 8, 1).collect()
    cells = sorted(x + 8 * y for r in got for x in range(r.x0, r.x1) for y in range(r.y0, r.y1))
    assert cells == list(range(a, b))


def test_wrapped_tile_and_back(spark):
    tile = spark.createDataFrame([(0, 3, 8, 8, 8, 1), (1, 16, 8, 4, 2, 1)], "id long, addr long, ld long, m long, n long, sizeof long")
    r = rects.tile_rects(tile)
    cells = sorted(x + 8 * y for q in r.where("id = 0").collect() for x in range(q.x0, q.x1) for y in range(q.y0, q.y1))
    assert cells == list(range(3, 67))
    back = {(q.id, q.addr, q.m, q.n) for q in rects.rects_tile(r.where("id = 1"), ["id"], 8, 1).collect()}
    assert back == {(1, 16, 4, 2)}


@pytest.mark.parametrize(("low", "up", "incr"), [(0, 1000, 1), (10, 900, 3), (0, 2, 1), (0, 100, 1)])
@pytest.mark.parametrize("threads", [1, 7, 64])
def test_parallel_for_covers_each_index_once(spark, low, up, incr, threads):
    got = placement.parallel_for(spark, low, up, incr, threads).collect()
    assert len(got) == threads
    assert [low + i * incr for r in got for i in range(r.a, r.b)] == list(range(low, up + 1, incr))


def test_chunks_and_halves(spark):
    got = placement.chunks(spark, 0, 1 << 20, 8).collect()
    assert [(r.a, r.b) for r in got] == [(i << 17, (i + 1) << 17) for i in range(8)]
    assert placement.chunks(spark, 0, 0, 8).count() == 0
    leaves = ivs(placement.halves(spark.createDataFrame([(0, 4096)], "a long, b long"), 512))
    assert leaves == [(i * 512, i * 512 + 512) for i in range(8)]


def test_device_grids():
    assert [placement.grid(n) for n in (1, 2, 3, 4, 6, 8)] == [(1, 1), (2, 1), (1, 3), (2, 2), (3, 2), (2, 4)]


def test_graph_of_a_chain(spark):
    tasks = spark.createDataFrame([(i, 1) for i in range(8)], "task long, device int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "pred long, succ long")
    assert [r.task for r in graph.roots(tasks, edges).collect()] == [0]
    assert [r.task for r in graph.leaves(tasks, edges).collect()] == [7]
    assert {(r.task, r.level) for r in graph.levels(tasks, edges, 3).collect()} == {(i, i) for i in range(8)}
    assert {r.chain for r in graph.chains(tasks, edges).collect()} == {0}
    assert sorted((r.task, r.idx) for r in graph.reachable(tasks, edges).collect()) == [(i, i) for i in range(8)]


def test_levels_within_groups(spark):
    rng = random.Random(3)
    edges = [(g, f"{g}.{a}", f"{g}.{b}") for g in range(5) for a in range(40) for b in rng.sample(range(40), 3) if a < b]
    tasks = [(g, f"{g}.{a}") for g in range(5) for a in range(40)]
    level = {t: 0 for _, t in tasks}
    for g, a, b in sorted(edges, key=lambda e: int(e[1].split(".")[1])):
        level[b] = max(level[b], level[a] + 1)
    some = spark.createDataFrame(tasks, "key long, task string"), spark.createDataFrame(edges + edges[:9], "key long, pred string, succ string")
    got = graph.levels_within(*some, ["key"]).collect()
    assert {(r.key, r.task, r.level) for r in got} == {(int(t.split(".")[0]), t, n) for t, n in level.items()}
    assert len(got) == 200
    assert graph.levels_within(some[0].limit(0), some[1].limit(0), ["key"]).count() == 0


def test_replay_takes_no_round_for_a_level(spark):
    import __spark_entry__ as entry

    df = entry.queries()["cg_replay"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert df.where("level = 0").count() == 1


def test_fmt_units_ends_at_terabytes_as_its_sql(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(0, 128657), (1, 5)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.bytes, r.bandwidth) for r in entry.queries()["fmt_units"](spark, str(tmp_path)).collect()}
    assert got == {0: ("1936.87TB", "1936.87TB/s"), 1: ("125.00B", "125.00B/s")}


def test_task_group(spark):
    rows = [(0, None)] + [(i, 0) for i in range(1, 65)] + [(64 + i, i) for i in range(1, 65)]
    got = {r.task: (r.children, r.descendants) for r in graph.descendants(spark.createDataFrame(rows, "task long, parent long")).collect()}
    assert got[0] == (64, 128)
    assert got[1] == (1, 1)


def test_lowering_bridges_empty_tasks(spark):
    commands = spark.createDataFrame([(0, 1, 10, 1), (2, 0, 20, 1), (2, 0, 21, 2), (2, 1, 22, 2)], "task long, stage int, command long, device int")
    tasks = spark.createDataFrame([(i,) for i in range(3)], "task long")
    nodes, links = graph.lower(commands, tasks, spark.createDataFrame([(0, 1), (1, 2)], "pred long, succ long"))
    assert {(r.src, r.dst) for r in links.collect()} == {("entry", "c10"), ("c10", "b2.0"), ("b2.0", "c20"), ("b2.0", "c21"), ("c20", "e2.0"), ("c21", "e2.0"), ("e2.0", "c22"), ("c22", "exit")}
    assert nodes.count() == 8


def test_coherence_and_fetches(spark):
    log = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 2, 1), (0, 2, 2, 2), (0, 3, 1, 1), (0, 4, 1, 1), (0, 5, 3, 3)], "block long, seq long, device int, mode int")
    valid = {r.seq: r.valid for r in coherence.validity(log).collect()}
    assert valid == {0: [1], 1: [1, 2], 2: [2], 3: [1, 2], 4: [1, 2], 5: [3]}
    assert {r.seq: r.plan for r in coherence.fetch_plan(log).collect()} == {0: "H2D", 1: "D2D", 3: "D2D", 4: "HIT", 5: "D2D"}


def test_kernels(spark):
    grid = spark.createDataFrame([(i, j, float(i * i + j)) for i in range(5) for j in range(4)], "i long, j long, v double")
    got = {(r.i, r.j): r.v for r in kernels.stencil(grid, [], 1.0, 0.5, 1.0, 1.0).collect()}
    assert got[(0, 0)] == 0.0
    assert got[(2, 2)] == pytest.approx(6 + 0.5 * 2)
    assert [r.fib for r in kernels.fib(spark, 6).orderBy("n").collect()] == [1, 2, 3, 5, 8, 13]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("1024", (1024, "absolute", "ok")), ("50%", (50, "relative", "ok")), ("2GB", (2147483648, "absolute", "ok")), ("k", (0, "absolute", "ok")), (" 7 mb", (7 << 20, "absolute", "ok")), ("101%", (None, None, "range")), ("5X", (None, None, "format")), ("5KX", (None, None, "format")), ("", (None, None, "format")), ("99999999999T", (None, None, "overflow")), ("12.7%", (12, "relative", "ok")), (None, (None, None, "format"))],
)
def test_sizes(spark, text, expected):
    r = spark.createDataFrame([(text,)], "t string").select(scalar.parse_size(F.col("t")).alias("p")).first().p
    assert (None if r.amount is None else int(r.amount), r.unit, r.status) == expected


def test_log_to_gantt(spark, tmp_path):
    lines = [f"[{t}.0] [TID={i}] [debug] task `t{i}` of addr `0xA{i % 2}` is now in state `{s}`" for t, i, s in ((1, 0, "Executing"), (2, 2, "executing"), (3, 0, "completed"), (4, 1, "completed"), (5, 2, "completed"))]
    (tmp_path / "log").write_text("\n".join([*lines, "other"]))
    rows = logs.read(spark, str(tmp_path / "log"))
    assert rows.count() == 5
    got = trace.gantt(rows.withColumn("seq", F.col("time")))
    assert {(r.tid, r.start, r.end) for r in got.collect()} == {(0, 1.0, 3.0), (2, 2.0, 5.0)}
    logs.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("sep", ":").option("header", True).csv(str(tmp_path / "csv")).count() == 5


def test_file_round_trip(spark, tmp_path):
    data = bytes((7 * i + 3) % 256 for i in range(8192 + 5))
    (tmp_path / "f").write_bytes(data)
    got = files.read_chunks(spark, str(tmp_path / "f"), 16).orderBy("i").collect()
    assert len(got) == 16
    assert b"".join(bytes(r.bytes) for r in got) == data
    files.write(spark.range(100), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_chunks_of_files_that_are_more_than_a_row(spark, tmp_path):
    data = {name: random.Random(name).randbytes(size) for name, size in (("a b%20", 100_003), ("c", 5), ("d", 0))}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4096")
    try:
        got = files.read_chunks(spark, str(tmp_path), 16).orderBy("path", "i").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [r.i for r in got] == [*range(16), *range(5)]
    assert all(len(r.bytes) == r.b - r.a for r in got)
    for name, content in data.items():
        assert b"".join(bytes(r.bytes) for r in got if r.path.endswith("/" + name)) == content


def test_registry(spark):
    r = Registry()
    number = r.put("axpy")
    assert number == r.put("axpy") == 1
    r.set(number, lambda df: df.where("id > 1"))
    assert r.run(number, spark.range(4), target="cuda").count() == 2


def test_streamed_edges_equal_the_batch(spark, tmp_path):
    from taskloom.operators import deps
    from taskloom.streaming import incremental

    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.choice([1, 2])) for i in range(60)]
    kind = "handle long, seq long, mode int"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.handle_edges(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("edges").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {tuple(r) for r in spark.table("edges").collect()}
    expected = {(r.handle, r.pred, r.succ, r.kind) for r in deps.handle_edges(spark.createDataFrame(rows, kind), ["handle"]).collect()}
    assert got == expected


def test_units_as_c_writes_them(spark):
    """Two decimals of the binary value, half to even: ties, near ties and large numbers."""
    rng = random.Random(3)
    xs = [0, 125, 999, 1000, 1005, 1015, 1023, 1024, 1125, 1375, 15625, 16000, 614125, 2**60, 2**63 - 1] + [rng.randrange(2 ** rng.randrange(1, 63)) for _ in range(300)]

    def written(x, step, units):
        v, k = float(x), 0
        while v >= step and k < len(units) - 1:
            v, k = v / step, k + 1
        return f"{v:.2f}{units[k]}"

    rows = spark.createDataFrame([(x,) for x in xs], "x long").select("x", scalar.format_bytes(F.col("x")).alias("b"), scalar.format_time(F.col("x")).alias("t")).collect()
    assert [(r.b, r.t) for r in rows] == [(written(r.x, 1024, scalar.BYTE_UNITS), written(r.x, 1000, scalar.TIME_UNITS)) for r in rows]


def test_log_lines_of_another_form(spark):
    good = "[12.5] [TID=7] task `a b` of addr `0xAf` is now in state `Ready`"
    bad = [good.replace("12.5", "1.2.3"), good.replace("12.5", "12"), good.replace("TID=7", "TID=99999999999"), good.replace("a b", ""), good.replace("0xAf", "Af"), good.replace("Ready", "not ready"), "", None]
    rows = logs.parse(spark.createDataFrame([(x,) for x in [good, f"x {good} y", *bad]], "value string")).collect()
    assert [tuple(r) for r in rows] == [(7, "a b", "0xAf", 12.5, "ready")] * 2


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_fill_in_blocks(spark, width):
    rng = random.Random(width)
    rows = [(k, a, a + rng.randrange(0, 9)) for k in range(3) for a in (rng.randrange(-60, 60) for _ in range(30))]
    expected = []
    for key in range(3):
        end = None
        for a, b in sorted((a, b) for k, a, b in rows if k == key and a < b):
            if end is None or a >= end:
                expected.append([key, a, b])
            end = b if end is None else max(end, b)
            expected[-1][2] = end
    got = intervals.fill(spark.createDataFrame(rows, "key long, a long, b long"), ["key"], width).select("key", "a", "b").collect()
    assert sorted(map(list, got)) == sorted(expected)


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_phases_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(h, s, rng.choice([1, 1, 2]), rng.choice(["CONCURRENT", "SEQUENTIAL"])) for h in range(3) for s in sorted(rng.sample(range(90), 40))]
    expected = {}
    for handle in range(3):
        phase, last = 0, None
        for h, s, mode, conc in rows:
            if h == handle:
                kind = "R" if mode == 1 else "C" if conc == "CONCURRENT" else "W"
                phase += kind == "W" or kind != last
                last = kind
                expected[(h, s)] = phase
    got = {(r.handle, r.seq): r.phase for r in deps.phases(spark.createDataFrame(rows, "handle long, seq long, mode int, concurrency string"), ["handle"], block).collect()}
    first = {h: min(p for (k, _), p in got.items() if k == h) for h in range(3)}
    assert {k: p - first[k[0]] + 1 for k, p in got.items()} == expected
