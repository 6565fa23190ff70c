"""Job monitor, vector index, components, name pairs, paths, ordered diffs and mentions against brute force."""

import collections
import datetime as dt
import difflib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketlake.operators import dialog, entities, graph, reasoning, vector_index, vectors
from docketlake.operators import jobs as job_rules
from docketlake.streaming import streams
from oracle import DATA


def jobs_run(spark, run) -> int:
    """How many Spark jobs ``run`` starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        run()
        return len(tracker.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# --- job monitor

LOG = "log_id long, job_id long, created_at timestamp, message string, status string, progress int, step string, level string"
NOON = dt.datetime(2024, 5, 1, 12)


def log(log_id, job, minute, status, progress=10):
    return (log_id, job, NOON + dt.timedelta(minutes=minute), "m", status, progress, "s", "INFO")


def monitored(spark, tmp_path, batches):
    """News of a stream that takes one batch at a time."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(source / f"logs-{i:03d}.parquet"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(source))
    streams.job_monitor_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), silence_hours=2, keep_hours=1, delay="10 minutes").awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_job_monitor_tells_stuck_jobs_and_drops_finished_ones(spark, tmp_path):
    news = monitored(spark, tmp_path, [
        [log(1, 1, 0, "queued"), log(2, 1, 5, "running", 150), log(3, 2, 6, "completed"), log(4, 3, 7, "running")],
        [log(4, 3, 7, "running"), log(5, 3, 3, "queued"), log(6, 4, 120, "running")],  # a row again, and one that is late but not too late
        [log(7, 3, 130, "running", 60), log(8, 5, 400, "queued")],
        [log(9, 5, 410, "failed"), log(2, 1, 5, "running", 150)],  # long behind the watermark
    ])
    told = collections.Counter((r.job_id, r.kind, r.status, r.log_id) for r in news.collect())
    assert all(n == 1 for n in told.values()) and set(told) == {
        (1, "update", "running", 2), (1, "stuck", "running", 2), (2, "update", "completed", 3), (2, "closed", "completed", 3), (3, "update", "running", 4),
        (3, "update", "running", 7), (3, "stuck", "running", 7), (4, "update", "running", 6), (4, "stuck", "running", 6), (5, "update", "queued", 8), (5, "update", "failed", 9)}
    assert {(r.job_id, r.kind, r.progress) for r in streams.current_jobs(news).collect()} == {
        (1, "stuck", 100), (2, "closed", 10), (3, "stuck", 60), (4, "stuck", 10), (5, "update", 10)}


def test_job_monitor_equals_the_fold(spark, tmp_path):
    """However the log comes in (in order, a part twice), the last state of each job is that of the whole log."""
    rng = random.Random(3)
    rows = [log(i, rng.choice([1, 1, 1, rng.randrange(30)]), i // 3, rng.choice(["running", "queued", "completed"]), rng.randrange(-20, 130)) for i in range(600)]
    batches = [rows[i:i + 150] + rows[max(0, i - 20):i] for i in range(0, 600, 150)]
    got = streams.current_jobs(monitored(spark, tmp_path, batches)).select("job_id", "status", "progress", "step", "log_id")
    want = job_rules.fold_job_log(spark.createDataFrame(rows, LOG)).select("job_id", "status", "progress", "step", "log_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# --- coarse index

def points(spark, n, dim, centres, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    m = middle[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, dim))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(m), "label": np.arange(n) % 3}), "vec_id long, embedding array<float>, label long")
    return df, m


def exact(m, queries, k, keep=None):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[q] if keep is None else np.where(keep, u @ u[q], -np.inf)
        out[q] = [int(i) for i in np.lexsort((np.arange(len(s)), -s))[:k]]
    return out


@pytest.mark.parametrize("block", [16_384, 40])
def test_index_recall_and_exhaustive_search(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", block)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
    df, m = points(spark, 3000, 16, 40)
    index = vector_index.build_index(df.repartition(4), k=5)
    assert index.rows.count() == 3000 and index.probes < index.cells / 2
    asked = df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = exact(np.array(m, np.float32).astype(float), range(0, 3000, 100), 5)

    def found(**kw):
        out = collections.defaultdict(list)
        for r in vector_index.search_index(index, asked, 5, **kw).orderBy("query_id", "rank").collect():
            out[r.query_id].append(r.vec_id)
        return out

    near = found()
    assert sum(len(set(near[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert found(probes=index.cells) == want
    odd = exact(np.array(m, np.float32).astype(float), range(0, 3000, 100), 5, np.arange(3000) % 3 == 1)
    assert found(probes=index.cells, filters={"label": 1}) == odd
    if block == 40:
        vector_index.save_index(index, str(tmp_path / "index"))
        again = vector_index.load_index(spark, str(tmp_path / "index"))
        assert (again.probes, again.cells, again.rows.count()) == (index.probes, index.cells, 3000)
        same = lambda i: sorted(map(tuple, vector_index.search_index(i, asked, 5).select("query_id", "vec_id", "rank").collect()))
        assert same(again) == same(index)


def test_index_of_the_given_vectors_has_the_recall_it_was_built_for(spark):
    """Vectors without any clusters: the calibration asks for many cells, so recall holds."""
    v = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vector_index.search_index(vector_index.build_index(v), asked, 10).select("query_id", "vec_id")
    true = vectors.vector_search(asked, v, 10).select("query_id", "vec_id")
    assert near.join(true, ["query_id", "vec_id"]).count() >= 0.9 * true.count()


def test_index_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    assert vector_index.search_index(vector_index.build_index(empty), asked, 3).count() == 0
    index = vector_index.build_index(one)
    assert [(r.query_id, r.vec_id, r.rank) for r in vector_index.search_index(index, asked, 3, probes=index.cells).orderBy("rank").collect()] == [(9, 1, 1), (9, 3, 2)]


def test_hashed_features_by_hand():
    got = vectors.hashed_features(8)(pd.Series(["b a b", None, "Ab"]))
    want = np.zeros((3, 8))
    for i, t in enumerate(["b a b", "", "ab"]):
        for w in t.split():
            h = zlib.crc32(w.encode())
            want[i, (h >> 1) % 8] += 1 if h & 1 else -1
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(length > 0, length, 1))


# --- components and resolution

def slow_roots(edges):
    root = {}
    for a, b in edges:
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        if x != y:
            root = {n: (min(x, y) if r in (x, y) else r) for n, r in root.items()}
    return root


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(40)] + [(0, 600 + i) for i in range(50)] + [(700, 700)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == slow_roots([e for e in edges if e[0] != e[1]])
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_canonical(pairs):
    before = collections.defaultdict(set)
    for a, b in pairs:
        before[b].add(a)
    kept = set()
    for n in sorted({n for p in pairs for n in p}):
        if not before[n] & kept:
            kept.add(n)
    return kept


@pytest.mark.parametrize("fold_pairs", [1 << 20, 30])
def test_canonical_names(spark, fold_pairs):
    rng = random.Random(4)
    pairs = list({tuple(sorted(rng.sample(range(250), 2))) for _ in range(180)} | {(1000 + i, 1001 + i) for i in range(60)})
    got = {r.id for r in entities._canonical_ids(spark.createDataFrame(pairs, "a_id long, b_id long"), fold_pairs).collect()}
    assert got == slow_canonical(pairs)


def test_a_long_chain_of_names_takes_few_jobs(spark):
    rng = random.Random(5)
    order = list(range(10_000))
    pairs = list(zip(order, order[1:]))
    rng.shuffle(pairs)
    found = {}

    def run(n):
        ids = entities._canonical_ids(spark.createDataFrame([p for p in pairs if p[1] < n], "a_id long, b_id long"))
        found[n] = {r.id for r in ids.collect()}

    few, many = jobs_run(spark, lambda: run(100)), jobs_run(spark, lambda: run(10_000))
    assert found[10_000] == set(range(0, 10_000, 2)) and many < 4 * few


def test_similar_names_meet_on_prefixes(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    names = sorted({" ".join(rng.choices(vocabulary[:1 + int(rng.expovariate(0.2)) % 30], k=rng.randrange(1, 9))) for _ in range(220)})
    df = spark.createDataFrame([(i, i % 2, "party", n, [1.0, float(len(n) % 3)]) for i, n in enumerate(names)], "entity_id long, case_id long, entity_type string, name string, vector array<double>")
    unit = {i: np.array([1.0, len(n) % 3]) / np.hypot(1.0, len(n) % 3) for i, n in enumerate(names)}
    want = set()
    for i, a in enumerate(names):
        for j in range(i + 2, len(names), 2):
            x, y = set(a.split()), set(names[j].split())
            if 0.6 * float(unit[i] @ unit[j]) + 0.4 * len(x & y) / len(x | y) >= 0.78:
                want.add((i, j))
    got = [(r.a_id, r.b_id) for r in entities.similar_names(entities.distinct_names(df, "vector"), block=25).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_one_name_has_as_many_keys_as_tokens(spark):
    df = spark.createDataFrame([(1, 0, "party", " ".join(f"t{i}" for i in range(2000)), [1.0]), (2, 0, "party", " ".join(f"t{i}" for i in range(1000, 3000)), [1.0])],
                               "entity_id long, case_id long, entity_type string, name string, vector array<double>")
    assert entities.similar_names(entities.distinct_names(df, "vector")).count() == 0
    assert entities.similar_names(entities.distinct_names(df, "vector"), threshold=0.7).count() == 1


# --- paths

def test_shortest_paths_of_pairs(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", i) for i in range(75)] + [("hub", f"n{i}", 1000 + i) for i in range(0, 60, 9)] + [("n1", "n1", 5000)]
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(50)] + [("n1", "n1"), ("n1", "nowhere"), ("hub", "n7"), ("hub", "n7")]
    near = collections.defaultdict(set)
    ends = {}
    for a, b, e in edges:
        near[a].add(b)
        near[b].add(a)
        ends[str(e)] = {a, b}

    def hops(a, b):
        seen, front, n = {a}, {a}, 0
        while front:
            if b in front:
                return n
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            n += 1
        return None

    df = spark.createDataFrame(edges, "src string, dst string, edge_id long")
    for limit in (None, 3):
        got = collections.defaultdict(list)
        for r in graph.shortest_paths(df, spark.createDataFrame(pairs, "start string, end string"), limit).orderBy("start", "end", "step").collect():
            got[r.start, r.end].append(r)
        want = {p: hops(*p) for p in pairs}
        want = {p: h for p, h in want.items() if h is not None and (limit is None or h <= limit)}
        assert {p: rows[0].hops for p, rows in got.items()} == want
        for (a, b), rows in got.items():
            assert [r.step for r in rows] == list(range(2 * want[a, b] + 1)) and (rows[0].id, rows[-1].id) == (a, b)
            for x, e, y in zip(rows[::2], rows[1::2], rows[2::2]):
                assert e.kind == "relationship" and ends[e.id] == {x.id, y.id}


# --- ordered diff

def versions(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        old = [rng.choice(["a", "b", "", f"line {rng.randrange(30)}"]) for _ in range(rng.randrange(0, 40))]
        new = list(old)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(new) + 1)
            new[at:at + rng.randrange(0, 3)] = [f"line {rng.randrange(30)}"] * rng.randrange(0, 3)
        if rng.random() < 0.2:
            rng.shuffle(new)
        yield i, "\n".join(old), "\n".join(new)


def test_ordered_diff_leads_from_one_version_to_the_other(spark):
    rows = list(versions(150, 1)) + [(900, "", "x"), (901, None, "x\ny"), (902, "same\ntext", "same\ntext"), (903, "x", None)]
    old = spark.createDataFrame([(i, a) for i, a, _ in rows], "doc_id long, text string")
    new = spark.createDataFrame([(i, b) for i, _, b in rows] + [(950, "only new")], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in dialog.ordered_diff(old, new).orderBy("doc_id", "step").collect():
        got[r.doc_id].append(r)
    for i, a, b in [*rows, (950, None, "only new")]:
        steps = got[i]
        for text, other, place in ((a, "added", "old_line"), (b, "removed", "new_line")):
            lines = [r.line for r in steps if r.change != other]
            assert lines == (text.split("\n") if text is not None else [])
            assert [r[place] for r in steps if r.change != other] == list(range(1, len(lines) + 1))


def test_ordered_diff_finds_moved_and_changed_lines():
    old = [f"line {i}" for i in range(2000)]
    new = [*old[:50], "new", *old[51:700], *old[800:], *old[700:800]]
    changes = list(dialog.diff_lines(old, new))
    assert sum(c[0] == "equal" for c in changes) == 1899 and sum(c[0] == "added" for c in changes) == 101


def test_unified_diff_is_the_usual_text(spark):
    old = [f"line {i}" for i in range(40)]
    cases = [(1, old, [*old[:5], "five", *old[6:]]), (2, old, [*old[:3], *old[4:20], "more", "lines", *old[20:]]), (3, old, old), (4, old, [*old, "end"]), (5, old, old[1:]), (6, ["x"], ["y"]), (7, old, old[:8])]
    df = lambda k: spark.createDataFrame([(c[0], "\n".join(c[k])) for c in cases], "doc_id long, text string")
    got = {r.doc_id: r.diff_text for r in dialog.unified_diff(dialog.ordered_diff(df(1), df(2))).collect()}
    for i, a, b in cases:
        want = "\n".join(list(difflib.unified_diff(a, b, lineterm=""))[2:])
        assert got.get(i, "") == want


# --- mentions

@pytest.mark.parametrize("blocks", [(20_000, 8_000_000), (5, 60)])
def test_mentions(spark, blocks):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abÄ日 ") for _ in range(n))
    names = sorted({(rng.choice([1, 1, 1, 2]), text(rng.randrange(1, 4))) for _ in range(60)} | {(3, "x"), (1, "")})
    texts = [(rng.choice([1, 1, 1, 2, 4]), i, text(rng.randrange(0, 30))) for i in range(90)] + [(1, 200, None)]
    n = spark.createDataFrame([(c, t, t) for c, t in names], "case_id long, nid string, text string")
    t = spark.createDataFrame(texts, "case_id long, hid long, text string")
    got = [tuple(r) for r in reasoning.mentions(n, t, name_block=blocks[0], text_block=blocks[1]).select("case_id", "nid", "hid").collect()]
    want = {(c, x, h) for c, x in names for c2, h, y in texts if c == c2 and x and y and x in y}
    assert len(got) == len(set(got)) and set(got) == want
