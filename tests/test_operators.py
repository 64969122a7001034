"""Operators against brute force, including hot keys, ties and NULLs."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.numeric import clamp, exact_sum, sum_if_any
from tidemark.operators import aggregates, asof, charts, compare, crosssection, postings, scans, search, turns
from tidemark.session import table
from tidemark.streaming import jobs

START = dt.datetime(2024, 1, 1)


def moments(count, seed, hot=0.5):
    """Rows of which one key holds the larger part."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < hot else rng.choice("abc"), START + dt.timedelta(minutes=rng.randrange(200_000)), at)
        for at in range(count)
    ]


@pytest.mark.parametrize("unit", [None, "day", "month"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_against_brute_force(spark, unit, inclusive):
    left, right = moments(300, 1), moments(200, 2)
    right += [(k, t, 1000 + i) for k, t, i in left[:20]] + [("hot", START, None)]
    frames = [spark.createDataFrame(rows, "k string, t timestamp_ntz, v int") for rows in (left, right)]
    joined = asof.asof_join(
        frames[0], frames[1].select("k", F.col("t").alias("rt"), F.col("v").alias("rv")), ["k"], "t", "rt",
        ["rt", "rv"], unit=unit, tie=["rv"], inclusive=inclusive,
    )
    found = {row["v"]: (row["rt"], row["rv"]) for row in joined.collect()}
    assert len(found) == len(left)
    for key, moment, number in left:
        seen = [(t, v) for k, t, v in right if k == key and (t <= moment if inclusive else t < moment)]
        best = max(seen, key=lambda p: (p[0], -1 if p[1] is None else p[1]), default=(None, None))
        assert found[number] == best


def test_matched_row_keeps_its_nulls(spark):
    left = spark.createDataFrame([("a", dt.date(2024, 3, 1))], "k string, d date")
    right = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), 1, 2), ("a", dt.date(2024, 2, 1), None, 3)], "k string, p date, x int, y int"
    )
    row = asof.asof_join(left, right, ["k"], "d", "p", ["p", "x", "y"]).first()
    assert (row["p"], row["x"], row["y"]) == (dt.date(2024, 2, 1), None, 3)
    intervals = asof.validity_intervals(right, ["k"], "p")
    row = asof.interval_join(left, intervals, ["k"], "d", "p", "valid_until", ["p", "x", "y"]).first()
    assert (row["p"], row["x"], row["y"]) == (dt.date(2024, 2, 1), None, 3)


@pytest.mark.parametrize("unit", ["day", "month"])
def test_overlapping_intervals_against_brute_force(spark, monkeypatch, unit):
    rng = random.Random(12)
    at = lambda: START + dt.timedelta(hours=rng.randrange(24 * 70))
    spans = []
    for i in range(300):
        start = at()
        end = rng.choice([None, start, start - dt.timedelta(hours=3), start + dt.timedelta(hours=1), start + dt.timedelta(days=rng.randrange(50))])
        spans.append((rng.choice(["a", "b", "c", None]), rng.choice([start, start, start, None]), end, rng.choice([i, None]), i))
    points = [(rng.choice(["a", "a", "b", "d", None]), rng.choice([at(), spans[i % 300][1], spans[i % 300][2]]), i) for i in range(400)]
    left = spark.createDataFrame(points, "k string, t timestamp_ntz, `a.b` int").repartition(3)
    right = spark.createDataFrame(spans, "k string, start timestamp_ntz, until timestamp_ntz, x int, id int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = asof.interval_join(left, right, ["k"], "t", "start", "until", ["x", "id"], unit)
        assert got.columns == ["k", "t", "a.b", "x", "id"]
        rows = sorted(tuple((v is not None, v) for v in (r["a.b"], r["id"], r["x"])) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = []
    for key, time, number in points:
        open_ = [(x, i) for k, s, u, x, i in spans if key is not None and k == key and s is not None and time is not None and s <= time and (u is None or time < u)]
        wanted += [(number, i, x) for x, i in open_] or [(number, None, None)]
    assert rows == sorted(tuple((v is not None, v) for v in w) for w in wanted)


def test_long_spans_are_listed_a_few_times(spark, tiny, monkeypatch):
    """Spans of orders last for years; each may stand only in a few calendar units."""
    from tidemark.plans import queries_market

    given, join = {}, asof.interval_join

    def noted(left, intervals, *args, unit="month", **more):
        given.update(intervals=intervals, unit=unit)
        return join(left, intervals, *args, unit=unit, **more)

    monkeypatch.setattr(asof, "interval_join", noted)
    queries_market.orders_open_at_shipping(spark, tiny)
    unit, spans = given["unit"], given["intervals"].filter("opened < closed")
    cut = lambda name: F.date_trunc(unit, F.col(name))
    listed = spans.select(F.size(F.sequence(cut("opened"), cut("closed"), F.expr(f"interval 1 {unit}"))).alias("n"))
    found = listed.agg(F.avg("n").alias("mean"), F.max("n").alias("most")).first()
    assert found.mean < 5 and found.most < 12


def test_sweep_hands_on_bounded_batches():
    """Many open intervals over many rows, in one batch and cut between batches."""
    n = 500
    rows = [(i == 0, 0, i, None if i % 2 else 10**9, None, {"id": i}) for i in range(n)] + [(False, 1, n + i, None, {"at": i}, None) for i in range(n)]
    kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.struct({"at": pa.int32()}), pa.struct({"id": pa.int32()})]
    names = ["first", "side", "moment", "until", "left", "match"]
    for size in (len(rows), 300):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows[at : at + size], strict=True), kinds, strict=True)], names=names)
            for at in range(0, len(rows), size)
        ]
        got = list(asof._sweep(iter(batches)))
        assert max(batch.num_rows for batch in got) <= asof.SWEPT_ROWS + n
        pairs = {(left["at"], match["id"]) for batch in got for left, match in zip(*(column.to_pylist() for column in batch.columns), strict=True)}
        assert len(pairs) == sum(batch.num_rows for batch in got) == n * n


def test_stored_profile_takes_a_new_shard(spark):
    rng = random.Random(5)
    rows = [(i % 3, rng.choice([None, rng.gauss(0, 9)]), rng.choice(["x", "y", None]), START.date() + dt.timedelta(days=rng.randrange(400)), rng.randrange(5000)) for i in range(6000)]
    df = spark.createDataFrame(rows, "part int, v double, s string, d date, `a.b` int").repartition(4)
    stored = aggregates.profile_parts(df.filter("part < 2"), F.col("part"))
    updated = aggregates.merged_profile(stored.unionByName(aggregates.profile_parts(df.filter("part = 2"), F.col("part"))), [0.1, 0.5])
    fresh, exact = aggregates.merged_profile(aggregates.profile_parts(df), [0.1, 0.5]), {r.field: r for r in aggregates.field_profile(df).collect()}
    one, two = ({r.field: r for r in p.collect()} for p in (updated, fresh))
    assert one.keys() == two.keys() == exact.keys() == set(df.columns)
    for name, row in exact.items():
        for other in (one[name], two[name]):
            assert (other.kind, other.null_ratio, other["min"], other["max"]) == (row.kind, row.null_ratio, row["min"], row["max"])
            assert other.mean == (None if row.mean is None else pytest.approx(row.mean, abs=0.011))
            assert other.distinct_count == pytest.approx(row.distinct_count, rel=0.05)
        values = [r[df.columns.index(name)] for r in rows if r[df.columns.index(name)] is not None]
        assert row.distinct_count == len(set(values))
        assert one[name].distinct_count == pytest.approx(two[name].distinct_count, rel=0.02)
    known = sorted(r[1] for r in rows if r[1] is not None)
    for found, q in zip(one["v"].quantiles, (0.1, 0.5), strict=True):
        assert abs(sum(v <= found for v in known) / len(known) - q) < 0.03
    assert one["s"].quantiles is None
    assert aggregates.field_profile(df.filter("false")).filter("distinct_count = 0").count() == 5


def test_running_measures_against_brute_force(spark):
    rows = [(k, t, i, i % 7 if i % 5 else None) for k, t, i in moments(400, 3)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, v int")
    measures = {
        "high": scans.Running("max", F.col("v")), "low": scans.Running("min", F.col("v")),
        "total": scans.Running("sum", F.col("v")), "n": scans.Running("count", F.col("v")),
        "latest": scans.Running("last", F.col("v")),
    }
    out = scans.running(df, ["k"], ["t", "i"], F.date_trunc("day", "t"), measures)
    before = scans.running(df, ["k"], ["t", "i"], F.date_trunc("day", "t"), {"total": measures["total"]}, include_current=False)
    exclusive = {row["i"]: row["total"] for row in before.collect()}
    found = {row["i"]: row for row in out.collect()}
    for key, moment, number, _ in rows:
        upto = sorted((t, i, v) for k, t, i, v in rows if k == key and (t, i) <= (moment, number))
        known = [v for _, _, v in upto if v is not None]
        row = found[number]
        assert (row["high"], row["low"], row["total"]) == (
            max(known, default=None), min(known, default=None), sum(known) if known else None,
        )
        assert row["n"] == len(known) and row["latest"] == (known[-1] if known else None)
        earlier = [v for _, _, v in upto[:-1] if v is not None]
        assert exclusive[number] == (sum(earlier) if earlier else None)


def test_neighbours_cross_segments(spark):
    rows = moments(200, 4)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int")
    for ahead in (False, True):
        out = scans.neighbour(df, ["k"], ["t", "i"], F.date_trunc("day", "t"), {"near": F.col("i")}, ahead)
        found = {row["i"]: row["near"] for row in out.collect()}
        for key in {k for k, _, _ in rows}:
            line = [i for _, i in sorted((t, i) for k, t, i in rows if k == key)]
            for at, number in enumerate(line):
                other = at + 1 if ahead else at - 1
                assert found[number] == (line[other] if 0 <= other < len(line) else None)
    places = {r["i"]: r["position"] for r in scans.row_position(df, ["k"], ["t", "i"], F.date_trunc("day", "t")).collect()}
    line = [i for _, i in sorted((t, i) for k, t, i in rows if k == "hot")]
    assert [places[i] for i in line] == list(range(1, len(line) + 1))


def test_peers_share_a_running_value(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", day, 1), ("a", day, 5), ("a", dt.date(2024, 1, 2), 2)], "k string, d date, v int")
    out = scans.running(df, ["k"], ["d"], F.trunc("d", "month"), {"m": scans.Running("max", F.col("v"))}, peers=True)
    assert sorted(r["m"] for r in out.collect()) == [5, 5, 5]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(5)
    rows = [("big", rng.choice([rng.gauss(0, 50), 3.0, -3.0])) for _ in range(5001)] + [("one", 7.5), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r["median"] for r in aggregates.exact_quantile(df, ["k"], "v", q, accuracy=200).collect()}
    for key in ("big", "one", "two"):
        line = sorted(v for k, v in rows if k == key)
        rank = (len(line) - 1) * q
        low, high = line[math.floor(rank)], line[math.ceil(rank)]
        assert found[key] == pytest.approx(low + (high - low) * (rank - math.floor(rank)), abs=1e-9)


def test_tokens_and_estimates(spark):
    rows = [("Hello_1 世界你好 x", 1), ("", 2), (None, 3), ("一", 4)]
    df = spark.createDataFrame(rows, "t string, n int").orderBy("n")
    found = [(r[0], r[1]) for r in df.select(text.tokens(F.col("t")), text.token_estimate(F.col("t"))).collect()]
    assert found[0] == (["hello_1", "世界你好", "世界", "界你", "你好", "x"], 4 + 3)
    assert found[1] == ([], 0) and found[2][1] == 0 and found[3] == (["一"], 1)


def brute_bm25(documents, query):
    import re

    def cut(body):
        words = re.findall(r"[a-z0-9_]+|[一-鿿]+", body.lower())
        return [t for w in words for t in ([w] + [w[i:i + 2] for i in range(len(w) - 1)] if "一" <= w[0] <= "鿿" else [w])]

    bags = {key: cut(body) for key, body in documents}
    mean = sum(map(len, bags.values())) / len(bags)
    df = Counter(term for bag in bags.values() for term in set(bag))
    scores = {}
    for key, bag in bags.items():
        tf, score = Counter(bag), 0.0
        for term in cut(query):
            if tf[term]:
                idf = math.log(1 + (len(bags) - df[term] + 0.5) / (df[term] + 0.5))
                score += idf * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(bag) / max(1.0, mean)))
        if score > 0:
            scores[key] = score
    return {key: score / max(scores.values()) for key, score in scores.items()}


def test_bm25_against_brute_force(spark):
    documents = [(1, "总市值 市值 market cap"), (2, "成交额 the the the"), (3, "the market"), (4, "无关"), (5, "")]
    queries = [(10, "市值 the"), (11, "the the market"), (12, "zzz")]
    found = search.bm25(
        spark.createDataFrame(documents, "id int, body string"), "id", "body",
        spark.createDataFrame(queries, "q int, ask string"), "q", "ask",
    ).collect()
    for query_id, ask in queries[:2]:
        wanted = brute_bm25(documents, ask)
        got = {r["doc_id"]: r["score"] for r in found if r["query_id"] == query_id}
        assert got.keys() == wanted.keys()
        assert all(got[key] == pytest.approx(wanted[key]) for key in wanted)
    assert not [r for r in found if r["query_id"] == 12]


def test_bm25_with_depth_equals_brute_force_and_skips_blocks(spark):
    from tidemark.operators import postings

    rng = random.Random(11)
    vocabularies = [[f"{language}{i}" for i in range(300)] for language in "abcd"]
    weights = [1 / (i + 1) for i in range(300)]
    documents = [(i, " ".join(rng.choices(vocabularies[i % 4], weights, k=rng.choice([3, 10, 60, 200])))) for i in range(600)]
    queries = [(i, " ".join(rng.choices(vocabularies[i % 4], weights, k=6))) for i in range(8)] + [(20, documents[7][1]), (21, "a0 b1"), (22, "zzz"), (23, None)]
    documents += [(1000, None), (1001, ""), (1002, documents[7][1]), (1003, documents[7][1])]
    frame = spark.createDataFrame(documents, "id int, body string").repartition(3)
    asked = spark.createDataFrame(queries, "q int, ask string")
    wanted = {q: brute_bm25([(i, t or "") for i, t in documents], ask or "") for q, ask in queries}
    small = {"block_docs": 4, "shard_docs": 90, "shard_tokens": 3000}
    for sizes, block, seeded in (({}, 1000, 100), (small, 3, 100), (small, 3, 0)):
        index = postings.build_postings(frame, "id", "body", **sizes)
        rows = postings.search_postings(index, search.terms_of_queries(asked, "q", "ask"), 10, block, seeded).collect()
        for query_id, scores in wanted.items():
            got = sorted((-round(r.raw, 9), r.doc_id) for r in rows if r.query_id == query_id and r.raw is not None)[:10]
            best = sorted((-round(s, 9), i) for i, s in scores.items())[:10]
            assert [i for _, i in got] == [i for _, i in best]
            assert [s / got[0][0] for s, _ in got] == pytest.approx([-s for s, _ in best])
        # Each query scored a part of the documents that share a term with it.
        scored = Counter()
        for r in rows:
            scored[r.query_id] += r.scored or 0
        sharing = {q: len(scores) for q, scores in wanted.items() if scores}
        assert scored.keys() == sharing.keys() and all(scored[q] <= sharing[q] for q in scored)
    assert sum(scored.values()) < 0.6 * sum(sharing.values())
    ranked = search.bm25(frame, "id", "body", asked, "q", "ask", 10).collect()
    assert {(r.query_id, r.rank) for r in ranked} == {(q, i + 1) for q, scores in wanted.items() for i in range(min(10, len(scores)))}
    none = spark.createDataFrame([], "id int, body string")
    assert search.bm25(none, "id", "body", asked, "q", "ask", 10).count() == 0


def test_dense_search_keeps_ties_and_blocks_agree(spark, monkeypatch):
    rng = random.Random(6)
    vectors = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(60)]
    documents = spark.createDataFrame(vectors, "id long, v array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v) for i, v in vectors[:7]], "q long, w array<float>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for block in (100, 2):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        found = search.dense_search(documents, "id", "v", queries, "q", "w", 5).collect()
        for query_id, weights in vectors[:7]:
            wanted = sorted(((-dot(weights, v), i) for i, v in vectors))[:5]
            got = sorted((r["rank"], r["doc_id"]) for r in found if r["query_id"] == query_id)
            assert [i for _, i in got] == [i for _, i in wanted]
    single = search.nearest_to(documents, "v", vectors[0][1], "id", 5).collect()
    assert [r["doc_id"] for r in single] == [i for _, i in sorted((-dot(vectors[0][1], v), i) for i, v in vectors)[:5]]


def test_retrieval_quality(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3), (2, "a", 1), (2, "b", 2)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "x"), (1, "y"), (2, "b"), (3, None), (4, "x"), (4, "missing")], "query_id int, doc_id string")
    got = {r["query_id"]: (r["recall"], r["reciprocal_rank"]) for r in search.retrieval_quality(gold, ranked).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.0, 0.5), 3: (1.0, 0.0), 4: (0.0, 0.0)}


def test_compare_results(spark):
    base = spark.createDataFrame([("a", 1.0000001, 1), ("b", 2.0, None)], "k string, v double, n int")
    equal = lambda a, b: tuple(compare.compare_results(a, b).first())
    near = spark.createDataFrame([(2.0, None, "b"), (1.0000002, 1, "a")], "v double, n int, k string")
    assert equal(base, near) == (True, "")
    assert equal(base, near.withColumn("v", F.col("v") + 0.5)) == (False, "values differ")
    assert equal(base, near.limit(1)) == (False, "row counts differ")
    assert equal(base, near.drop("n"))[1] == "columns differ"
    assert equal(base.select("k", F.lit(True).alias("v")), base.select("k", F.lit(1).alias("v")))[0] is False
    empty = base.filter("false")
    assert equal(empty, empty) == (True, "")


def test_compare_results_pairs_within_the_tolerance(spark):
    """Rows that swap places in the order of their first number still pair; what a shared partner leaves over does not."""
    equal = lambda a, b: compare.compare_results(a, b).first()["equal"]
    table = lambda rows: spark.createDataFrame(rows, "v double, w double")
    assert equal(table([(1.0000001, 5.0), (1.0000002, 9.0)]), table([(1.0000003, 5.0), (1.0000001, 9.0)]))
    step = 0.7e-6
    chain = [(at * step, 1.0) for at in range(6)]
    assert equal(table(chain), table([(v + step, w) for v, w in chain]))
    assert not equal(table(chain), table([(v + 3 * step, w) for v, w in chain]))
    odd = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 2.0), (float("-inf"), None), (-0.0, 0.0)]
    assert equal(table(odd), table([*odd[1:4], (0.0, 1e-7), (None, 1.0 + 5e-7)]))
    assert not equal(table(odd), table([*odd[:3], (float("inf"), None), (0.0, 0.0)]))
    assert not equal(table([(None, 1.0)]), table([(float("nan"), 1.0)]))


@pytest.mark.parametrize("seed", range(2))
def test_compare_results_against_brute_force(spark, monkeypatch, seed):
    """Dense chains with repeats, ordered in stretches of a few values, against all assignments."""
    monkeypatch.setattr(compare, "ROWS_PER_STRETCH", 3)
    draw = random.Random(seed)
    for _ in range(2):
        left = [(draw.randrange(5) * 0.6, draw.randrange(3) * 0.6) for _ in range(6)]
        right = [(v + draw.choice((-0.6, 0.0, 0.6)), w + draw.choice((0.0, 0.6))) for v, w in left]
        if draw.random() < 0.5:
            right[0] = (right[0][0] + 1.2, right[0][1])
        near = lambda a, b: all(abs(x - y) <= 1.0 for x, y in zip(a, b, strict=True))
        wanted = any(all(map(near, left, order)) for order in itertools.permutations(right))
        frames = [spark.createDataFrame(rows, "v double, w double") for rows in (left, right)]
        assert compare.compare_results(*frames, tolerance=1.0).first()["equal"] == wanted


def test_comparison_of_numbers_is_spread(spark):
    """Rows that hold nothing but numbers are ordered in many stretches, and none of them is paired in Python."""
    base = spark.range(300_000).select((F.col("id") * 0.001).alias("v"), (F.col("id") % 7 * 1.0).alias("w"))
    moved = base.withColumn("v", F.col("v") + 4e-7)
    assert compare.compare_results(base, moved).first()["equal"]
    assert not compare.compare_results(base, moved.withColumn("v", F.col("v") + F.when(F.col("w") == 3, 2e-6).otherwise(0))).first()["equal"]
    values = base.select("v").distinct()
    cut = compare._chain_starts(values, [], "v", 1e-6, 8)
    assert cut.filter(F.col("v") == F.col("__start")).count() == 300_000


def test_quota_and_budget(spark):
    rows = [("g", START + dt.timedelta(hours=h), h) for h in range(8)] + [("other", START, 100)]
    got = turns.admitted(spark.createDataFrame(rows, "k string, t timestamp_ntz, i int"), "k", "t", ["i"]).collect()
    assert sorted(r["remaining"] for r in got if r["k"] == "g") == [0, 1, 2, 3, 4]
    assert [r["remaining"] for r in got if r["k"] == "other"] == [4]
    talk = spark.createDataFrame([("s", i, "abcd" * 3) for i in range(5)], "s string, turn int, body string")
    batch = turns.summary_batch(turns.with_tokens(talk, "body"), "s", "turn", trigger=1, budget=1, protected=2)
    assert [r["turn"] for r in batch.collect()] == [0]
    assert sorted(r["turn"] for r in turns.unprotected(talk, "s", "turn", 2).collect()) == [0, 1, 2]
    assert turns.over_budget(turns.with_tokens(talk, "body"), "s", 1, 5).count() == 0


def test_quota_stream_continues_across_batches(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / name) for name in ("in", "out", "progress"))
    schema = "k string, t timestamp_ntz, i int"

    def arrive(hours, first):
        rows = [("g", START + dt.timedelta(hours=h), first + h) for h in hours]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.admit_daily(stream, "k", "t", ["i"], output, checkpoint, limit=5, arrived="t").awaitTermination()

    arrive(range(3), 0)
    arrive(range(4), 50)
    rows = spark.read.parquet(output)
    got = rows.where("decision = 'admitted'").collect()
    assert {(r["i"], r["reason"]) for r in rows.where("decision = 'refused'").collect()} == {(52, "quota"), (53, "quota")}
    assert sorted(r["remaining"] for r in got) == [0, 1, 2, 3, 4] and {r["i"] for r in got} == {0, 1, 2, 50, 51}


def test_upsert_keeps_cap_per_owner(spark):
    rows = [("u", f"i{n}", n, "old") for n in range(25)] + [("u", "i0", 99, "new"), ("w", "i1", 1, "x")]
    kept = turns.keep_newest(spark.createDataFrame(rows, "o string, item string, at int, body string"), "o", "item", ["at"])
    mine = [r for r in kept.collect() if r["o"] == "u"]
    assert len(mine) == 20 and {r["body"] for r in mine if r["item"] == "i0"} == {"new"}
    assert {r["item"] for r in mine} == {"i0", *(f"i{n}" for n in range(6, 25))}


def test_charts(spark):
    df = spark.createDataFrame([("a", "5"), ("b", "-1"), (None, "9"), ("", "8"), ("c", "x"), ("d", "7")], "k string, v string")
    assert [tuple(r) for r in charts.bar(df, "k", "v").collect()] == [("d", 7.0), ("a", 5.0), ("b", -1.0)]
    assert [(r["label"], round(r["share"], 4)) for r in charts.pie(df, "k", "v").collect()] == [("d", 0.5833), ("a", 0.4167), ("b", 0.0)]
    assert charts.pie(df.filter("k = 'b'"), "k", "v").count() == 0
    assert charts.line(df.filter("k = 'b'"), "k", "v").count() == 0
    assert [r["label"] for r in charts.line(df, "k", "v", 2).collect()] == ["b", "d"]
    cells = spark.createDataFrame([(1, "x", "p", 1.0), (2, "y", "p", 4.0), (3, "x", "q", 2.0)], "n int, x string, y string, v double")
    heat = sorted((r["x_id"], r["y_id"], r["value"], r["low"], r["high"]) for r in charts.heatmap(cells, "x", "y", "v", ["n"]).collect())
    assert heat == [(0, 0, 1.0, 1.0, 4.0), (0, 1, 2.0, 1.0, 4.0), (1, 0, 4.0, 1.0, 4.0)]


def test_relative_ranges_and_year_shift(spark):
    today = F.lit("2024-03-06").cast("date")
    one = spark.range(1)
    span = lambda name: tuple(map(str, one.select(*dates.relative_range(name, today)).first()))
    assert span("本周") == ("2024-03-04", "2024-03-10") and span("上周") == ("2024-02-26", "2024-03-03")
    assert span("上月") == ("2024-02-01", "2024-02-29") and span("今年") == ("2024-01-01", "2024-12-31")
    with pytest.raises(ValueError):
        dates.relative_range("明天", today)
    shifted = lambda d: [str(x) for x in one.select(dates.same_day_years_later(F.lit(d).cast("date"), 1)).first()[0]]
    assert shifted("2023-02-28") == ["2024-02-28", "2024-02-29"] and shifted("2024-02-29") == []
    assert shifted("2023-06-30") == ["2024-06-30"]


def test_small_rules(spark):
    df = spark.createDataFrame([(None, None, 0.1), (1.0, None, -0.25), (None, 2.0, 7.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(sum_if_any(F.col("a"), F.col("b"))).collect()] == [None, 1.0, 2.0]
    assert df.agg(exact_sum(F.col("c"), 2)).first()[0] == 6.85
    assert [r[0] for r in df.select(clamp(F.col("a"), 0.0, 0.5)).collect()] == [None, 0.5, None]
    names = spark.createDataFrame([("1", "50%_a", 1), ("2", "50x_a", 2), ("3", "50%_", 1), ("4", "50%_b", 9)], "c string, n string, d int")
    assert [r["c"] for r in crosssection.resolve_entity(names, "c", "n", "d", "50%_").collect()] == ["3", "4", "1"]
    with pytest.raises(ValueError):
        aggregates.pinned(df, {"a": "mode"})


def test_pinned_hits_are_confirmed_or_appended(spark):
    columns = "query_id int, doc_id int, score double, rerank_score double, keyword_rank int, dense_rank int, rrf_score double, keyword_score double, vector_score double, selection_reason string, source string"
    found = spark.createDataFrame([(1, 1, 0.6, 0.6, 1, None, 0.1, 0.2, 0.3, "rerank_threshold", "retrieval")], columns)
    pinned = spark.createDataFrame([(1, 1), (1, 9)], "query_id int, doc_id int")
    rows = {r["doc_id"]: r for r in search.pin(found, pinned).collect()}
    assert rows[1]["score"] == 1.0 and rows[1]["keyword_score"] == 0.2 and rows[1]["source"] == "user_confirmed"
    assert rows[9]["score"] == 1.0 and rows[9]["rrf_score"] == 0.0 and rows[9]["keyword_rank"] is None


def test_golden_snapshot(spark, tiny, tmp_path):
    """A stored result and a fresh run of the same query compare as equal."""
    from tidemark.plans import registry

    registry.load_all()
    for name in ("latest_day_top_orders", "trailing_month_top_parts"):
        path = f"{tmp_path}/{name}"
        registry.QUERIES[name](spark, tiny).write.parquet(path)
        outcome = compare.compare_results(spark.read.parquet(path), registry.QUERIES[name](spark, tiny)).first()
        assert outcome["equal"], outcome["reason"]


def test_plans_push_down_and_avoid_products(spark, tiny):
    lines = table(spark, tiny, "lineitem").filter(F.col("l_quantity") > 30).groupBy("l_returnflag").count()
    plan = lines._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in plan
    documents, queries = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    found = search.bm25(documents, "doc_id", "text", queries, "item_id", "text", 5)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().toString()


def test_unknown_keys_match_nothing(spark):
    facts = spark.createDataFrame([(None, 1, 7), ("a", 1, 8)], "k string, t int, v int").withColumn("t", F.timestamp_seconds("t"))
    asks = spark.createDataFrame([(None, 2), (None, 3), ("a", 2), ("a", 0)], "k string, s int").withColumn("s", F.timestamp_seconds("s"))
    for unit in ("day", None):
        found = asof.asof_join(asks, facts, ["k"], "s", "t", ["v"], unit=unit).collect()
        assert sorted((r.k or "", r.v or 0) for r in found) == [("", 0), ("", 0), ("a", 0), ("a", 8)]


def test_versions_of_unknown_entities_are_not_linked(spark):
    rows = [(None, "2024-01-01", "2024-01-05"), (None, "2024-02-01", "2024-02-05"), ("a", "2024-01-01", "2024-01-05"), ("a", "2024-02-01", "2024-02-05")]
    versions = spark.createDataFrame(rows, "e string, valid string, known string").select(
        "e", F.to_date("valid").alias("valid"), F.to_date("known").alias("known")
    )
    roles = {"before": (F.array(F.add_months("valid", 1)), ["valid"])}
    found = asof.link_visible_versions(versions, ["e"], "valid", "known", roles).collect()
    assert len(found) == 4
    assert sorted((r.e, str(r.before.valid)) for r in found if r.before) == [("a", "2024-01-01")]


def test_of_equal_starts_the_last_covers_the_time(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 5, 3)], "k string, t int, v int").withColumn("t", F.timestamp_seconds("t"))
    spans = asof.validity_intervals(rows, ["k"], "t", tie=["v"]).select("v", F.unix_seconds("t").alias("t"), F.unix_seconds("valid_until").alias("u"))
    assert sorted(map(tuple, spans.collect()), key=str) == [(1, 1, 1), (2, 1, 5), (3, 5, None)]


def test_quantiles_of_hot_keys_and_narrow_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    data = {"hot": 1000 + rng.random(20000), "flat": np.full(3000, 5.0), "few": np.array([3.0, 1.0, 2.0, 9.0]), "one": np.array([4.0])}
    data["mixed"] = np.concatenate([rng.normal(0, 1, 1500), np.full(1500, 0.25)])
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").cache()
    for q in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
        found = {r.k: r.x for r in aggregates.exact_quantile(df, ["k"], "v", q, "x").collect()}
        assert found.keys() == data.keys()
        for k, values in data.items():
            assert found[k] == pytest.approx(float(np.quantile(values, q)), rel=1e-12), (k, q)
        whole = aggregates.exact_quantile(df, [], "v", q, "x")
        assert whole.first()[0] == pytest.approx(float(np.quantile(np.concatenate(list(data.values())), q)), rel=1e-12)
    plan = aggregates.without_outliers(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    df.unpersist()


def test_dense_search_over_several_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    vectors, asked = rng.integers(-3, 4, (90, 5)).astype(float), rng.integers(-3, 4, (8, 5)).astype(float)
    documents = spark.createDataFrame([(f"d{i:02}", v.tolist()) for i, v in enumerate(vectors)] + [("gone", None)], "id string, v array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, None)], "q long, w array<double>")
    found = search.dense_search(documents, "id", "v", queries, "q", "w", 4).collect()
    wanted = [
        (q, rank + 1, f"d{i:02}")
        for q in range(8) for rank, i in enumerate(sorted(range(90), key=lambda i, q=q: (-asked[q] @ vectors[i], i))[:4])
    ]
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found) == wanted


@pytest.mark.parametrize("spread", [0.1, 5.0])
def test_vector_groups_below_the_floor_are_skipped(spark, spread):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(20, 8))[rng.integers(0, 20, 1500)] + spread * rng.normal(size=(1500, 8))
    vectors[100:140] = vectors[100]
    asked = rng.normal(size=(9, 8))
    documents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(2)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, w array<double>")
    shards = search.vector_shards(documents, "id", "v", shard_rows=300, group_rows=15)
    rows = search.search_shards(shards, queries, "q", "w", 6, query_block=4).collect()
    for q in range(9):
        got = sorted((-round(r.score, 9), r.doc_id) for r in rows if r.query_id == q and r.score is not None)[:6]
        assert [i for _, i in got] == sorted(range(1500), key=lambda i, q=q: (-round(float(asked[q] @ vectors[i]), 9), i))[:6]
    share = sum(r.scored or 0 for r in rows) / (9 * 1500)
    assert share < 0.4 if spread < 1 else share <= 1


def test_a_cluster_has_to_name_its_shared_folder(tmp_path):
    from tidemark import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Session(spark_master=master))
        named = Session(spark_master=master)
        named.conf["spark.checkpoint.dir"] = f"{tmp_path}/"
        assert session.shared_folder(named) == str(tmp_path)


def test_stage_tables_can_be_cleared(spark):
    import os

    from tidemark import session

    kept = session.cut_lineage(spark.range(5), "kept")
    folder = session._stages(spark).removeprefix("file:")
    assert kept.count() == 5 and os.listdir(folder)
    session.clear_stages(spark)
    assert not os.path.exists(folder)


def consumed(batches, limit, days=8, zone=8):
    """The rule of one transaction per event: batches in turn, each by (moment, id); no day's count is ever forgotten too early."""
    used, out = {}, []
    local = lambda t: (t + dt.timedelta(hours=zone)).date()
    for rows in batches:
        for user, event, moment, arrived in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[1])):
            if user is None or moment is None or arrived is None:
                reason = "no key" if user is None else "no time"
            elif local(moment) < local(arrived) - dt.timedelta(days=days):
                reason = "late"
            elif local(moment) > local(arrived):
                reason = "future"
            else:
                n = used.get((user, local(moment)), 0)
                reason = None if n < limit else "quota"
                used[user, local(moment)] = min(n + 1, limit)
                out.append((event, reason, limit - n - 1 if reason is None else None))
                continue
            out.append((event, reason, None))
    return sorted(out)


def test_quota_of_disordered_batches_equals_one_transaction_per_event(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, event_id long, ts timestamp_ntz, arrived timestamp_ntz"
    at, hour = dt.datetime(2024, 3, 1, 4), dt.timedelta(hours=1)
    day = 24 * hour
    parts = [
        [(1, i, at + i * hour / 60, at + hour) for i in range(8)] + [(2, 20, dt.datetime(2034, 1, 1), at), (2, 21, None, at), (None, 22, at, at), (2, 23, at, None)],
        [(1, 100 + i, at + i * hour / 60, at + day) for i in range(8)] + [(1, 120, at + day, at + day), (2, 121, at - 9 * day, at + day), (2, 122, at, at + day)],
        [(1, 200, at, at + 8 * day), (1, 201, at + 8 * day, at + 8 * day), (3, 202, at, at + 8 * day)],
        [(1, 300, at, at + 9 * day), (1, 301, at + 8 * day, at + 9 * day), (1, 302, at + day, at + 9 * day)],
        [(1, 400, at + 20 * day, at + 20 * day), (1, 401, at, at + 20 * day), (2, 402, dt.datetime(2034, 1, 1), at + 20 * day)],
        [(1, 500 + i, at + 20 * day, at + 20 * day + hour) for i in range(12)],
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.admit_daily(events, "user_id", "ts", ["event_id"], output, str(tmp_path / "progress"), limit=10, arrived="arrived").awaitTermination()
    got = sorted((r.event_id, r.reason, r.remaining) for r in spark.read.parquet(output).collect())
    assert got == consumed(parts, 10)
    assert {r[1] for r in got} == {None, "quota", "no key", "no time", "late", "future"}
    # Counts of days that can take no event any more are gone from the store.
    state = spark.read.format("statestore").option("stateVarName", "used").load(str(tmp_path / "progress"))
    assert [r["key"]["__day"] for r in state.select("key").collect()] == [(at + 20 * day).date()]


def test_keys_of_a_day_share_few_state_values(spark, tmp_path):
    """Sixty keys of a day in three values; a resumed stream goes on from their counts."""
    source, output, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    schema = "user_id long, event_id long, ts timestamp_ntz, note int"
    at, minute = dt.datetime(2024, 3, 1, 4), dt.timedelta(minutes=1)
    draw = random.Random(3)
    parts = []
    for part in range(2):
        parts.append([(u, part * 1000 + u * 10 + i, at + draw.randrange(60) * minute, draw.choice([None, 2**31 - 1])) for u in range(60) for i in range(draw.randrange(1, 4))])
        spark.createDataFrame(parts[-1], schema).repartition(3).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source)
        jobs.admit_daily(events, "user_id", "ts", ["event_id"], output, progress, limit=3, arrived="ts", lanes=3).awaitTermination()
    rows = spark.read.parquet(output).collect()
    wanted = consumed([[(u, e, t, t) for u, e, t, _ in rows_] for rows_ in parts], 3)
    assert sorted((r.event_id, r.reason, r.remaining) for r in rows) == wanted and {w[1] for w in wanted} == {None, "quota"}
    assert {r.event_id: r.note for r in rows} == {e: note for part in parts for _, e, _, note in part}
    state = spark.read.format("statestore").option("stateVarName", "used").load(progress)
    assert state.count() == 3


def test_weeks_of_the_quota_stream_are_written_by_many_tasks(spark, tiny, tmp_path, monkeypatch):
    from tidemark.plans import queries_turns

    table(spark, tiny, "events").repartition(4).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    monkeypatch.setattr(queries_turns, "scratch_path", lambda spark, label: str(tmp_path / label))
    rows = queries_turns.streaming_quota_batches(spark, str(tmp_path / "sf")).collect()
    assert len(rows) == table(spark, tiny, "events").count() == len({r.event_id for r in rows})
    weeks = spark.read.parquet(str(tmp_path / "quota-in")).select(F.floor(F.dayofmonth("arrived") / 8).alias("week"), F.input_file_name().alias("file"))
    assert all(r.files > 1 for r in weeks.groupBy("week").agg(F.countDistinct("file").alias("files")).collect())


@pytest.mark.parametrize("sent", [True, False])
def test_no_task_meets_all_shards(spark, sent):
    """One block of queries meets twenty shards in several tasks, also where Spark would not broadcast it."""
    shards = spark.range(20, numPartitions=5).select(F.array("id", F.col("id") + 100).alias("ids"))
    packed = spark.range(2).select(F.col("id").cast("int").alias("block"), F.col("id").alias("asked"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for blocks in (1, 2):
            met = postings.meet_shards(shards, packed.filter(F.col("block") < blocks), "ids", blocks, 20, sent)
            rows = met.select("block", "asked", F.element_at("ids", 1).alias("shard"), F.spark_partition_id().alias("task")).collect()
            assert sorted((r["shard"], r["block"], r["asked"]) for r in rows) == [(s, b, b) for s in range(20) for b in range(blocks)]
            assert max(Counter(r["task"] for r in rows).values()) < 20 * blocks
            assert len({r["task"] for r in rows}) > 2
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_searches_agree_on_both_ways_to_the_shards(spark):
    draw = random.Random(5)
    documents = spark.createDataFrame([(i, " ".join(draw.choices("abcdefgh", k=5))) for i in range(60)], "id int, body string")
    asked = search.terms_of_queries(spark.createDataFrame([(q, draw.choice("abcdefgh") + " c") for q in range(9)], "q int, ask string"), "q", "ask")
    index = postings.build_postings(documents, "id", "body", 4, 8)
    vectors = spark.createDataFrame([(i, [draw.uniform(-1, 1) for _ in range(3)]) for i in range(60)], "id int, v array<double>")
    queries = spark.createDataFrame([(q, [draw.uniform(-1, 1) for _ in range(3)]) for q in range(9)], "q int, w array<double>")
    shards = search.vector_shards(vectors, "id", "v", 8, 4)
    for seeded in (0, 100):
        found = [sorted(map(tuple, postings.search_postings(index, asked, 5, 4, seeded, sent).drop("scored").filter("raw is not null").collect())) for sent in (0, 10**9)]
        assert found[0] == found[1] and found[0]
    found = [sorted(map(tuple, search.search_shards(shards, queries, "q", "w", 5, 4, sent).filter("score is not null").collect())) for sent in (0, 10**9)]
    assert found[0] == found[1] and found[0]


def test_comparison_of_totals_that_rounding_has_parted(spark, tmp_path):
    """Floating totals that drift beyond the tolerance are not equal, and the row is that of the SQL."""
    import duckdb
    from tidemark.plans import registry

    registry.load_all()
    prices = [9e11, *[0.01] * 1000]
    orders = [(price, "1-URGENT") for price in prices]
    spark.createDataFrame(orders, "o_totalprice double, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    wanted = sorted(connection.execute(registry.ORACLES["result_set_comparison"]).fetchall())
    assert wanted[0] == ("same", False, "")
    assert sorted(map(tuple, registry.QUERIES["result_set_comparison"](spark, str(tmp_path)).collect())) == wanted
