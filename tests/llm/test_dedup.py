"""Line dedup, near-dedup, repeated substrings and exact dedup against brute force."""

from collections import Counter

import numpy as np
import pytest
from cases import NO_ID, deduped_lines, documents, frame, key, lowered, near_components, repeats_removed, sha
from pyspark.sql import functions as F

from tidemark.llm import components, exact, lines, minhash, repeats


@pytest.mark.parametrize("clashing", [False, True])
def test_lines_against_brute_force(spark, clashing):
    rows = documents()
    found = lines.dedup_lines(frame(spark, rows, clashing=clashing))
    got = sorted((key(r.doc_id), r.n_lines, r.n_dropped, sha(r.text)) for r in found.collect())
    assert got == deduped_lines(rows)
    assert sum(r[2] for r in got) > 20
    assert set(found.columns) >= {"lang", "source", "n_chars"}


def test_lines_of_no_documents(spark):
    assert lines.dedup_lines(frame(spark, []).limit(0)).count() == 0


def test_lines_ties_and_short_keys(spark):
    long, short = "x" * 40, "y" * 39
    rows = [(i, f"{long}\n{short}\n{long}") for i in range(5)] + [(4, long)]
    got = {(r.doc_id, r.n_dropped, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {(i, 2, short) for i in range(4)} | {(4, 0, f"{long}\n{short}\n{long}"), (4, 0, long)}
    four = [(i, long) for i in range(4)] + [(3, long)]
    assert {r.n_dropped for r in lines.dedup_lines(frame(spark, four)).collect()} == {0}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rows = documents()
    found = minhash.near_duplicates(frame(spark, rows, clashing=True), width, percent)
    assert sorted((r.key, r.n_shingles, r.component) for r in found.collect()) == near_components(rows, width, percent)


def test_a_chain_of_near_copies_is_one_group_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(120)]
    rows, text = [], list(base)
    for i in range(30):  # each step changes one word: neighbours are near, the ends are far apart
        rows.append((i, " ".join(text)))
        text[4 * i] = f"z{i}"
    found = minhash.near_duplicates(frame(spark, rows), 3, 85)
    assert {r.component for r in found.collect()} == {0}
    assert near_components(rows, 3, 85)[-1][2] == 0


def test_near_duplicates_of_no_documents_and_of_empty_texts(spark):
    assert minhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = [(1, None), (2, ""), (3, " \n")]
    got = sorted((r.key, r.n_shingles, r.component) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_one_of_each_group_stays(spark):
    rows = documents()
    docs = frame(spark, rows)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = {i for i, _, c in near_components(rows, 5, 80) if i == c}
    assert {key(r.doc_id) for r in kept.collect()} == wanted


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    def text(name, *changed):
        return " ".join(f"{name}{i}" if i not in changed else f"other{i}" for i in range(150))

    one, null, shared = [(7, text("a")), (7, text("a")), (7, text("a", 3)), (8, text("a"))], [(None, text("b", i)) for i in range(4)], [(9, text("b"))]
    alone = [(None, text("c")), (7, text("d")), (1, ""), (1, ""), (None, None)]
    for clashing in (False, True):
        docs = frame(spark, one + null + shared + alone, clashing=clashing)
        kept = minhash.keep_one(docs)
        assert kept.columns == docs.columns
        got = Counter((r.doc_id, (r.text or "")[:1]) for r in kept.collect())
        assert got.pop((None, "o"), 0) + got.pop((None, "b"), 0) == 1  # of the copies without an id
        assert got == {(7, "a"): 1, (None, "c"): 1, (7, "d"): 1, (1, ""): 2, (None, ""): 1}


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {(r.node, r.component) for r in found.collect()} == set(label.items())


def test_minmax_bands_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
    one, other = np.unique(pool[:1800]), np.unique(pool[200:])  # similarity 0.8
    shared = int((minhash.bands(one) == minhash.bands(other)).sum())
    assert 4 <= shared <= 24  # 32 * 0.8 ** 4 = 13 expected


def row_order(spark, rows):
    texts = spark.createDataFrame([(t or "",) for _, t in rows], "text string")
    return {r.text: r.h for r in texts.select("text", F.xxhash64("text", F.octet_length("text")).alias("h")).collect()}


@pytest.mark.parametrize(("piece", "kinds"), [(1_000_000, 20_000), (300, 20_000), (1_000_000, 2), (700, 0)])
def test_repeats_against_brute_force(spark, monkeypatch, piece, kinds):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "KINDS", kinds)
    rows = documents()
    order = row_order(spark, rows)
    found = repeats.remove_repeats(frame(spark, rows, clashing=True))
    got = sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in found.collect())
    assert got == repeats_removed(rows, order)
    assert sum(r[2] for r in got) > 3000


def test_repeats_hold_across_sort_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = documents(seed=4, n=30)
        order = row_order(spark, rows)
        got = sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == repeats_removed(rows, order)


def test_repeats_of_no_documents_and_short_texts(spark):
    assert repeats.remove_repeats(frame(spark, []).limit(0)).count() == 0
    rows = [(1, "a" * 99), (2, "a" * 99), (3, None), (4, "b" * 100), (5, "b" * 100)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 99, 0, 0), (2, 99, 0, 0), (3, 0, 0, 0), (4, 100, 0, 0), (5, 100, 100, 1)]


def test_very_many_texts_of_one_id(spark):
    """More texts without an id than a short hash could tell apart."""
    rng = np.random.default_rng(1)
    shared = ["a line of its own that only some of the texts have, number %d" % i for i in range(9)]
    rows = [(None, f"item {i} {rng.integers(1 << 60)} and {rng.integers(1 << 60)} with enough characters to make it a long line " + "of text " * 4 + "\n" + shared[i % 9]) for i in range(20_000)]
    rows += [(i, shared[i % 9] + f"\nno {i}") for i in range(60)]
    got = sorted((key(r.doc_id), r.n_lines, r.n_dropped, sha(r.text)) for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert got == deduped_lines(rows)
    got = sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == repeats_removed(rows, row_order(spark, rows))


def test_common_lines_are_looked_up_and_others_joined(spark, monkeypatch):
    rows = documents()
    for part in (10_000, 0.001):  # no line or every frequent line is common
        monkeypatch.setattr(lines, "PER_TASK", part)
        got = sorted((key(r.doc_id), r.n_lines, r.n_dropped, sha(r.text)) for r in lines.dedup_lines(frame(spark, rows)).collect())
        assert got == deduped_lines(rows)


def test_dotted_names_pass_through(spark):
    rows = documents(n=20)
    for operator in (lines.dedup_lines, repeats.remove_repeats):
        df = frame(spark, rows).withColumn("a.b", F.lit(1)).withColumn("x`y", F.lit(2))
        assert [c for c in operator(df).columns if c in df.columns] == df.columns
        assert operator(df).count() == len(rows)


@pytest.mark.parametrize("history", [lambda i: i % 2 == 0, lambda i: False, lambda i: True])
def test_exact_groups_against_brute_force(spark, history):
    rows = documents()
    old, new = [r for r in rows if history(r[0] or 0)], [r for r in rows if not history(r[0] or 0)]
    found = exact.dedup(frame(spark, old, clashing=True), frame(spark, new)).collect()
    largest, count = {}, Counter(lowered(t) for _, t in rows)
    for i, t in rows:
        largest[lowered(t)] = max(largest.get(lowered(t), NO_ID), key(i))
    wanted = sorted((key(i), sha(lowered(t)), largest[lowered(t)], count[lowered(t)], key(i) == largest[lowered(t)]) for i, t in rows)
    assert sorted((r.key, bytes(r.digest).hex(), r.keep_key, r.group_size, r.kept) for r in found) == wanted


def test_perfect_hash_gives_every_digest_its_own_slot():
    digests = np.random.default_rng(1).integers(0, 256, (5000, 32), dtype=np.uint8)
    built = exact.PerfectTable.build(digests)
    assert sorted(built.slots(digests).tolist()) == list(range(5000))
    again = exact.PerfectTable(built.level_bits, built.packed())
    assert (again.slots(digests) == built.slots(digests)).all()
    assert exact.PerfectTable.build(digests[:0]).slots(digests[:3]).tolist() == [-1, -1, -1]
