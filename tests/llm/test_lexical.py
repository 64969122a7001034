"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, frame, key, lowered, words
from pyspark.sql import functions as F

from tidemark.llm import lexical


def split(text):
    return re.findall(lexical.TERM, lowered(text))


def brute(rows, items, k=10):
    docs = [(key(i), split(t)) for i, t in rows]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for *_, counts in docs for t in counts)
    out = []
    for item, text in sorted({(key(i), t or "") for i, t in items}):
        found = []
        for i, w, counts in docs:
            m, score = 25 + 75 * len(w) * n // total, 0
            for term, times in Counter(split(text)).items():
                if counts[term]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += times * weight * (1_000_000_000 * counts[term] // (1000 * counts[term] + 8 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def queries_of(rows, seed):
    rng, texts = random.Random(seed), [t for _, t in rows if t]
    items = []
    for i in range(12):
        w = rng.choice(texts).split()
        at = rng.randrange(len(w)) if w else 0
        items.append((i, " ".join(w[at : at + rng.randrange(1, 40)] + words(rng, rng.randrange(3)))))
    return items + [(50, None), (51, ""), (52, "!!! ..."), (53, "unheard-of"), (None, "alpha1 ALPHA1 beta2"), (54, "日本語 é ß"), (3, items[3][1]), (3, "one two two")]


def found(spark, rows, items, k=10):
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string").withColumn("a.b", F.lit(1))
    hits = lexical.ranked_search(frame(spark, rows, clashing=True).withColumn("a.b", F.lit(1)), asked, k)
    assert hits.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((key(r.item_id), r.rank, key(r.doc_id), r.score) for r in hits.collect())


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_search_against_brute_force(spark, monkeypatch, seed, small):
    if small:
        for name, value in (("BLOCK_ROWS", 16), ("BLOCK_BITS", 4096), ("PASS_BYTES", 1500), ("KEPT_TERMS", 60), ("ASKED_TERMS", 70), ("UNPACKED", 5)):
            monkeypatch.setattr(lexical, name, value)
    rows = documents(seed) + [(700 + i, "The same words many times " * (i % 3 + 1)) for i in range(60)]
    items = queries_of(rows, seed) + [(80, "the same words"), (81, "times " * 300)]
    assert found(spark, rows, items) == brute(rows, items)


def test_copies_beyond_the_cut_and_ties(spark):
    rows = [(i, "copy of one text") for i in range(200, 0, -1)] + [(None, "copy of one text")] * 2 + [(500 + i, f"other words {i}") for i in range(30)]
    items = [(1, "copy text"), (2, "other"), (3, "copy other 7")]
    got = found(spark, rows, items, 4)
    assert got == brute(rows, items, 4)
    assert [r[2] for r in got if r[0] == 1] == [key(None), key(None), 1, 2]


def test_search_of_very_long_texts_and_empty_tables(spark):
    rng = random.Random(4)
    many = " ".join(f"w{rng.randrange(30_000)}" for _ in range(80_000))
    rows = [(1, many), (2, "w1 w2 w3"), (3, "w1 " * 50_000), (4, "x" * 200_000)]
    items = [(1, many), (2, "w1 w2"), (3, "x" * 200_000)]
    assert found(spark, rows, items) == brute(rows, items)
    none = frame(spark, []).limit(0)
    assert lexical.ranked_search(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.ranked_search(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert lexical.ranked_search(frame(spark, [(1, None), (2, " ")]), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_bounds_are_never_below_scores_and_tell_documents_apart():
    rows = [(i, t) for i, t in documents(3) if split(t)]
    indexer = lexical.Indexer()
    blocks = list(indexer.add([key(i) for i, _ in rows], list(range(len(rows))), [t.encode() for _, t in rows])) + [b.row() for b in indexer.open.values()]
    names = [part.split()[0] for part in lexical.INDEX.split(", ")]
    vocabulary = sorted({w for _, t in rows for w in split(t)})[:200]
    asked = lexical.Asked([w.encode() for w in vocabulary], [np.arange(i * 10, i * 10 + 10) for i in range(20)], [np.arange(1, 11)] * 20, len(rows), sum(len(split(t)) for _, t in rows))
    near = total = 0
    for block in (dict(zip(names, b, strict=True)) for b in blocks):
        bounds, places = asked.bounds(block), np.frombuffer(block["hashes"], np.int64)
        for column, place in enumerate(places.tolist()):
            counts = Counter(w.encode() for w in split(rows[place][1]))
            exact = np.array([asked.score(item, counts, sum(counts.values())) for item in range(20)])
            assert (bounds[:, column] >= exact).all()
            near, total = near + int((bounds[:, column] <= 1.3 * exact + 1).sum()), total + 20
    assert near > 0.8 * total
