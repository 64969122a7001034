"""Periodic runs against a scan of all lags."""

import random
import zlib

import numpy as np
import pytest
from cases import BLANKS, documents, frame, sha, words

from tidemark.llm import queries, runs
from tidemark.session import table


def brute_runs(w, least=12, periods=2):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def split(text):
    return "".join(" " if c in BLANKS else c for c in text or "").split(" ") if text else []


def words_of(text):
    return [w for w in split(text) if w]


def cyclic_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(7)):
            base = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 14))]
            w += (base * 4)[: rng.randrange(len(base) * 4)] if rng.random() < 0.6 else words(rng, rng.randrange(9))
        out.append(rng.choice(BLANKS).join(w))
    return out


@pytest.mark.parametrize(("least", "periods"), [(12, 2), (5, 2), (12, 3)])
def test_runs_against_brute_force(spark, monkeypatch, least, periods):
    monkeypatch.setattr(runs, "PASS_BYTES", 900)
    monkeypatch.setattr(runs, "PAIRS", 50)
    monkeypatch.setattr(runs, "KEPT_WORDS", 30)
    rows = documents() + [(1000 + i, t) for i, t in enumerate(cyclic_texts(1, 300))] + [(None, "a " * 40), (None, "a " * 40), (7, "  " * 30 + "  é " * 20)]
    df = frame(spark, rows, clashing=True)
    df = df.toDF(*[{"lang": "a.b", "source": "Runs"}.get(c, c) for c in df.columns])
    got = runs.periodic_runs(df, least=least, periods=periods).select("doc_id", "text", "n_words", "runs", "collapsed").collect()
    assert len(got) == len(rows)
    for r in got:
        w = words_of(r.text)
        wanted = brute_runs(w, least, periods)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), wanted, brute_collapsed(w, wanted))


def test_runs_with_many_periods_and_very_long_texts(spark):
    x, y = ["a"], ["a", "b"]
    while len(y) < 500:
        x, y = y, y + x
    rng = random.Random(5)
    long = words(rng, 60_000)
    rows = [(1, " ".join(y)), (2, "same " * 100_000), (3, " ".join(long)), (4, " ".join(long[:20_000] * 3)), (5, "x" * 300_000)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == brute_runs(y)
    assert ([tuple(r) for r in got[2].runs], got[2].collapsed) == ([(0, 100_000, 1)], "same")
    assert got[3].collapsed == rows[2][1]
    assert (0, 60_000, 20_000) in [tuple(r) for r in got[4].runs]
    assert got[4].collapsed == " ".join(long[:20_000])


def test_splitting_leaves_every_run():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 60, 5000)
    codes[1000:1100] = np.tile(rng.integers(0, 60, 20), 5)
    places, segments = runs.surviving(codes, np.zeros(5000, np.int64), 12)
    assert set(range(1000, 1100)) <= set(places.tolist())
    assert np.bincount(segments).min() >= 12


def test_runs_of_no_documents_and_bad_bounds(spark):
    assert runs.periodic_runs(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(frame(spark, []), periods=1)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n or doc_id is None:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", None])
def test_query_against_brute_force(spark, tmp_path, folder):
    if folder is None:
        folder = str(tmp_path)
        rows = documents() + [(500 + i, t) for i, t in enumerate(cyclic_texts(3, 80))]
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, folder).collect() if r.doc_id is not None)
    wanted = []
    for i, text in docs:
        if i is None:
            continue
        w = planted(i, words_of(text))
        found = brute_runs(w)
        s, length, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        top = (s, length, q, 1000 * length // q) if found else (None,) * 4
        # What has no planted cycle keeps its words too.
        wanted.append((i, len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(brute_collapsed(w, found))))
    assert [tuple("" if x is None else x for x in r) for r in got] == sorted(tuple("" if x is None else x for x in r) for r in wanted)
    assert sum(r[1] > 0 for r in wanted) > 5
