"""Pieces, secrets, mixing, top-k, preferences and quality."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import documents, frame, key, words
from pyspark.sql import functions as F

from tidemark.llm import mixing, pieces, preferences, quality, secrets, topk

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
    MODEL = file.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "▁", "\t", "th", "e", "   ", "<s>", "\x00", "𠀀", "ing", "aa", "0", "1", "́", "</s>", "<0x41>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    return texts + ["a" * 3000, " " * 3000, "ab" * 2000, "\n" * 100, "".join(rng.choice("abcdefghij") for _ in range(9000)), "", " ", None]


def test_pieces_equal_the_library(spark):
    rows = documents() + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    encoded = pieces.encode(frame(spark, rows, clashing=True), MODEL)
    found = pieces.decode(encoded, MODEL).select("doc_id", "text", "ids", "decoded").collect()
    assert len(found) == len(rows)
    at_once = pieces.round_trip(frame(spark, rows, clashing=True).withColumn("a.b", F.lit(1)), MODEL).select("doc_id", "text", "ids", "decoded").collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, found))
    for r in found:
        ids = LIBRARY.encode(r.text or "")
        assert r.ids == ids, r.text
        assert r.decoded == LIBRARY.decode(ids)


def test_decoding_any_ids_equals_the_library():
    import codecs

    codecs.register_error("each_byte", pieces._each_byte)
    model, rng = pieces.PieceModel(MODEL), random.Random(3)
    lists = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randrange(12))] for _ in range(500)]
    flat = np.array([i for ids in lists for i in ids], np.int32)
    assert model.decode(flat, np.array([len(ids) for ids in lists])) == [LIBRARY.decode(ids) for ids in lists]


def test_merging_at_once_and_one_by_one_agree():
    model, rng = pieces.PieceModel(MODEL), random.Random(4)
    texts = ["▁" + "".join(rng.choice("theinga") for _ in range(rng.randrange(1, 25))) for _ in range(500)] + ["▁" * 77]
    ids, counts = model.merge_words(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        symbols = model.char_symbol[np.array([ord(c) for c in text])]
        assert model._agenda(np.arange(len(text)), symbols)[1].tolist() == ids[at : at + n].tolist()
        at += n


def test_no_documents_have_no_pieces(spark):
    none = frame(spark, []).limit(0)
    assert pieces.decode(pieces.encode(none, MODEL), MODEL).count() == 0
    assert pieces.round_trip(none, MODEL).count() == 0


def brute_spans(text):
    out = []
    rules = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]
    for order, (_, pattern, group, least) in enumerate(rules):
        out += [(m.start(), order, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(rules[o][0], s, e) for s, o, e in sorted(out)]


def secret_texts():
    rng = random.Random(6)
    parts = [
        "password", "PassWD", "secret", "token", "api_key", "APIKEY", "\"", "'", " ", ":", "=", "abc123", "short", "AKIA", "ABCDEFGHIJKLMNOP1234", "deadbeef",
        "0123456789abcdef", "\n", "é", "ſecret", "toKen", "日", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "x",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(600)] + [None, "", "AKIA" * 5, "f" * 24, "f" * 23]


def test_secrets_equal_a_full_scan(spark):
    rows = list(enumerate(secret_texts()))
    found = secrets.scan(frame(spark, rows, clashing=True).withColumn("a.b", F.lit(1))).select("text", "spans").collect()
    assert len(found) == len(rows)
    kinds = {"assign", "access", "hex"}
    for r in found:
        assert [tuple(s) for s in r.spans if s.kind in kinds] == brute_spans(r.text or "")
        whole = [(m.start(), m.end()) for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r.text or "")]
        assert [(s.start, s.end) for s in r.spans if s.kind == "private_key"] == whole
    assert secrets.scan(frame(spark, []).limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("ab") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("(abc|xyz)+?d*") == ("or", ("abc", "xyz"))
    assert secrets.trigram_query("(abc|x)y*") is True
    assert secrets.trigram_query("abc?d") == ("or", (("and", ("abc", "bcd")), "abd"))


def test_trigram_candidates_hold_every_match():
    rng = random.Random(8)
    patterns = ["foo(bar|ba[xyz])?q+", "(one|two)[0-9]{2,}three", "a.?b.?cdef", "(?:x(abc)+y|zzz)"]
    scanner = secrets.Scanner(tuple(secrets.Rule(str(i), p) for i, p in enumerate(patterns)))
    parts = ["foo", "bar", "bax", "q", "one", "two", "12", "three", "a", "b", "cdef", "x", "abc", "y", "zzz", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(800)]
    for text, spans in zip(texts, scanner.scan(texts), strict=True):
        assert sorted(spans) == sorted((str(i), m.start(), m.end()) for i, p in enumerate(patterns) for m in re.finditer(p, text))


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by the plain rule: share, stop at the caps, share what is left again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("counts", [{"a": 100, "b": 100, "c": 100, None: 50}, {"a": 3, "b": 5, "c": 400, "d": 2, "é": 30}, {"z": 4}, {"a": 0, "b": 9, None: 0}])
def test_mixing_meets_its_targets(spark, counts):
    rng = random.Random(9)
    rows = [(s, " ".join(words(rng, rng.randrange(1, 60)))) for s, n in counts.items() for _ in range(n)] + [(s, None) for s in counts]
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, size int, Copies string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = {s: sum(len((t or "").split()) for x, t in rows if x == s) for s in counts}
    wanted = filled(sizes)
    for s in counts:
        mine = [r for r in found if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(wanted[s])
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - wanted[s]) <= 60
        assert all(0 <= r.copies <= 3 for r in mine)
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in found}
    assert mixing.emit(mixing.mix(docs), ["doc_id"]).count() == sum(r.copies for r in found)


def test_copies_equal_a_plain_systematic_sampler(spark):
    """One running sum per source in the documented order, one offset, one copy for every integer crossed."""
    import math

    rng = random.Random(10)
    rows = [(i, " ".join(words(rng, int(rng.lognormvariate(3, 1)))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marked = docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("hash"), F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("name"))
    offset = (F.pmod(F.xxhash64(F.lit(17), F.lit("offset"), "name"), F.lit(2**40)) / float(2**40)).alias("offset")
    named = {r.doc_id: r for r in marked.select("doc_id", "hash", offset).collect()}
    got = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    targets = filled(sizes)
    for source, size in sizes.items():
        mine = []
        for i, text, s in rows:
            if s == source:
                n, h = len(text.split()), named[i].hash
                mine.append((int(math.log2(n + 1) * 8), (h >> 56) % 256, h, i, n))
        mine.sort()
        rate = targets[source] / size
        turns = []
        for turn in range(16):
            u = (named[mine[0][3]].offset + turn / 16) % 1.0
            copies = [math.floor((at + 1) * rate + u) - math.floor(at * rate + u) for at in range(len(mine))]
            turns.append((abs(sum(c * m[4] for c, m in zip(copies, mine, strict=True)) - targets[source]), u, copies))
        assert [got[m[3]] for m in mine] == min(turns)[2]


def test_mixing_awkward_rows(spark):
    rows = documents()
    found = mixing.mix(frame(spark, rows, clashing=True).withColumn("a.b", F.lit(1)))
    assert "a.b" in found.columns
    assert found.count() == len(rows)
    assert found.where("size is null or target is null or copies is null").count() == 0
    assert mixing.mix(frame(spark, []).limit(0)).count() == 0


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_k_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1, (700, 12))
    vectors[rng.random((700, 12)) < (0.7 if seed == 2 else 0)] = 0
    vectors[100:160] = vectors[100]  # ties
    if seed == 3:
        vectors = -np.abs(vectors)
    data = [(int(i), [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    odd = [(901, None, "x"), (902, [1.0, None], "x"), (903, [float("nan")] * 12, "x"), (904, [float("inf")] * 12, "x"), (905, [2.0, 3.0], "x"), (906, [], "x"), data[50]]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score string")
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in data + odd[4:]]
    found = topk.integer_vectors(table)
    hits = topk.top_k(found, found.where("key % 20 = 0"), 10).collect()
    assert sorted((r.query_id, r.rank, r.row_id, r.score) for r in hits) == brute_top(usable, list({i: (i, v) for i, v in usable if i % 20 == 0}.values()), 10)


def test_top_k_ranks_every_repeated_row(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (40, 6)))]
    parts = spark.sparkContext.parallelize(data * 3, 3)  # each partition holds every row once
    found = topk.integer_vectors(spark.createDataFrame(parts, "vec_id long, embedding array<double>"))
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in data]
    hits = topk.top_k(found, found.where("key % 20 = 0"), 10).collect()
    assert sorted((r.query_id, r.rank, r.row_id, r.score) for r in hits) == brute_top(usable * 3, [(i, v) for i, v in usable if i % 20 == 0], 10)


@pytest.mark.parametrize("kind", ["large", "sparse"])
def test_top_k_of_large_numbers_and_of_sparse_vectors(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3)
    monkeypatch.setattr(topk, "PROBED", 2)
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(0, 1, (500, 9)) * 2.0**19) if kind == "large" else np.round(rng.normal(0, 9, (500, 9)))
    if kind == "large":
        vectors[250:] = vectors[:250] + rng.integers(-1, 2, (250, 9)) / 1024  # scores beyond 2 ** 53 that differ by little
    else:
        vectors[rng.random((500, 9)) < 0.8] = 0
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    found = topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in data]
    hits = topk.top_k(found, found.where("key % 20 = 0"), 10).collect()
    assert sorted((r.query_id, r.rank, r.row_id, r.score) for r in hits) == brute_top(usable, [(i, v) for i, v in usable if i % 20 == 0], 10)


def test_top_k_of_few_or_no_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "vec_id long, embedding array<float>")
    found = topk.integer_vectors(rows)
    assert [(r.query_id, r.rank, r.row_id, r.score) for r in topk.top_k(found, found.where("key = 0")).collect()] == [(0, 1, 1, 1024 * 512 - 2048 * 1024)]
    none = found.where("false")
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(found, none).count() == 0


def test_preference_pairs(spark):
    a, b = [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no"), ("user", "ok"), ("assistant", "bye é")]
    rows = [(1, a, b), (2, a, a), (3, None, a), (4, [("user", "x")], a), (5, None, None)]
    turns = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(rows, f"pair_id long, chosen {turns}, rejected {turns}").withColumn("prompt", F.lit("clash"))
    df = df.withColumns({"__c": F.lit("c"), "__n": F.lit("n"), "__rr": F.lit("r"), "a.b": F.lit("d")})
    first = preferences.format_pairs(df).first()
    assert (first["__c"], first["__n"], first["__rr"], first["a.b"]) == ("c", "n", "r", "d")
    got = {r.pair_id: r for r in preferences.format_pairs(df).collect()}
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n"
    assert one.chosen == "<|assistant|>\nyes<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_loss] == ["yes<|end|>"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_loss] == ["no<|end|>", "bye é<|end|>"]
    assert (got[2].n_prompt_turns, got[2].same, got[2].chosen, got[2].chosen_loss) == (2, True, "", [])
    assert (got[3].prompt, got[3].chosen, got[3].same) == ("", "", False)
    assert (got[4].n_prompt_turns, got[4].prompt) == (0, "")
    assert got[5].same


def test_answer_swaps_take_the_next_answer(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "more"), (2, 0, "user", None), (3, 0, None, "x"), (3, 1, "assistant", "a3"), (3, 1, "assistant", "a3"), (None, 0, "assistant", "n"), (70, 0, "assistant", "far")]
    got = {r.pair_id: r for r in preferences.answer_swaps(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 3, None, 70}
    assert (got[1].donor_id, got[1].rejected[-1].text, len(got[1].chosen)) == (3, "a3", 2)
    assert (got[3].donor_id, len(got[3].chosen)) == (1, 3)
    assert got[70].donor_id == 70 and got[70].chosen == got[70].rejected
    assert preferences.answer_swaps(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def rated(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        w, kind = words(rng, rng.randrange(30, 200)), i % 3
        if kind == 0:
            w = [x + rng.choice(["&&&", "***"]) for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        if kind == 1:
            for bad in ("nasty", "vile"):
                w.insert(rng.randrange(len(w)), bad)
        out.append((i, " ".join(w), kind))
    return out


def test_quality_on_held_out_documents(spark):
    train, test = rated(900, 1), rated(300, 2)
    docs = frame(spark, [(i, t) for i, t, _ in train])
    ratings = spark.createDataFrame([(i, g) for i, _, g in train] + [(None, 1), (5, None), (6, 9), (10**9, 1)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, 3)
    scored = quality.score(frame(spark, [(i, t) for i, t, _ in test], clashing=True), model)
    got = {r.doc_id: r for r in scored.collect()}
    right = [(got[i].tail >= 0.5) == (g == 2) and abs(got[i].expected_grade - g) < 0.7 for i, _, g in test]
    assert np.mean(right) > 0.97
    assert model.thresholds[0] < model.thresholds[1]
    again = quality.fit(docs.repartition(7), ratings, 3)
    assert np.array_equal(again.weights, model.weights)


def test_quality_without_ratings_or_texts(spark):
    docs = frame(spark, [(1, None), (2, "")])
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert quality.fit(docs, none, 3) is None
    scored = quality.score(docs, None)
    assert scored.where(quality.keep_clean(scored)).count() == 2
    model = quality.fit(frame(spark, [(i, t) for i, t, _ in rated(60, 3)]), spark.createDataFrame([(i, g) for i, _, g in rated(60, 3)], "doc_id long, grade int"), 3)
    assert quality.score(docs, model).count() == 2
    assert quality.score(frame(spark, []).limit(0), model).count() == 0
    assert key(None) < 0
