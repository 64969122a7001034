"""Documents with everything that is awkward, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random

NO_ID = -(2**63)
BLANKS = " \t\n\x0b\f\r"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


def documents(seed=1, n=60):
    """(doc_id, text): nulls, empties, repeated rows, copies in other case, near copies, shared lines and passages."""
    rng = random.Random(seed)
    shared = ["Shared LINE number %d that is long enough to count for the rule" % i for i in range(3)]
    passage = " ".join(words(rng, 60))
    rows = []
    for i in range(n):
        body = [" ".join(words(rng, rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            body.insert(0, "  " + shared[i % 2].upper() + "\t")
        if i % 4 == 0:
            body.append(shared[2])
            body.append(shared[2])
        if i % 5 == 0:
            body[0] = body[0] + " é " + passage + " ß"
        rows.append((i, "\n".join(body)))
    texts = dict(rows)
    rows += [(100 + i, texts[i].upper()) for i in range(4)]
    for i in range(8):
        changed = (texts[5] + "\n" + texts[9] + "\n" + texts[10]).split(" ")
        changed[3 + i] = "other%d" % i
        rows.append((200 + i, " ".join(changed)))
    rows += [
        (300, None), (301, ""), (302, None), (303, " \n\t "), (304, "one"), (305, "one two"), (306, "ONE two"), (307, "a" * 260),
        (308, "ab" * 130), (309, "\n" * 120), (310, "日本語 テキスト " * 20), (None, texts[5]), (None, "no id at all"), (3, texts[3]), (3, texts[3]),
        (4, "another text of a repeated id " + passage), (311, "x " * 3000 + passage + " y" * 3000),
    ]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, *, clashing=False):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", [None, "a", "b", "é"][(i or 0) % 4], len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, schema).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        for name in ("key", "row", "node", "size", "target", "copies", "n_lines", "n_dropped", "ids", "spans", "tail", "kept", "__key", "Component"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def key(doc_id):
    return NO_ID if doc_id is None else doc_id


def deduped_lines(rows, min_chars=40, min_documents=5):
    holders = {}
    split = [(key(i), (t or "").split("\n")) for i, t in rows]
    norm = lambda line: lowered(line.strip(BLANKS))
    for i, lines in split:
        for line in lines:
            holders.setdefault(norm(line), set()).add(i)
    out = []
    for i, lines in split:
        stay = [x for x in lines if len(norm(x)) < min_chars or len(holders[norm(x)]) < min_documents or i == max(holders[norm(x)])]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out)


def shingle_sets(rows, width):
    out = []
    for i, t in rows:
        w = lowered(t).encode().split()
        n = min(width, len(w))
        out.append((key(i), {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()))
    return out


def near_components(rows, width, percent):
    sets = shingle_sets(rows, width)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def repeats_removed(rows, order, length=100):
    """order: text hash by text, for rows of one id."""
    unique = sorted({(key(i), order[t or ""], t or "") for i, t in rows})
    seen, out = set(), {}
    for i, _, t in unique:
        data, cover = t.encode(), bytearray(len(t.encode()))
        for p in range(len(data) - length + 1):
            piece = data[p : p + length]
            if piece in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(piece)
        runs = sum(1 for p in range(len(data)) if cover[p] and (p == 0 or not cover[p - 1]))
        out[i, t] = (len(data), sum(cover), runs, sha(bytes(b for b, c in zip(data, cover, strict=True) if not c)))
    return sorted((key(i), *out[key(i), t or ""]) for i, t in rows)
