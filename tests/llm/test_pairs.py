"""N-gram Jaccard join and substring dedup against brute force."""

import hashlib
import random
import re

from tidemark.llm import ngram, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1):
    """Texts with exact copies, near copies of every degree, shared passages, short and empty ones, and nulls."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    base, passage = say(120), say(30)
    out = []
    for _ in range(60):
        near = list(base)
        for _ in range(r.randint(0, 12)):
            near[r.randrange(len(near))] = r.choice(words)
        out.append(" ".join(near))
    out += [" ".join(base)] * 15 + [" ".join(passage + say(r.randint(0, 60))) for _ in range(40)]
    out += [" ".join(say(r.randint(1, 200))) for _ in range(30)] + ["", None, " \n\t", "one", "One", "a b c", "A  B\nC", "a b c d", "x " * 50, "é É", "x\x00y z q r", "  lead and trail  "]
    r.shuffle(out)
    return list(enumerate(out))


def grams(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_classes(rows, n, percent):
    sets = {i: grams(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram, "CROWD", 8)  # so that n-grams of a small table count as frequent
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, n double").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram.classify(docs, 4, 85).collect()}
    assert got == brute_classes(rows, 4, 85)


def test_classes_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert ngram.classify(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f"), (3, None), (4, "")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram.classify(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, -1), (3, 3), (4, 4), (7, 7), (7, 7), (9, 7)]


def brute_kept(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[i] = (w, gone)
    return out


def test_substrings_match_brute_force(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_digest(docs, 20).collect()}
    want = brute_kept(rows, 20)
    assert got == {i: (len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, (w, g) in want.items()}


def test_substrings_leave_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"Start here.\n{passage}\nend  of one", "x"), (2, f"Other\ttext\n\n{passage}\n\nfinal line", "y"), (3, None, None), (4, "short", "z"), (None, passage, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    got = {r.doc_id: (r.text, r.n_removed) for r in substring.dedup_substrings(docs, 50).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == (None, 0) and got[4] == ("short", 0) and got[None] == (passage, 0)
    assert got[2] == ("Other\ttext\n\nfinal line", 60)
    assert substring.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_difference_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substring.cover_for(20) == (13, (0, 1, 3, 9), 8)
