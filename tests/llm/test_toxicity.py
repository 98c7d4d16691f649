"""Toxicity: nothing of a text or of the training rows is left out."""

import random

import numpy as np

from tidemark.llm import toxicity


def fitted(spark, rows):
    """The model of rows (doc_id, text, toxic) and what it predicts for each."""
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    return model, {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}


def right(rows, predicted):
    return [np.mean([predicted[i] == label for i, _, label in rows if label == k]) for k in (0, 1)]


def last_known(model, words):
    """Whether the model has the last event of each word."""
    out = []
    for w in words:
        own = toxicity.Spelled(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
        out.append(bool(model.look(toxicity.keyed(own.context[-1:], own.byte[-1:]))[1][0]))
    return out


def test_table_grows_and_events_do_not_meet(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=10))
    rows = [(i, " ".join([word() for _ in range(300)] * 2), int(i % 4 == 0)) for i in range(1200)]
    model, _ = fitted(spark, rows)
    assert len(model.keys) > 1 << 20
    counted = {x.doc_id for x in spark.range(1200).select(toxicity.F.col("id").alias("doc_id")).where(toxicity.fold().between(1, 3)).collect()}
    assert all(last_known(model, [rows[i][1].split()[-1] for i in counted]))
    assert not any(last_known(model, [word() for _ in range(2000)]))


def test_bytes_beyond_the_first_eight(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        words = ["abcdefgh" + r.choice(["one", "two", "three", "four"]) for _ in range(40)]
        if i % 4 == 0:
            words[r.randrange(40)] = "abcdefghzzz"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    assert min(right(rows, fitted(spark, rows)[1])) > 0.95


def test_text_without_spaces(spark):
    r = random.Random(5)
    signs = [chr(0x4E00 + i) for i in range(300)]
    rows = []
    for i in range(300):
        text = r.choices(signs, k=300)
        if i % 4 == 0:
            at = 100 + r.randrange(100)
            text[at : at + 4] = "龍龜龠龢"
        rows.append((i, "".join(text), int(i % 4 == 0)))
    assert min(right(rows, fitted(spark, rows)[1])) > 0.95


def brute(counted):
    """By class: the Kneser-Ney probability of a byte after a context, from (word, class) pairs."""
    depth, floor = toxicity.DEPTH, 1 / 256
    off = lambda c: 0 if c <= 0 else toxicity.DISCOUNT[min(c, 3) - 1]
    counts = [{}, {}]
    for word, k in counted:
        s = b" " + word + b" "
        for j in range(1, len(s)):
            e = s[max(0, j - depth) : j], s[j]
            counts[k][e] = counts[k].get(e, 0) + 1
    for n in range(depth - 1, -1, -1):
        for own in counts:
            left = {(c[1:], x) for c, x in own if len(c) == n + 1}
            before = {e: sum((bytes([b]) + e[0], e[1]) in own for b in range(256)) for e in left}
            own.update(before)
    pooled = {e: sum((bytes([b]), e[1]) in counts[0] or (bytes([b]), e[1]) in counts[1] for b in range(256)) for e in {e for own in counts for e in own if e[0] == b""}}

    def share(own, c, x, lower):
        after = {e: n for e, n in own.items() if e[0] == c}
        total = sum(after.values())
        if not total:
            return lower
        n = own.get((c, x), 0)
        return (n - off(n)) / total + sum(map(off, after.values())) / total * lower

    def p(k, c, x):
        return share(counts[k], c, x, p(k, c[1:], x) if c else share(pooled, b"", x, floor))

    return p


def test_kneser_ney_of_all_orders(spark):
    r = random.Random(6)
    words = [("".join(r.choices("abé", k=r.randrange(1, 13))).encode(), int(r.random() < 0.3)) for _ in range(150)]
    text = {k: b" ".join(w for w, c in words if c == k).decode() for k in (0, 1)}
    events = spark.createDataFrame([(text[k], k) for k in (0, 1)], "text string, toxic int").mapInArrow(toxicity._events, "context long, byte short, c0 long, c1 long")
    model = toxicity._model(events.groupBy("context", "byte").agg({"c0": "sum", "c1": "sum"}).toDF("context", "byte", "c0", "c1"))
    p = brute(words)
    asked = [w for w, _ in words[:8]] + [b"abab", b"qa", b"bbbbbbbbbbbbbbbb", "ééé".encode(), b"aqb"]
    got = toxicity.Spelled(np.frombuffer(b" ".join(asked), np.uint8), np.array([0, len(b" ".join(asked))]))
    ratios, sums = model.words(got), []
    for i in range(len(got.size)):
        sums.append(ratios[got.begin[i] : got.begin[i + 1]].sum())
    for i, w in enumerate(asked):
        s = b" " + w + b" "
        want = sum(np.log(p(1, s[max(0, j - toxicity.DEPTH) : j], s[j]) / p(0, s[max(0, j - toxicity.DEPTH) : j], s[j])) for j in range(1, len(s)))
        assert abs(sums[got.number[i]] - want) < 1e-4


def test_rows_that_the_curve_leaves_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 20)
    own = lambda i: f"n{''.join(chr(97 + int(d)) for d in str(i))}n"
    rows = [(i, f"plain words here {'grulp' if i % 4 == 0 else 'calm'} {own(i)} {own(i)}", int(i % 4 == 0)) for i in range(400)]
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").select("doc_id", toxicity.fold().alias("fold")).where("fold = 4").collect()
    model, _ = fitted(spark, rows)
    assert sum(last_known(model, [rows[x.doc_id][1].split()[-1] for x in ids])) >= len(ids) - 35


def test_scores_without_a_table_sent_are_the_same(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgé", k=r.randint(1, 60 if r.random() < 0.05 else 9)))
    rows = [(i, " ".join([word() for _ in range(r.randint(1, 60))] + ["grulp"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "grulp " * 30), (903, "the same")] + [(904, "the same")] * 3, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    score = lambda: sorted((x.doc_id, round(x.score, 9), x.predicted) for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    sent = score()
    monkeypatch.setattr(toxicity, "TABLE_EVENTS", 0)
    monkeypatch.setattr(toxicity, "PART_BYTES", 2000)
    assert score() == sent and len({x[1] for x in sent}) > 200
