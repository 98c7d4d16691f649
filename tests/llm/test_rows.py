"""Operators that look at one row at a time, and models, against brute force and held-out rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import digest, kernel, langid, licenses, pages, repetition, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(t):
    w = WORD.findall(t)
    n = len(w)
    seen, rep = {}, set()
    for i in range(n - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            rep.update(x for i in at for x in (i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    held = {x for i, k in enumerate(longest) if k >= repetition.LEAST_WORDS for x in range(i, i + k)}
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(held), max(longest, default=0)


def test_repetition_matches_brute_force():
    r = random.Random(3)
    texts = ["", "a", "a " * 30, "x\n\nx\nx \n", "é é é\r\n é é é ", "\n\n", "<|> a"] + [" ".join(r.choice("abcde\n") for _ in range(r.randint(0, 70))) for _ in range(150)]
    body, offsets = kernel.utf8(pa.array(texts))
    m = repetition.measures(body, offsets)
    assert [tuple(int(m[c][i]) for c in repetition._COLUMNS) for i in range(len(texts))] == [brute_measures(t) for t in texts]


def test_quality_rows(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, clean, "x"), (2, None, "y"), (3, "", "z"), (4, "again and again it says so " * 20, "u")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.quality(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False)}
    assert repetition.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests():
    r = random.Random(4)
    texts = ["", "ab", "abc"] + ["".join(r.choice("abcdef gh") for _ in range(r.randint(1, 900))) for _ in range(30)]
    prints = digest.of_texts(texts)
    assert (digest.likeness(prints, prints) == 1).all() and (digest.of_texts(texts[::-1])[::-1] == prints).all()
    pairs = digest.likeness(prints, prints[::-1])
    assert ((pairs >= 0) & (pairs <= 1)).all() and np.allclose(pairs, digest.likeness(prints[::-1], prints))


@pytest.mark.parametrize("part_bytes", [200, 1 << 24])
def test_neighbours(spark, part_bytes):
    r = random.Random(5)
    rows = [(i * 3, "".join(r.choice("abé \n") for _ in range(r.randint(0, 60)))) for i in range(50)] + [(500, None)]
    got = {x.doc_id: x for x in digest.neighbour_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), part_bytes).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        mine, changed, following = digest.of_texts([text, digest.edited(text, after), after])
        assert got[i].n_chars == len(text) and got[i].fingerprint == mine.tobytes().hex() and got[i].edited_fingerprint == changed.tobytes().hex()
        assert got[i].near_next == pytest.approx(digest.likeness(mine[None], following[None])[0])


def test_neighbours_of_few(spark):
    schema = "doc_id long, text string"
    assert digest.neighbour_report(spark.createDataFrame([], schema)).count() == 0
    assert digest.neighbour_report(spark.createDataFrame([(1, "abcd")], schema)).first().near_next == 1.0
    assert digest.neighbour_report(spark.createDataFrame([(1, "abcd"), (1, "abcd"), (None, None)], schema)).count() == 3


def test_extraction():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<!-- <script> --><div class="cookie-notice">We use the cookies of this site and that is it</div><article><h1>A &amp; B</h1><p>The text of\n this   article is &eacute;asy to read and it is long enough '
        'for the rules to be sure that it is the main one of all.<p>Short one.</article><aside>Look at the other things</aside><section id="comments"><p>This is the comment of a reader and it is as long as '
        "the article is, so that only its place tells what it is and what it is not.</p></section><footer>&copy; x</footer></body></html>"
    )
    assert pages.main_text(page).split("\n") == ["A & B", "The text of this article is éasy to read and it is long enough for the rules to be sure that it is the main one of all.", "Short one."]
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<p></p>") == ""
    assert pages.main_text("<article><p>One <b>bold</b> word<br>and more &#65;&#x42;</p>") == "One bold word\nand more AB"


LONG = "The text of this article is one that is long enough for the rules to be sure of it, and it has the words that such a text has in it, so that it stays."


@pytest.mark.parametrize("names", ["no-sidebar", "has-sidebar content", "main side", "post widget", "page-header", "single-post legal", "newsletter", "layout"])
def test_articles_in_named_wrappers(names):
    assert pages.main_text(f'<body><div class="{names}"><nav>Menu</nav><article><p>{LONG}</p></article></div></body>') == LONG
    assert pages.main_text(f'<form id="{names}"><div class="{names}"><main><p>{LONG}</p></main></div></form>') == LONG


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><header><h1>Title</h1></header><p>Hello there</p></article>", "Title\nHello there"),
        (f'<article><div class="post-header"><h2>Head</h2></div><p class="legal">{LONG}</p></article>', f"Head\n{LONG}"),
        ("<article><p>When a < b then the sum", "When a < b then the sum"),
        (f"<article><p><a title=it's href=x>one</a> {LONG}</p></article>", f"one {LONG}"),
        (f'<article><p>{LONG}</p><div class="ad">Buy this</div><p>Short one</p></article>', f"{LONG}\nShort one"),
        (f'<article><p>{LONG}</p></article><div id="comments"><article class="comment-body"><p>{LONG}</p></article></div>', LONG),
        (f'<article><p>{LONG}</p><article class="comment"><p>{LONG}</p></article></article>', LONG),
        (f'<article class="post category-ads tag-social"><p>{LONG}</p></article><aside><article>{LONG}</article></aside>', LONG),
        (f'<body><div class="cookieBar">{LONG}</div><div class="site-nav">{LONG}</div><div class="comment-list">{LONG}</div><p>{LONG}</p></body>', LONG),
        ("<article><p>5 > 3 &lt;b&gt; 2</p></article>", "5 > 3 <b> 2"),
    ],
)
def test_pages_keep_their_articles(page, text):
    assert pages.main_text(page) == text


def test_two_passes_match_a_plain_version():
    r = random.Random(9)

    def nearest(labels, found, k, step):
        j = k + step
        while 0 <= j < len(found):
            if found[k][4]:
                if found[j][4] and labels[j] in ("good", "bad"):
                    return labels[j]
            elif labels[j] in ("good", "bad", "noise"):
                return "bad" if labels[j] == "noise" else labels[j]
            j += step
        return None

    for _ in range(400):
        texts = [LONG, "the word and the other", "Menu entry", "x" * 150, "Nothing in particular was said by anyone else here, nowhere"]
        found = [(r.choice(["p", "h2", "div"]), r.choice(texts), r.random() < 0.2, r.choice([0, 0, 200]), r.random() < 0.5) for _ in range(r.randint(0, 9))]
        labels = [pages.first_pass(b) for b in found]
        second = list(labels)
        for k, x in enumerate(labels):
            if x == "near" and (found[k][4] or len(found[k][1]) >= pages.LENGTH_HIGH or "good" in (nearest(labels, found, k, -1), nearest(labels, found, k, 1))):
                second[k] = "good"
        want = []
        for k, x in enumerate(second):
            sides = nearest(second, found, k, -1), nearest(second, found, k, 1)
            if x in ("good", "bad", "noise"):
                want.append(x == "good")
            elif found[k][4]:
                want.append("good" in sides or sides == (None, None))
            else:
                want.append(sides[1] == "good" if x == "heading" else sides == ("good", "good"))
        assert pages.classify(found) == want


def test_extract_rows(spark):
    rows = [(1, "u", "<article>hello</article>", 5), (2, None, None, 6)]
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()}
    assert got == {1: ("hello", 5), 2: ("", 0)}


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses._UP, licenses._LOW)))
    joined = " " + " ".join(words) + " "
    spans = []
    for rule, label, keyword, score, priority, pattern in licenses.rules():
        if " " + keyword in joined:
            for m in re.finditer(f" ({pattern})(?= )", joined):
                first = joined[: m.start() + 1].count(" ") - 1
                spans.append((first, first + m[1].count(" "), priority, rule, label, score))
    holds = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))
    stand = [d for d in spans if not any(e is not d and holds(e, d) for e in spans)]
    base = [d for d in spans if d[3] < len(licenses.BASE)]
    return (
        len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
        ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in base} | {d[4] for d in stand})), max((d[5] for d in stand), default=0.0),
    )


def test_scan_matches_brute_force(spark):
    r = random.Random(6)
    parts = ["mit", "license", "Apache", "License,", "gnu", "general", "public", "version", "2.0", "3", "spdx-license-identifier:", "MIT", "licensed", "under", "the", "BSD", "été", "bsd-3-clause", "All rights reserved", "x", "\n"]
    texts = [None, "", "MIT License", "mit license", "İ MIT LICENSE K", "mit license mit license"] + [" ".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(150)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == brute_scan(t), t
    assert len(licenses.rules()) > 200


NOTICES = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0-or-later",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "see http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
    "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary",
    "The Software shall be used for Good, not Evil.": "json",
    "A hundred good reasons to read on": "",
}


def test_notices(spark):
    got = {x.text: x.labels for x in licenses.scan(spark.createDataFrame([(t,) for t in NOTICES], "text string")).collect()}
    assert got == NOTICES and len(licenses.SENTENCES) > 100


def test_every_rule_passes_the_gate(spark):
    rows = [(k, f"x {r[2]} y") for k, r in enumerate(licenses.rules()) if r[2] in {s[1] for s in licenses.SENTENCES}]
    assert spark.createDataFrame(rows, "k int, text string").where(~licenses.F.col("text").rlike(licenses.gate())).count() == 0


LANGS = {"aa": ["ba", "do", "ki", "lum"], "bb": ["xer", "quo", "vi", "za"]}


def labelled(n=300):
    r = random.Random(7)
    rows = []
    for i in range(n):
        lang = r.choice(list(LANGS))
        words = ["".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(40)] = r.choice(["grulp", "snarfy"])
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def test_language_held_out(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=50)
    odd = spark.createDataFrame([(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, "δ", None)], docs.schema)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(odd), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows]) > 0.99
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in LANGS and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(spark.createDataFrame([], docs.schema)) is None
    assert langid.identify(odd, None).first().lang_pred == "und"


def test_toxicity_held_out(spark):
    rows = labelled()
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[r[0]].predicted == r[3] for r in rows]) > 0.95
    assert got[900].predicted == got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.score(docs, None).first().score == 0
