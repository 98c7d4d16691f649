"""Folds and prose against plain versions of their own."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import prose, similarity


def plain_fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def plain_fold(calls):
    """(call, kind, ref) of a session's calls (number, text), remembering all that was recorded."""
    recorded, out = [], []
    for number, text in calls:
        lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else []
        body = "\n".join(lines).encode()
        words = text.split()
        sketch = set(sorted({plain_fnv(" ".join(words[i : i + 3]).encode()) for i in range(len(words) - 2)})[:96])
        window = recorded[-16:]
        same = [n for n, b, _ in window if b == body] if len(lines) >= 2 else []
        if same:
            out.append((number, "exact", same[0]))
            continue
        near = []
        for n, b, s in window:
            if len(lines) >= 6 and sketch and s and min(len(b), len(body)) >= 0.8 * max(len(b), len(body)):
                near.append((len(sketch & s) / len(sketch | s), -n))
        best = max(near, default=(0, 0))
        if best[0] >= 0.85:
            out.append((number, "similar", -best[1]))
        else:
            out.append((number, None, None))
            recorded.append((number, body, sketch))
    return out


def test_fold_of_random_calls(spark):
    r = random.Random(2)
    bases = ["\n".join(" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(6)) for _ in range(r.randint(1, 30))) for _ in range(25)]

    def text():
        lines = r.choice(bases).split("\n")
        for _ in range(r.choice([0, 0, 1, 3])):
            lines[r.randrange(len(lines))] = f"edited {r.randint(0, 5)} here"
        return "\n".join(lines) + r.choice(["", "\n"])

    calls = [(s, n, text()) for s in range(4) for n in range(1, 80)] + [(9, 1, ""), (9, 2, ""), (9, 3, None)]
    found = similarity.redundancy_fold(spark.createDataFrame(calls, "s long, c long, t string").repartition(3), "s", "c", "t")
    got = {(x.session, x.call_n): (x.hit_kind, x.ref) for x in found.collect()}
    want = {(s, n): (k, ref) for s in {c[0] for c in calls} for n, k, ref in plain_fold([(n, t or "") for x, n, t in calls if x == s])}
    assert got == want and {k for k, _ in want.values()} == {"exact", "similar", None}


def plain_prose(text, locale, ultra):
    """The rules one after the other, character by character."""
    out, fenced = [], False
    for line in text.split("\n"):
        bare = line.lstrip()
        fence = bare.startswith("```")
        keep = fenced or fence or (bare.startswith("|") and "|" in bare[1:]) or not bare or bare.startswith(("#", "<!--", ">", "---", "==="))
        fenced ^= fence
        out.append(line if keep else plain_line(line, locale, ultra))
    kept = []
    for line in out:
        if line.strip() or not kept or kept[-1] != "":
            kept.append(line if line.strip() else "")
    return "\n".join(kept)


def plain_line(line, locale, ultra):
    rest = line.lstrip()
    lead = line[: len(line) - len(rest)]
    digits = len(rest) - len(rest.lstrip("0123456789"))
    if rest[:2] in ("- ", "* ", "+ "):
        lead, rest = lead + rest[:2], rest[2:]
    elif digits and rest[digits : digits + 2] in (". ", ") "):
        lead, rest = lead + rest[: digits + 2], rest[digits + 2 :]
    done, span, i = lead, "", 0
    while i < len(rest):
        end = None
        if rest[i] == "`":
            close = rest.find("`", i + 1)
            end = len(rest) if close < 0 else close + 1
        elif rest.startswith(("http://", "https://"), i):
            end = i
            while end < len(rest) and not rest[end].isspace() and rest[end] not in ')]">':
                end += 1
        if end is None:
            span, i = span + rest[i], i + 1
            continue
        done, span, i = done + plain_span(span, locale, ultra) + rest[i:end], "", end
    return (done + plain_span(span, locale, ultra)).rstrip(" \t")


def plain_span(span, locale, ultra):
    if not span.strip():
        return span
    text = span
    for phrase in locale.phrases:
        while (at := text.lower().find(phrase)) >= 0:
            text = text[:at] + text[at + len(phrase) :].lstrip(" ")
    gone = {*locale.fillers, *locale.articles, *locale.hedges}
    made, gap, word = "", False, ""
    for c in text + " ":
        if not c.isspace():
            word += c
            continue
        if word:
            core = word.rstrip(",.;:!?")
            if not (core.lower() in gone and all(x.isalnum() or x == "'" for x in core)):
                made += (" " if gap else "") + word
            word, gap = "", False
        gap = True
    for c in locale.conjunctions:
        if made.lower().endswith(c):
            made = made[: -len(c)].rstrip()
            break
    head = made[: len(made) - len(made.lstrip())]
    made = head + made.lstrip().lstrip(",;: ").lstrip()
    i, clean = 0, ""
    while i < len(made):
        three = made[i : i + 3]
        if three in (" , ", " ; "):
            clean, i = clean + " ", i + 3
        elif three[1:] in (" ,", " ;") and three[0] in ".!?":
            clean, i = clean + three[:2], i + 3
            while made[i : i + 1] == " ":
                i += 1
        else:
            clean, i = clean + made[i], i + 1
    if ultra:
        for long, short in locale.substitutions:
            i, parts = 0, ""
            while i < len(clean):
                before, after = clean[i - 1 : i] if i else "", clean[i + len(long) : i + len(long) + 1]
                word = lambda c: c.isalnum() or c == "_"
                if clean[i : i + len(long)].lower() == long and not word(before) and not word(after):
                    parts, i = parts + short, i + len(long)
                else:
                    parts, i = parts + clean[i], i + 1
            clean = parts
    if span.startswith(" ") and not clean.startswith(" "):
        clean = " " + clean
    return clean + " " if span.endswith(" ") and not clean.endswith(" ") else clean


WORDS = ["the", "The", "a", "just", "really,", "perhaps", "and", "or", "with", "function", "because", "article", "of course", "please note that", "in general,", "`the code`", "https://a.b/the-x", "x_the", "it's", ", so", "done.", "ok;", "o", "do", "talvez", "você", "função", "com certeza", "para", "em geral", "e", "  "]


@pytest.mark.parametrize("locale", ["en", "pt-BR"])
@pytest.mark.parametrize("ultra", [False, True])
def test_prose_of_random_texts(locale, ultra):
    r, words = random.Random(4), prose.LOCALES[locale]
    for _ in range(1500):
        lines = [r.choice(["", "", "- ", "12. ", "  ", "# ", "| ", "> ", "```"]) + " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9))) + r.choice(["", " |", " "]) for _ in range(r.randint(1, 6))]
        text = "\n".join(lines)
        assert prose.compress_text(text, words, ultra) == plain_prose(text, words, ultra), text


def test_unsafe_texts_stay(spark):
    rows = [(1, "# A\n\nthe text and the rest"), (2, "the a an the a an the a an the a an the a an x"), (3, None)]
    got = {x.i: (x.out, x.safe) for x in prose.safely_compressed(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    assert got == {1: ("# A\n\n text and rest", True), 2: (rows[1][1], False), 3: (None, None)}


def test_prompt_budget(spark):
    rows = [(1, "short"), (2, "the " * 300 + "end"), (3, "word " * 300), (4, None)]
    docs = spark.createDataFrame(rows, "i int, t string")
    got = {x.i: x.t for x in prose.prompt_budget(docs, "t", 100).collect()}
    assert got[1] == "short" and got[4] is None and len(got[3]) == 400 and got[3].endswith("[... cut]") and len(got[2]) <= 400
    assert prose.prompt_budget(docs, "t", 0).count() == 4


def test_links_and_integrity(spark):
    rows = [("see https://a.b/x?to=http://c.d, (http://e.f) end", 2), ("no link", 0)]
    got = [(x.n, x.m) for x in spark.createDataFrame(rows, "t string, m int").select(prose.links(F.col("t")).alias("n"), "m").collect()]
    assert all(a == b for a, b in got)
