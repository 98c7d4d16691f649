"""Mixing, packing and the pipeline: plain versions and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, packing, spread
from tidemark.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    want, left = {}, {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}
    cap, total = {"a": 30, "b": 3000, "c": 1500, "z": 0, None: 120}, 1550
    while left:  # fill by weight until none is above its cap
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > cap[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = cap[s]
            total -= cap[s]
            del left[s]
    assert got == pytest.approx(want)


def test_draw(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randint(0, 30)), r.choice("aaab")) for i in range(400)] + [(900, None, None), (901, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.draw(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.draw(docs.repartition(5)).collect()))
    for source in "ab":
        own = [x for x in got if x.doc_id < 900 and rows[x.doc_id][2] == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 60 and all(x.taken <= 3 * x.size for x in own)
    out = [x.doc_id for x in mixing.mixed(docs).collect()]
    assert {i: out.count(i) for i in set(out)} == {x.doc_id: x.copies for x in got if x.copies}
    assert mixing.draw(docs.limit(0)).count() == 0


def test_tokens_equal_the_tokenizer():
    encoder, r = Encoder(PATH), random.Random(9)
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'ll", "1", "!", "é", " ", "\t", " '", "z", "ve", "日", "😀", "<|endoftext|>", "'S", "’s", "\r\n", "_"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000))]
    ids, bounds = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == encoder.whole(texts)


def test_best_fit_and_bounds():
    r = random.Random(10)
    for _ in range(200):
        lengths = np.array([r.randint(1, 100) for _ in range(r.randint(0, 60))], np.int64)
        bins, offsets, free = packing.best_fit(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(free) and (free >= 0).all() and sum(lengths) == 100 * len(free) - sum(free)
        for b in range(len(free)):
            at = np.argsort(offsets[bins == b])
            own, place = lengths[bins == b][at], offsets[bins == b][at]
            assert (place == np.cumsum(own) - own).all() and own.sum() <= 100
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.array([], np.int64)) == 0


def check_packing(docs, got, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    by, bins = {}, {}
    for p in got:
        by.setdefault(p.doc_id, []).append(p)
        bins.setdefault(p.sequence_id, []).append(p)
    for i, text in docs:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for k, p in enumerate(sorted(by[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and (p.length == capacity or k == 0)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(bins)


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 40)  # several parts, which exchange pieces
    r = random.Random(11)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat,", "on"]) for _ in range(r.randint(0, 90)))) for i in range(150)] + [(500, None), (501, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 64).collect()
    used = check_packing(rows, got, 64)
    assert used <= 1.03 * packing.lower_bound(np.array([p.length for p in got]), 64) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_components(spark):
    r = random.Random(12)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in spread.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root) and spread.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(13)
    say = lambda n: " ".join("".join(r.choice(["ba", "do", "ki", "lu", "xe"]) for _ in range(2)) + str(r.randrange(50)) for _ in range(n))
    passage, base = say(60), say(100)
    texts = [say(60) for _ in range(120)] + [base, base, base.replace(base.split()[5], "changed"), f"{say(20)} {passage}", f"{passage} {say(20)}", None, ""]
    texts = [f"{t} grulp snarfy grulp" if i % 5 == 1 and i < 120 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names, kept = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = {x.doc_id: x.text for x in kept.collect()}
    toxic = {i for i in range(120) if i % 5 == 1}
    assert len(toxic & set(seen["toxicity"])) <= 2 and set(range(120)) - toxic <= set(seen["toxicity"])
    assert 120 in seen["ngram_jaccard_join"] and 121 not in seen["ngram_jaccard_join"] and 122 not in seen["ngram_jaccard_join"]
    assert passage in seen["substring_dedup"][123] and passage.split()[30] + " " + passage.split()[31] not in seen["substring_dedup"][124]
    rows = [(x.doc_id, x.text) for x in kept.dropDuplicates(["doc_id"]).collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept.dropDuplicates(["doc_id"]), str(tmp_path)).collect()
    check_packing(rows, packed, 2048)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
