"""Economy, sessions, redundancy, prose and configuration on small vectors."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import economy, extract, prose, sessions, similarity
from tidemark.sources import events as sources


def test_config():
    c = config.parse("max_lines = 7\n# x\nbogus = 1\ndedup_min = nope\nadaptive_intensity = false\nbypass = [a, b c]")
    assert (c.max_lines, c.dedup_min, c.adaptive_intensity, c.bypass) == (7, 2, False, ("a", "b c"))
    assert config.Config().budget == 112_500
    ultra = config.scaled(config.Config(max_lines=10), "ultra")
    assert ultra.max_lines == 20 and ultra.dedup_min == 2 and config.scaled(config.Config(), "full").max_lines == 72


@pytest.mark.parametrize(("used", "tier"), [(0, "full"), (73_124, "full"), (73_125, "ultra")])
def test_tier(spark, used, tier):
    assert spark.createDataFrame([(used,)], "u long").select(economy.tier(F.col("u"), config.Config())).first()[0] == tier


@pytest.mark.parametrize(("n", "used", "left"), [(2, 0, None), (3, 0, 109), (3, 100_000, 9), (3, 200_000, 0)])
def test_burn(spark, n, used, left):
    rows = [(1, i, 1000) for i in range(n)]
    calls = spark.createDataFrame(rows, "s long, c long, tokens long")
    got = economy.burn(calls, "s", "c", 112_500 - used).orderBy(F.col("c").desc()).first()
    assert got.remaining == (None if left is None else max(left, 0))


def test_efficiency(spark):
    row = spark.createDataFrame([(1000, 500, 0, 50_000, 5, 10)], "total_in long, total_out long, agent_tokens long, total_tokens long, hits long, calls long")
    got = economy.efficiency(row, 150_000).first()
    assert got.compression_ratio_bp == 5000 and got.tool_choice_efficiency_bp == 10_000 and got.context_reuse_rate_bp == 5000 and abs(got.overall_bp - 6833) <= 1


def test_validity_and_retention(spark):
    rows = spark.createDataFrame([(1, 100, 200, 100)], "id int, valid_from long, valid_to long, ts long")
    assert [sessions.valid_at(rows, F.lit(t)).count() for t in (150, 199, 200, 99)] == [1, 1, 0, 0]
    old = spark.createDataFrame([(1, 0, 10), (2, 0, 20), (3, 0, 999_990), (4, 0, 999_999), (5, 0, 0)], "id int, valid_to long, ts long")
    assert sorted(r.id for r in sessions.retained(old, F.lit(1_000_000), 1).collect()) == [3, 4, 5]


def test_finalize(spark):
    rows = [
        (1, 1, "cargo build", 10, 4, ["a.py"], [], ["ab12cd3 x"], ""), (1, 2, "cargo test", 10, 4, ["b.py", "a.py"], [], [], "test result: ok. 3 passed; 0 failed"),
        (2, 1, "pytest", 5, 5, [], ["error: x"], [], "test result: FAILED. 1 failed"),
    ]
    df = spark.createDataFrame(rows, "s long, o long, cmd string, in_tk long, out_tk long, files array<string>, errors array<string>, git array<string>, test_summary string")
    got = {r.s: r for r in sessions.finalize(df, "s", "o").collect()}
    assert got[1].completed == ["build OK: cargo build", "test result: ok. 3 passed; 0 failed"] and got[1].investigated == ["a.py", "b.py"] and got[1].learned == ["git:ab12cd3"]
    assert got[2].next_steps == ["test result: FAILED. 1 failed"] and got[2].learned == ["error: x"] and got[2].completed == []


def test_redundancy_fold(spark):
    text = "\n".join(f"line {i} of the output here" for i in range(30))
    edited = text.replace("line 7 of", "line 7 at")
    short = "x\ny"
    calls = [(1, 1, text), (1, 2, text), (1, 3, edited), (1, 4, short), (1, 5, short), (1, 6, "one"), (1, 7, "one"), (2, 1, text)]
    got = {(r.session, r.call_n): (r.hit_kind, r.ref) for r in similarity.redundancy_fold(spark.createDataFrame(calls, "s long, c long, t string"), "s", "c", "t").collect()}
    assert got == {(1, 1): (None, None), (1, 2): ("exact", 1), (1, 3): ("similar", 1), (1, 4): (None, None), (1, 5): ("exact", 4), (1, 6): (None, None), (1, 7): (None, None), (2, 1): (None, None)}


def test_prose():
    en = prose.LOCALES["en"]
    assert prose.compress_text("In general, the article is just a test and", en) == "article is test"
    assert prose.compress_text("use `the code` with the link https://a.b/the x", en, ultra=True) == "use `the code` w/ link https://a.b/the x"
    fenced = "# The title\n\n\n```\nthe code\n```\n| the | a |\n- the item"
    assert prose.compress_text(fenced, en) == "# The title\n\n```\nthe code\n```\n| the | a |\n-  item"
    assert "funcionário" in prose.compress_text("a função e o funcionário bom", prose.LOCALES["pt-BR"], ultra=True)
    assert prose.compress_text("", en) == ""
    random.seed(0)
    for _ in range(200):
        text = "".join(random.choice(["the ", "a", " ", "\n", "`", ",", ". ", "just", "é", "```\n", "# "]) for _ in range(30))
        prose.compress_text(text, en, True)


def test_signal_terms(spark):
    rows = [(1, 1, "error: Cannot open file.txt 12345"), (1, 2, "needsBackendErrors here"), (1, 3, "./src/error-handler.ts"), (1, 4, "all fine")]
    lines = spark.createDataFrame(rows, "k long, n long, line string")
    assert sorted(r.term for r in extract.signal_terms(lines, "k").collect()) == ["cannot", "error:", "file.txt", "open"]


@pytest.mark.parametrize(("n", "bad", "hit"), [(150, True, True), (150, False, False), (250, False, True), (100, True, False)])
def test_summary_trigger(spark, n, bad, hit):
    lines = spark.createDataFrame([(1, i, "error: x" if bad and i == 0 else "fine") for i in range(n)], "k long, n long, line string")
    assert extract.summary_trigger(lines, "k", 100).first().summarize is hit


def test_event_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("bash", 'say "x" ]', ["a]b", 'c"d'], 5)], "type string, cmd string, files array<string>, ts long")
    sources.append_events(rows, str(tmp_path / "log"))
    got = sources.read_events(spark, str(tmp_path / "log")).first()
    assert got.cmd == 'say "x" ]' and got.files == ["a]b", 'c"d'] and got.in_tk == 0 and got.errors == []


def test_streaming_redundancy(spark, tmp_path):
    from tidemark.streaming import redundancy

    text = "\n".join(f"line {i} of it" for i in range(10))
    source = str(tmp_path / "calls")
    spark.createDataFrame([(1, 1, text), (1, 2, text), (2, 1, "x")], "session long, call_n long, text string").write.parquet(source)
    stream = spark.readStream.schema("session long, call_n long, text string").parquet(source)
    q = redundancy.hits(stream).writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(120)
    assert {(r.session, r.call_n, r.hit_kind, r.ref) for r in spark.table("hits").collect()} == {(1, 1, None, None), (1, 2, "exact", 1), (2, 1, None, None)}
