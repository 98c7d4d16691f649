"""Packing goes on while a round saves bins."""

import numpy as np

from tidemark.llm import packing


def test_rounds_go_on_while_bins_are_saved(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 4)
    rounds, packer = [], packing._packer
    monkeypatch.setattr(packing, "_packer", lambda round_, capacity: rounds.append(round_) or packer(round_, capacity))
    lengths = np.random.default_rng(7).integers(20, 60, 400)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "pieces_of", lambda docs, path, capacity: docs)
    got = packing.pack(pieces, "", 100).collect()
    assert len(rounds) > 4
    assert sorted((r.doc_id, r.length) for r in got) == sorted(enumerate(lengths.tolist()))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 100
    assert len(bins) >= packing.lower_bound(lengths, 100)


def test_bound_of_counts():
    lengths = np.random.default_rng(8).integers(1, 101, 300)
    assert packing.bound_of(np.bincount(lengths, minlength=101), 100) == packing.lower_bound(lengths, 100)


def test_certified_parts_are_final(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 60)
    dealt, packer = [], packing._packer

    def watched(round_, capacity):
        pack = packer(round_, capacity)

        def run(group):
            out = pack(group)
            bound = packing.lower_bound(group["length"].to_numpy(), capacity)
            bins = len(set(out["sequence_id"].to_pylist()))
            surplus, loose = set(out["surplus"].to_pylist()), {b for b, x in zip(out["sequence_id"].to_pylist(), out["loose"].to_pylist(), strict=True) if x}
            assert surplus == {bins - bound} and (bins > bound or len(loose) <= 1)
            return out

        dealt.append(round_)
        return run

    monkeypatch.setattr(packing, "_packer", watched)
    lengths = np.random.default_rng(9).integers(1, 50, 600)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    monkeypatch.setattr(packing, "pieces_of", lambda docs, path, capacity: docs)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "", 100).collect()
    parts = {(r.sequence_id >> 24): r.surplus for r in got}
    assert len(dealt) > 1 and len({r.sequence_id for r in got}) <= packing.lower_bound(lengths, 100) + sum(parts.values()) + 1
