"""The redundancy fold as a stream: calls against the recorded ones of their session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.similarity import FOLD, MARKS, Fold, marked

#: A session's state goes after so long without a call.
IDLE = 30 * 24 * 3600 * 1000


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    call, log = state.get if state.exists else (0, "[]")
    fold = Fold([(n, h, size, frozenset(s)) for n, h, size, s in json.loads(log)], call)
    # rows of a micro-batch come in any order
    rows = pd.concat(batches).sort_values("call_n")
    out = [(key[0], *fold.add(int(call), *marks)) for call, *marks in rows[MARKS].itertuples(index=False)]
    state.update((fold.call, json.dumps([(int(n), h, int(size), sorted(map(int, s))) for n, h, size, s in fold.log])))
    state.setTimeoutDuration(IDLE)
    yield pd.DataFrame(out, columns=["session", "call_n", "hit_kind", "ref", "similarity"]).astype({"ref": "Int64"})


def hits(calls: DataFrame) -> DataFrame:
    """(session, call_n, hit_kind, ref, similarity) of a stream of (session, call_n, text).

    State per session: the last recorded calls with their hashes, a bounded ring. Calls that come late are folded in
    when they come. Calls move as marks (a hash, a length, a sketch), so a session's part of a micro-batch is small.
    """
    return marked(calls).groupBy("session").applyInPandasWithState(_advance, "session long, " + FOLD, "call long, log string", "append", GroupStateTimeout.ProcessingTimeTimeout)
