"""Message buffers as streaming state: one row for each episode that is cut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "owner long, episode long, first_seq long, last_seq long, n_messages int, text string, reason string"
STATE = "episode long, seqs array<long>, lines array<string>"


#: The role of a message that is none: it ends its owner's buffer. A stream that ends sends one for each owner.
FLUSH = "\0flush"


def episodes(messages: DataFrame, most: int, idle_ms: int | None = None) -> DataFrame:
    """Episodes of a stream of messages (owner, seq, role, content): cut at `most` messages, after idle_ms without one, or by a message of the role FLUSH.

    What is in a buffer stays in the state until one of these comes.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        episode, seqs, lines = state.get if state.exists else (0, [], [])
        seqs, lines, out = list(seqs), list(lines), []

        def cut(reason: str) -> None:
            nonlocal episode, seqs, lines
            out.append((key[0], episode, seqs[0], seqs[-1], len(seqs), "\n".join(lines), reason))
            episode, seqs, lines = episode + 1, [], []

        if state.hasTimedOut:
            if seqs:
                cut("idle")
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("seq")
            for m in rows.itertuples():
                if m.role == FLUSH:
                    if seqs:
                        cut("flush")
                    continue
                if len(seqs) >= most:
                    cut("size")
                seqs.append(int(m.seq))
                lines.append(f"{m.role}: {m.content}")
            state.update((episode, seqs, lines))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return messages.groupBy("owner").applyInPandasWithState(fold, OUT, STATE, "append", timeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of events (owner, ts) with a watermark: owner, start, end, n. An extension."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.groupBy("owner", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("owner", "w.start", "w.end", "n")
