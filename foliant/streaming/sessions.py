"""Save sessions: tokens that are granted, used and expire after a day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_HOURS = 24
# fixed values: what each format is saved as
WRITABLE = {"hwp": "hwpx", "hwpx": "hwpx", "doc": "docx", "docx": "docx", "odt": "odt"}
TARGETS = ("hwpx", "docx", "odt", "html")


def live(sessions: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    """Sessions that have not expired."""
    return sessions.filter(F.col(created) > now - F.expr(f"interval {TTL_HOURS} hours"))


def decide(requests: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Requests (token, method, ext, overwrite, size) with status, target and note, by the saving rules.

    405 for other methods than PUT, 403 without a live token, 400 for other
    formats or an empty body; the original is overwritten only when asked for and
    when its format can be written, else a copy is made beside it.
    """
    from foliant.functions.text import stem

    mine = live(sessions, now).select("token", F.col("ext").alias("own_ext"), "src")
    out = requests.join(mine, "token", "left")
    same_as = F.element_at(F.create_map(*[F.lit(x) for p in WRITABLE.items() for x in p]), F.col("own_ext"))
    ext = F.coalesce("ext", same_as, F.lit("hwpx"))
    over = F.coalesce("overwrite", F.lit(False)) & (ext == F.col("own_ext"))
    status = F.when(F.col("method") != "PUT", 405).when(F.col("own_ext").isNull(), 403).when(~ext.isin(*TARGETS), 400).when(F.coalesce("size", F.lit(0)) == 0, 400).otherwise(200)
    name = F.concat(stem(F.col("src")), F.when(over, F.lit(".")).otherwise(F.lit(".edited.")), ext)
    return out.withColumn("status", status).withColumn("target", F.when(status == 200, name)).withColumn("overwrote", F.when(status == 200, over)).withColumn("note", F.when((status == 200) & (same_as != F.col("own_ext")), F.concat(F.col("own_ext"), F.lit(" is saved as "), ext))).drop("own_ext", "src")


def debounced(events: DataFrame, by: list[str], at: str, pause: str = "400 milliseconds") -> DataFrame:
    """(by, start, end, events): what is asked again within the pause is done once; on a stream with a watermark too."""
    window = F.session_window(at, pause)
    out = events.groupBy(*by, window.alias("_w")).agg(F.count("*").alias("events"))
    return out.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def expire(events: DataFrame, key: str = "user_id", at: str = "ts", ttl_hours: int = TTL_HOURS) -> DataFrame:
    """A stream of (key, opened, closed, uses): a session ends `ttl_hours` after it was opened, by event time.

    `events` must carry a watermark on `at`; state is one row per open session.
    """

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ttl = pd.Timedelta(hours=ttl_hours)
        opened, uses = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            out.append((name[0], opened, opened + ttl, uses))
            state.remove()
        else:
            for ts in sorted(t for pdf in frames for t in pdf[at]):
                if opened is not None and ts >= opened + ttl:
                    out.append((name[0], opened, opened + ttl, uses))
                    opened, uses = None, 0
                opened, uses = opened if opened is not None else ts, uses + 1
            state.update((int(opened.value // 1000), uses))
            end = int((opened + ttl).value // 1_000_000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "opened", "closed", "uses"])

    return events.groupBy(key).applyInPandasWithState(update, "key long, opened timestamp, closed timestamp, uses long", "opened long, uses long", "append", GroupStateTimeout.EventTimeTimeout)
