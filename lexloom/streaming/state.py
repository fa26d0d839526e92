"""Stateful streams of the job log: a listener's replay that goes over into following, and admission as requests arrive.

State is kept by key in the state store: of a job what waits behind a gap and one row of how far it was told, of a quota one number for each
tenant and day, dropped by a timer when the watermark is past the day. Both need a store that holds several kinds of state; with_store
sets it for the session.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexloom.functions.redact import redacted
from lexloom.session import ship
from lexloom.streaming.events import OVERALL, PER_TENANT, TERMINAL

#: The process that starts a processor has none of the files that a session ships, so processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "seq long, event string, data string, at timestamp"


def with_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Told(StatefulProcessor):
    """Events of one job in the order of their numbers, each once, up to the first terminal one.

    Recorded events are the initial state; a timer that is due at once tells them, whether or not anything live comes. A live event that is
    behind a gap waits in state until the gap is filled, or until the watermark passes it, when what waits is told without what is missing.
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "last long, ended boolean")
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = [tuple(r) for r in initialState[["seq", "event", "data", "at"]].itertuples(index=False)]
        if not self.told.exists():
            self.told.update((0, False))
        self._keep([tuple(r) for r in self.waiting.get()] + rows if self.waiting.exists() else rows)
        self.handle.registerTimer(1)

    def _keep(self, rows: list[tuple]) -> None:
        self.waiting.put([(int(s), e, d, a) for s, e, d, a in rows])

    def _tell(self, key, whatever: bool) -> Iterator[pd.DataFrame]:
        """Tells what waits, up to the first gap or whatever there is."""
        last, ended = self.told.get() if self.told.exists() else (0, False)
        one = {}
        for s, e, d, a in self.waiting.get() if self.waiting.exists() else []:
            one.setdefault(s, (e, d, a))
        out, rest = [], []
        for s in sorted(one):
            if ended or s <= last:
                continue
            if s == last + 1 or whatever:
                out.append((*key, s, *one[s]))
                last, ended = s, one[s][0] in TERMINAL
            else:
                rest.append((s, *one[s]))
        self.told.update((last, ended))
        if rest:
            self._keep(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=self.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        came = [tuple(r) for pdf in rows for r in pdf[["seq", "event", "data", "at"]].itertuples(index=False)]
        self._keep(held + came)
        for _, _, _, at in came:
            self.handle.registerTimer(int(at.timestamp() * 1000) + 1)
        yield from self._tell(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first timer tells the record; one of an event finds it told already, or gives up what is missing before it
        yield from self._tell(key, expiredTimerInfo.getExpiryTimeInMs() > 1)

    def close(self) -> None:
        pass


def follow_from(live: DataFrame, recorded: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """job_id, seq, event, data, at: what a listener of every job hears, its recorded events first, then live ones beyond them.

    live is a stream and recorded a table of (job_id, seq, event, data, at). Live events that the record holds too are told once. Events later
    than the delay are not heard.
    """
    ship(live.sparkSession)
    with_store(live.sparkSession)
    kind = dict(live.dtypes)["job_id"]
    cast = lambda df: df.select("job_id", F.col("seq").cast("long").alias("seq"), "event", F.col("data").cast("string").alias("data"), F.col("at").cast("timestamp").alias("at"))
    names = ["job_id", "seq", "event", "data", "at"]
    return (
        cast(live).withWatermark("at", delay).groupBy("job_id")
        .transformWithStateInPandas(Told(names), f"job_id {kind}, {_EVENT}", "Append", "EventTime", cast(recorded).groupBy("job_id"))
    )


class Counted(StatefulProcessor):
    """Requests of one key and day, numbered as they arrive, and whether they are within a limit; only those within count when asked so."""

    def __init__(self, limit: int, names: list[str]) -> None:
        self.limit, self.names = limit, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0] if self.n.exists() else 0
        whole = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        whole["nth"] = range(n + 1, n + 1 + len(whole))
        self.n.update((n + len(whole),))
        end = pd.Timestamp(whole["day"].iloc[0]) + pd.Timedelta(days=1)
        self.handle.registerTimer(int(end.timestamp() * 1000))
        whole["within"] = whole["nth"] <= self.limit
        yield whole[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.n.clear()
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def _numbered(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """df with nth and within in the order of arrival, by key columns, one of which is day; at is the event time."""
    kept = [f"{n} {t}" for n, t in df.dtypes if n not in ("nth", "within")]
    names = [k.split()[0] for k in kept]
    return df.select(*names).groupBy(*by).transformWithStateInPandas(Counted(limit, [*names, "nth", "within"]), ", ".join([*kept, "nth long", "within boolean"]), "Append", "EventTime", eventTimeColumnName="at")


def admitted(requests: DataFrame, per_tenant: int = PER_TENANT, overall: int = OVERALL, delay: str = "1 day") -> DataFrame:
    """A stream of requests(tenant, at, id, question) redacted, with day, nth, every and ok: those that their tenant's quota of the day lets
    through, numbered among the tenant's and among all of that day, and whether the day's quota of all lets them in too.

    What a tenant's quota stops is not told and does not count among all. Nothing but the redacted question reaches state or a sink.
    Requests are numbered as they arrive, those of a micro-batch by (at, id). A late one counts against its own day while that day is held; once
    the watermark is past the day it is dropped. One key a day counts all tenants; no tenant sends it more than its quota.
    """
    ship(requests.sparkSession)
    with_store(requests.sparkSession)
    df = requests.select("tenant", F.col("at").cast("timestamp").alias("at"), "id", redacted(F.col("question")).alias("question")).withWatermark("at", delay)
    own = _numbered(df.withColumn("day", F.to_date("at")), ["tenant", "day"], per_tenant)
    let_through = own.where("within").select("tenant", "at", "id", "question", "day", F.col("nth").alias("own"))
    out = _numbered(let_through, ["day"], overall)
    return out.select("tenant", "at", "id", "question", "day", F.col("own").alias("nth"), F.col("nth").alias("every"), F.col("within").alias("ok"))
