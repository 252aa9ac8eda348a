"""Requests whose parts arrive one by one: folded in keyed state, closed when whole or at the time limit.

A row is one screened part: request_id, request_ts (when the request started), n_parts (how
many parts it has), n (the part's number), part_ts, verdict and filters. A row without n only
announces the request, so that one whose parts never come is reported too. Text stays where
it was screened; state holds numbers and names.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from parapet import settings as S
from parapet.functions import detect as D
from parapet.operators import verdicts as V

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOLDED = "request_id string, n_expected bigint, n_parts bigint, verdict string, matched string, over_limit boolean"
_RANKED = {3: S.BLOCKED, 2: S.INCOMPLETE, 1: S.ALLOWED}


def screened_parts(parts, text="text", rules=S.PROMPT_RULES, max_chars=S.MAX_TEXT_CHARS):
    """Arriving parts screened where they are read; the text goes no further."""
    screened = D.screen(parts, text, rules, max_chars)
    return screened.select("request_id", "request_ts", "n_parts", "n", "part_ts", "verdict", F.col("hits").alias("filters"))


def counted_parts(parts, wait_seconds=S.RESULT_WAIT_SECONDS):
    """(request_id, deadline, n_parts, n, part_ts, rank, label) of the rows that arrived within their request's time.

    A part that came too late counts as one that did not come. Stateless, so it is the same
    for streams and tables.
    """
    deadline = F.col("request_ts") + F.expr(f"INTERVAL {wait_seconds} SECONDS")
    label = F.array_join(F.transform("filters", lambda f: F.concat(F.lit("p"), F.col("n").cast("string"), F.lit(":"), f)), ",")
    blocked = (F.col("verdict") == S.BLOCKED) & (F.size("filters") > 0)
    return parts.where(F.col("request_id").isNotNull()).select(
        F.col("request_id").cast("string").alias("request_id"), deadline.alias("deadline"), F.col("n_parts").cast("bigint").alias("n_parts"),
        F.col("n").cast("bigint").alias("n"), "part_ts", V.verdict_rank(F.col("verdict")).cast("bigint").alias("rank"),
        F.when(F.coalesce(blocked, F.lit(False)), label).otherwise("").alias("label"),
    ).where(F.col("part_ts") <= F.col("deadline"))


def _outcome(n_expected, n_parts, rank, labels, max_parts):
    """Verdict of a closed request: blocked beats incomplete beats allowed; missing, unknown or no parts are incomplete."""
    whole = n_expected is not None and 0 < n_expected <= n_parts
    verdict = _RANKED[3 if rank == 3 else rank if whole else 2]
    matched = ",".join(label for _, label in sorted(labels)) or "none"
    return n_expected, n_parts, verdict, matched, max(n_parts, n_expected or 0) > max_parts


def fold_requests(parts, wait_seconds=S.RESULT_WAIT_SECONDS, max_parts=1 + S.MAX_FILES):
    """One verdict per request of a table of parts (the batch form of `fold_request_stream`).

    A part that was delivered repeatedly counts once, with its worst verdict. Names of blocked
    parts only are gathered; both steps are aggregated partly before the shuffle.
    """
    found = counted_parts(parts, wait_seconds)
    each = found.groupBy("request_id", "n").agg(F.max("n_parts").alias("n_parts"), F.max(F.struct("rank", "label")).alias("worst"))
    folded = each.groupBy("request_id").agg(
        F.max("n_parts").alias("n_expected"), F.count("n").alias("n_parts"),
        F.max(F.when(F.col("n").isNotNull(), F.col("worst.rank"))).alias("rank"),
        F.sort_array(F.collect_list(F.when(F.col("n").isNotNull() & (F.col("worst.label") != ""), F.struct("n", "worst.label")))).alias("labels"),
    )
    whole = F.coalesce((F.col("n_expected") > 0) & (F.col("n_parts") >= F.col("n_expected")), F.lit(False))
    matched = F.array_join(F.transform("labels", lambda x: x["label"]), ",")
    return folded.select(
        "request_id", "n_expected", "n_parts",
        F.when(F.col("rank") == 3, S.BLOCKED).when(~whole | (F.col("rank") == 2), S.INCOMPLETE).otherwise(S.ALLOWED).alias("verdict"),
        F.when(matched == "", "none").otherwise(matched).alias("matched"),
        (F.greatest("n_parts", F.coalesce("n_expected", F.lit(0))) > max_parts).alias("over_limit"),
    )


class RequestFold(StatefulProcessor):
    """Parts by number in state, a timer at the request's deadline; a closed request is remembered until then.

    `request` holds (expected parts, parts so far, whether closed). Later deliveries to a
    closed request change nothing. At the deadline its state goes, as no part that counts can
    come any more: one in time would be later than the watermark.
    """

    def __init__(self, max_parts):
        self.max_parts = max_parts

    def init(self, handle):
        self.handle = handle
        self.request = handle.getValueState("request", "n_expected bigint, n_parts bigint, closed boolean")
        self.parts = handle.getMapState("parts", "n bigint", "rank bigint, label string")

    def handleInputRows(self, key, rows, timerValues):
        state = self.request.get()
        expected, seen, closed = state if state else (None, 0, False)
        if closed:
            return
        deadline = None
        for frame in rows:
            deadline = frame["deadline"].iloc[0]
            known = frame["n_parts"].dropna()
            if len(known):
                expected = max(int(known.max()), expected or 0)
            delivered = frame.dropna(subset=["n"]).sort_values(["rank", "label"]).drop_duplicates("n", keep="last")
            for n, rank, label in zip(delivered["n"].astype(int), delivered["rank"].astype(int), delivered["label"]):
                place, before = (n,), self.parts.getValue((n,)) if self.parts.containsKey((n,)) else None
                seen += before is None
                if before is None or tuple(before) < (rank, label):
                    self.parts.updateValue(place, (rank, label))
        whole = expected is not None and 0 < expected <= seen
        nothing = expected == 0
        if state is None and deadline is not None:
            self.handle.registerTimer(int(deadline.timestamp() * 1000))
        self.request.update((expected, seen, whole or nothing))
        if whole or nothing:
            yield self._close(key, expected, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        expected, seen, closed = self.request.get()
        if not closed:
            yield self._close(key, expected, seen)
        self.request.clear()

    def _close(self, key, expected, seen):
        rank, labels = None, []
        for (n,), (r, label) in self.parts.iterator():
            rank = max(rank or 0, r)
            if label:
                labels.append((n, label))
        self.parts.clear()
        row = (str(key[0]), *_outcome(expected, seen, rank, labels, self.max_parts))
        frame = pd.DataFrame([row], columns=["request_id", "n_expected", "n_parts", "verdict", "matched", "over_limit"])
        return frame.astype({"n_expected": "Int64"})

    def close(self):
        pass


def fold_request_stream(parts, wait_seconds=S.RESULT_WAIT_SECONDS, delay="1 minute", max_parts=1 + S.MAX_FILES):
    """One verdict per request as soon as all its parts are there, or as incomplete at its time limit.

    The result does not depend on the order in which parts arrive and equals `fold_requests`
    on the same rows, given that a part which is delivered again has the same verdict. State
    holds the requests whose time limit the watermark has not passed. The session needs the
    RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    spark = parts.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")
    counted = counted_parts(parts, wait_seconds).withWatermark("part_ts", delay)
    return counted.groupBy("request_id").transformWithStateInPandas(RequestFold(max_parts), FOLDED, "Append", "EventTime")
