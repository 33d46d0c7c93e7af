"""Accounts, usage, quotas, rate windows and retries."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactry.operators.running import running_total

# Lifetime quotas, calls a minute of the engines, window, slack, attempts, pauses, transient statuses.
QUOTAS = {"deep_scan": 50, "ocr_api": 30}
PER_MINUTE = {"gemini": 10, "openai": 60, "grok": 60}
WINDOW_S, SLACK_S = 60, 0.05
ATTEMPTS, PAUSES = 3, (3, 10)
TRANSIENT = (429, 500, 502, 503, 504)
# Parts of model names that rule a model out for text, and for images.
NO_TEXT = "image|tts|robotics|computer-use|customtools|omni"
NO_VISION = "whisper|tts|embedding|moderation|dall-e|davinci|babbage|audio|realtime|transcribe|search|imagine"


def once(events: DataFrame, id_col: str = "usage_id") -> DataFrame:
    """Each event once, the earliest delivery."""
    return events.groupBy(id_col).agg(F.min_by(F.struct(*[c for c in events.columns if c != id_col]), "received_at").alias("_r")).select(id_col, "_r.*")


def admitted(events: DataFrame, key_col: str, kind_col: str, time_col: str, id_col: str) -> DataFrame:
    """Events with ``nth`` of its key and kind, and ``admitted``: within the lifetime quota; kinds without one always are."""
    quota = F.create_map(*[F.lit(x) for p in QUOTAS.items() for x in p])
    out = running_total(events, [key_col, kind_col], [F.col(time_col), F.col(id_col)], F.lit(1), "nth").withColumn("nth", F.col("nth").cast("int"))
    return out.withColumn("admitted", F.coalesce(F.col("nth") <= F.element_at(quota, F.col(kind_col)), F.lit(True)))


def usage(events: DataFrame, key_col: str, kind_col: str) -> DataFrame:
    """(key, requests, deep_scans, ocr_calls) from the event log; the log, not a counter, is the truth."""
    n = lambda k, a: F.count(F.when(F.col(kind_col) == k, 1)).alias(a)
    return events.groupBy(key_col).agg(n("scan", "requests"), n("deep_scan", "deep_scans"), n("ocr_api", "ocr_calls"))


def known_keys(events: DataFrame, keys: DataFrame, key_col: str) -> DataFrame:
    """Events of keys that exist."""
    return events.join(keys.select(key_col), key_col, "left_semi")


def registered(accounts: DataFrame, new: DataFrame, email_col: str) -> DataFrame:
    """The rows of ``new`` whose e-mail no account has, one per e-mail."""
    return new.dropDuplicates([email_col]).join(accounts.select(email_col), email_col, "left_anti")


def arrivals(events: DataFrame, key_col: str, time_col: str, seconds: int = WINDOW_S) -> DataFrame:
    """Events with ``in_window``: arrivals of their key in the window that ends with them, open at its start.

    Time is cut into stretches as long as the window, and each event also goes to
    the stretch after its own, so a key's events are counted stretch by stretch
    and a hot key is spread over time.
    """
    size = seconds * 1_000_000
    at = F.unix_micros(time_col)
    rows = events.withColumn("__at", at).withColumn("__own", F.floor(F.col("__at") / size)).withColumn("__cell", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(key_col, "__cell").orderBy("__at").rangeBetween(-(size - 1), 0)
    return rows.withColumn("in_window", F.count("*").over(w)).where("__cell = __own").drop("__at", "__own", "__cell")


class Limiter:
    """At most ``most`` calls in the trailing window; 0 and less switch it off. Clock and sleep can be given for tests."""

    def __init__(self, most: int, seconds: float = WINDOW_S, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.seconds, self.clock, self.sleep = most, seconds, clock, sleep
        self.calls: deque[float] = deque()

    def acquire(self) -> float:
        """Wait for a slot; the seconds waited."""
        waited = 0.0
        while self.most > 0:
            now = self.clock()
            while self.calls and self.calls[0] <= now - self.seconds:
                self.calls.popleft()
            if len(self.calls) < self.most:
                self.calls.append(now)
                break
            pause = self.calls[0] + self.seconds - now + SLACK_S
            self.sleep(pause)
            waited += pause
        return waited


def limit_from(value: str | None, engine: str) -> int:
    """A configured limit, the default where it is missing or no number."""
    try:
        return int(value) if value is not None else PER_MINUTE[engine]
    except ValueError:
        return PER_MINUTE[engine]


def retried(call: Callable, status_of: Callable[[Exception], int | None], sleep: Callable[[float], None] = time.sleep):
    """The call's result; transient failures are tried again after the pauses, others fail at once."""
    for pause in (*PAUSES, None)[:ATTEMPTS]:
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if pause is None or status_of(e) not in TRANSIENT:
                raise
            sleep(pause)


def text_models(models: DataFrame, col: str) -> DataFrame:
    """Distinct usable text models, without their prefix, sorted."""
    name = F.regexp_replace(col, "^models/", "")
    return models.select(name.alias(col)).where(F.col(col).startswith("gemini-") & F.col(col).rlike("flash|pro") & ~F.col(col).rlike(NO_TEXT)).distinct().orderBy(col)


def vision_models(models: DataFrame, col: str) -> DataFrame:
    return models.select(col).where(~F.lower(col).rlike(NO_VISION)).distinct().orderBy(col)


def deep_scan(docs: DataFrame, id_col: str, text_col: str, extract: Callable[[str], list[tuple[str, str, int, int]]] | None = None, per_minute: int = 0, pieces: int = 1) -> DataFrame:
    """(id, status, entity_type, span_start, span_end, text_val, score, context_snippet): spans of an outer model.

    ``extract`` gives (type, text, start, end) of a text; without one every document
    is 'skipped_no_key'. Spans without a place are dropped, a failure is 'skipped_error'
    after bounded retries, and no document is lost: one without spans has one row
    of nulls. Calls are throttled per task, so ``pieces`` tasks make at most
    ``pieces * per_minute`` calls a minute.
    """
    import pandas as pd

    kind = dict(docs.dtypes)[id_col]
    names = ["id", "status", "entity_type", "span_start", "span_end", "text_val", "score", "context_snippet"]

    def run(frames):
        limiter = Limiter(per_minute)
        for pdf in frames:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                found, status = [], "skipped_no_key"
                if extract is not None:
                    try:
                        limiter.acquire()
                        found = [x for x in retried(lambda t=text: extract(t), lambda e: getattr(e, "status", None)) if x[2] is not None]
                        status = "ok"
                    except Exception:  # noqa: BLE001
                        status = "skipped_error"
                rows += [(i, status, t, a, b, v, 0.6, v) for t, v, a, b in found] or [(i, status, None, None, None, None, None, None)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"span_start": "Int32", "span_end": "Int32"})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    if extract is not None and per_minute > 0:
        rows = rows.repartition(pieces)
    return rows.mapInPandas(run, f"id {kind}, status string, entity_type string, span_start int, span_end int, text_val string, score double, context_snippet string").withColumnRenamed("id", id_col)
