"""Running queries: configuration, retry, supervision, exactly-once runs, health, metrics, logs, shutdown."""

from __future__ import annotations

import contextlib
import json
import random
import signal
import sys
import threading
import time
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

MODES = ("noop", "log", "parallel", "prod")


@dataclass(frozen=True)
class Config:
    """How a query runs: partitions of stateful stages, rows per batch and where metrics are served."""

    mode: str = "noop"
    parallelism: int = 1
    capacity: int = 1024
    metrics_port: int | None = None
    checkpoint: str | None = None
    extra: dict = field(default_factory=dict)

    def validate(self) -> Config:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if self.parallelism <= 0 or self.capacity <= 0:
            raise ValueError("parallelism and capacity must be positive")
        if self.metrics_port is not None and not 0 <= self.metrics_port < 65_536:
            raise ValueError("metrics_port is 0..65535")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def of_json(text: str) -> Config:
        return Config(**json.loads(text)).validate()


NOOP, LOG, PARALLEL, PROD = Config(), Config("log"), Config("parallel", 4, 4096), Config("prod", 4, 8192, 9090)


# Logs: one JSON object a line

LEVELS = ("debug", "info", "warn", "error")


class Log:
    def __init__(self, sink: Callable[[str], None] | None = None, level: str = "info") -> None:
        self.sink, self.level = sink or (lambda line: print(line, file=sys.stderr)), level

    def emit(self, level: str, message: str, **fields) -> None:
        if LEVELS.index(level) >= LEVELS.index(self.level):
            self.sink(json.dumps({"level": level, "msg": message, **fields}, default=str))

    def debug(self, message: str, **fields) -> None:
        self.emit("debug", message, **fields)

    def info(self, message: str, **fields) -> None:
        self.emit("info", message, **fields)

    def warn(self, message: str, **fields) -> None:
        self.emit("warn", message, **fields)

    def error(self, message: str, **fields) -> None:
        self.emit("error", message, **fields)


# Metrics

#: Histogram buckets in seconds.
BUCKETS = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)


class Metrics:
    """Counters, gauges and histograms, dumped as Prometheus text."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.counters: dict[str, float] = defaultdict(float)
        self.gauges: dict[str, float] = {}
        self.histograms: dict[str, list] = {}

    def add(self, name: str, by: float = 1) -> None:
        with self.lock:
            self.counters[name] += by

    def set_gauge(self, name: str, value: float) -> None:
        with self.lock:
            self.gauges[name] = value

    def observe(self, name: str, seconds: float) -> None:
        with self.lock:
            h = self.histograms.setdefault(name, [[0] * (len(BUCKETS) + 1), 0.0])
            h[0][next((i for i, b in enumerate(BUCKETS) if seconds <= b), len(BUCKETS))] += 1
            h[1] += seconds

    def dump(self) -> str:
        with self.lock:
            out = [f"# TYPE {n} counter\n{n} {v:g}" for n, v in sorted(self.counters.items())]
            out += [f"# TYPE {n} gauge\n{n} {v:g}" for n, v in sorted(self.gauges.items())]
            for n, (counts, total) in sorted(self.histograms.items()):
                run = [sum(counts[: i + 1]) for i in range(len(counts))]
                out.append(f"# TYPE {n} histogram")
                out += [f'{n}_bucket{{le="{b:g}"}} {c}' for b, c in zip((*BUCKETS, float("inf")), run, strict=True)]
                out.append(f"{n}_sum {total:g}\n{n}_count {run[-1]}")
        return "\n".join(out) + "\n"

    def serve(self, port: int) -> HTTPServer:
        metrics = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                body = metrics.dump().encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args) -> None:
                pass

        server = HTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


class QueryMetrics(StreamingQueryListener):
    """Feeds a query's progress into metrics: rows, batch seconds, state rows, rows dropped by the watermark."""

    def __init__(self, metrics: Metrics) -> None:
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("queries_started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.add("input_rows", p.numInputRows)
        self.metrics.observe("batch_seconds", (p.batchDuration or 0) / 1000)
        self.metrics.set_gauge("state_rows", sum(s.numRowsTotal for s in p.stateOperators))
        self.metrics.add("late_rows", sum(s.numRowsDroppedByWatermark for s in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("queries_failed" if event.exception else "queries_ended")


# Retry

def delay_for(attempt: int, base: float = 0.1, factor: float = 2.0, most: float = 5.0, jitter: float = 0.0) -> float:
    """Seconds before an attempt: none before the first, then exponential up to ``most``."""
    if attempt <= 1:
        return 0.0
    wait = min(base * factor ** (attempt - 2), most)
    return wait * (1 + random.uniform(-jitter, jitter)) if jitter else wait


def with_retry(f: Callable, attempts: int = 5, sleep: Callable[[float], None] = time.sleep, on_error: Callable[[int, Exception], None] | None = None, **delays):
    """f's result, or None when all attempts fail."""
    for n in range(1, attempts + 1):
        sleep(delay_for(n, **delays))
        try:
            return f()
        except Exception as e:
            if on_error:
                on_error(n, e)
    return None


# Health and shutdown

class Health:
    def __init__(self) -> None:
        self.state, self.reason = "starting", None

    def set(self, state: str, reason: str | None = None) -> None:
        if state not in ("starting", "ready", "draining", "unhealthy"):
            raise ValueError(state)
        self.state, self.reason = state, reason

    def follow(self, query: StreamingQuery) -> None:
        if query.exception():
            self.set("unhealthy", str(query.exception())[:200])
        elif query.isActive:
            self.set("ready" if query.lastProgress else "starting")

    def is_live(self) -> bool:
        return self.state != "unhealthy"

    def to_json(self) -> str:
        return json.dumps({"status": self.state} | ({"reason": self.reason} if self.reason else {}))


class Shutdown:
    """A flag that signals set; registered queries stop once, in order."""

    def __init__(self) -> None:
        self.flag, self.hooks = threading.Event(), []

    def register(self, hook: Callable[[], None]) -> None:
        self.hooks.append(hook)

    def on_signals(self, *signals: int) -> None:
        for s in signals or (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: self.request())

    def request(self) -> None:
        if not self.flag.is_set():
            self.flag.set()
            for hook in self.hooks:
                hook()

    def is_requested(self) -> bool:
        return self.flag.is_set()

    def wait(self, timeout: float | None = None) -> bool:
        return self.flag.wait(timeout)


# Dead letters

class DeadLetters:
    """Counts and keeps failed payloads: as a table in a folder, or in a log."""

    def __init__(self, path: str | None = None, log: Log | None = None) -> None:
        self.path, self.log, self.count = path, log, 0

    def send(self, rows: DataFrame, batch: int = 0) -> None:
        rows = rows.persist()
        self.count += rows.count()
        if self.path:
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        elif self.log:
            for r in rows.toLocalIterator():
                self.log.error("dead letter", **r.asDict())
        rows.unpersist()


# Running

def run(df: DataFrame, write: Callable[[DataFrame, int], None], config: Config, once: bool = True, name: str | None = None) -> StreamingQuery | None:
    """Bounded input: writes batch 0.  Stream: starts a query, to its end (``once``) or for good."""
    config.validate()
    spark = df.sparkSession
    if config.parallelism > 1 and df.isStreaming:
        spark.conf.set("spark.sql.shuffle.partitions", str(config.parallelism))
    if not df.isStreaming:
        write(df, 0)
        return None
    writer = df.writeStream.foreachBatch(write)
    if config.checkpoint:
        writer = writer.option("checkpointLocation", config.checkpoint)
    if name:
        writer = writer.queryName(name)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def run_exactly_once(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A checkpointed run: offsets are logged before a batch and the batch is committed after its write, so a
    restart repeats the batch that was under way with the same number; the sink makes that harmless."""
    if not checkpoint:
        raise ValueError("exactly-once needs a checkpoint")
    return run(df, write, Config(checkpoint=checkpoint))


def fan_out(df: DataFrame, outlets: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> dict[str, StreamingQuery]:
    """One query per outlet, each with its own offsets: a slow outlet holds back none and loses nothing."""
    if not outlets:
        raise ValueError("no outlets")
    start = lambda n, w: df.writeStream.queryName(n).foreachBatch(w).option("checkpointLocation", f"{checkpoint}/{n}").trigger(availableNow=True).start()
    return {n: start(n, w) for n, w in outlets.items()}


@dataclass(frozen=True)
class Policy:
    """restart (up to max_retries, with back-off), isolate (leave it failed) or crash_all."""

    kind: str = "isolate"
    max_retries: int = 3
    backoff_s: float = 0.1

    def __post_init__(self) -> None:
        if self.kind not in ("restart", "isolate", "crash_all"):
            raise ValueError(self.kind)


def supervise(pipelines: dict[str, tuple[Callable[[], StreamingQuery], Policy]], log: Log | None = None, poll_s: float = 0.05) -> dict[str, str | None]:
    """Runs queries to their ends: name -> error or None.  Under crash_all a failure stops the others and is raised."""
    log, left = log or Log(lambda line: None), {}
    result: dict[str, str | None] = {}
    tries = dict.fromkeys(pipelines, 0)
    for name, (start, _) in pipelines.items():
        left[name] = start()
    while left:
        for name in list(left):
            query = left[name]
            if query.isActive:
                continue
            error, (start, policy) = query.exception(), pipelines[name][0:2]
            if error is None:
                result[name] = None
            elif policy.kind == "restart" and tries[name] < policy.max_retries:
                tries[name] += 1
                time.sleep(policy.backoff_s * 2 ** (tries[name] - 1))
                left[name] = start()
                continue
            else:
                result[name] = str(error)
                log.error("pipeline failed", pipeline=name, error=str(error)[:500])
                if policy.kind == "crash_all":
                    for other in left.values():
                        with contextlib.suppress(Exception):
                            other.stop()
                    raise RuntimeError(f"{name}: {error}")
            del left[name]
        time.sleep(poll_s)
    return result


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and the state store that timers need.

    Plans don't record the Python line of every column, which halves the time to build a long one; errors then don't
    name the line.  Pass "spark.python.sql.dataFrameDebugging.enabled" and "spark.sql.dataFrameQueryContext.enabled"
    as "true" to have that.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def stop_on(shutdown: Shutdown, *queries: StreamingQuery) -> None:
    for q in queries:
        shutdown.register(q.stop)


def await_all(queries: Sequence[StreamingQuery]) -> None:
    for q in queries:
        q.awaitTermination()
