"""Outside services behind replaceable providers, called once for a partition; the stub answers offline.

A provider is opened on the executor and maps a request row to a result dict. Retries, time limits, back-off and what
stops a run are the caller's policy, not the provider's. What stops a run is said to all tasks by a flag that the driver
keeps, so it isn't asked again by a task that Spark repeats."""

from __future__ import annotations

import base64
import hashlib
import json
import queue
import random
import secrets
import socket
import socketserver
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import schema

RESULT = "answer string, prompt_tokens int, completion_tokens int, total_tokens int, cost double, provider string, attempts int, error string"


#: The error of a request that wasn't made because the run had stopped.
NOT_ASKED = "not asked"


class Temporary(Exception):
    """A failure that another try may mend: 429, 5xx, a lost connection, an answer without choices."""


class CostIncurred(Exception):
    """A call that should have been free had a price; the whole run stops."""


@dataclass(frozen=True)
class Flag:
    """A task's way to the driver's flag: whether the run goes on, and to stop it. A driver that can't be reached, or says
    nothing, stops the task's requests: no call is made that the run could not take back."""

    host: str
    port: int
    token: str
    seconds: float = 10.0

    def say(self, what: str) -> str:
        with socket.create_connection((self.host, self.port), self.seconds) as s:
            s.sendall(f"{self.token} {what}\n".encode())
            return s.makefile().readline().strip()

    def up(self) -> bool:
        try:
            return self.say("go?") == "go"
        except OSError:
            return False

    def stop(self, why: str) -> None:
        try:
            self.say("stop " + " ".join(why.split()))
        except OSError:
            pass  # up() says no to everyone who can't reach it either


class RunFlag:
    """The driver's flag of one run, a small server while it is open; `why` says what stopped the run."""

    def __init__(self, spark: SparkSession):
        self.why, token = None, secrets.token_hex(16)
        conf, flag = spark.sparkContext.getConf(), self

        class Answer(socketserver.StreamRequestHandler):
            timeout = 10

            def handle(self) -> None:
                said, _, what = self.rfile.readline(1_000).decode(errors="replace").strip().partition(" ")
                if secrets.compare_digest(said.encode(), token.encode()):
                    if what.startswith("stop "):
                        flag.why = flag.why or what[5:]
                    self.wfile.write(b"stop\n" if flag.why else b"go\n")

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads, allow_reuse_address, request_queue_size = True, True, 256

        host = conf.get("spark.driver.host") or socket.gethostname()
        self.server = Server((conf.get("spark.driver.bindAddress") or host, 0), Answer)
        self.flag = Flag(host, self.server.server_address[1], token)

    def __enter__(self) -> RunFlag:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.server.shutdown()
        self.server.server_close()


class Stopped(Exception):
    """The run has stopped; nothing more is asked."""


class Provider(Protocol):
    def __call__(self, request: dict) -> dict: ...


@dataclass(frozen=True)
class Policy:
    tries: int = 3
    seconds: float = 300.0
    base: float = 5.0
    free_only: bool = True
    staggered: bool = False
    hung: int = 16  # calls over their time that a partition leaves behind at most
    sleep: Callable[[float], None] = field(default=time.sleep)


def backoff(attempt: int, base: float, rng: random.Random) -> float:
    """Seconds before the next try: doubling, give or take half, one at least."""
    return max(1.0, base * 2**attempt * (1 + rng.uniform(-0.5, 0.5)))


def stagger(index: int, rng: random.Random) -> float:
    """Seconds by which the start of a request is put off: two for each before it, thirty at most."""
    return min(2.0 * index + rng.random(), 30.0)


def timed(provider: Provider, request: dict, seconds: float, slots: threading.Semaphore) -> dict:
    """The provider's answer, or TimeoutError. What is late goes on in a daemon thread that holds one of the slots, so
    that calls that hang can't exhaust the worker."""
    if not slots.acquire(timeout=seconds):
        raise TimeoutError("too many calls hang")
    box: queue.Queue = queue.Queue(1)

    def work() -> None:
        try:
            box.put((provider(request), None))
        except BaseException as e:  # noqa: BLE001  raised again by the caller
            box.put((None, e))
        finally:
            slots.release()

    threading.Thread(target=work, daemon=True).start()
    try:
        got, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer in {seconds:g} s") from None
    if error is not None:
        raise error
    return got


def call(provider: Provider, request: dict, policy: Policy, rng: random.Random, slots: threading.Semaphore | None = None) -> dict:
    """A result row: the answer and its usage, or an error. Only CostIncurred and Stopped go through."""
    error, slots = "no try", slots or threading.Semaphore(policy.hung)
    for attempt in range(policy.tries):
        try:
            got = timed(provider, request, policy.seconds, slots)
            if policy.free_only and (got.get("cost") or 0) > 0:
                raise CostIncurred(f"a call cost {got['cost']}")
            answer = (got.get("reasoning") or "") + (got.get("content") or "")
            return {k: got.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens", "cost", "provider")} | {"answer": answer, "attempts": attempt + 1, "error": None}
        except (CostIncurred, Stopped):
            raise
        except (Temporary, TimeoutError, ConnectionError) as e:
            error = str(e) or type(e).__name__
            if attempt + 1 < policy.tries:
                policy.sleep(backoff(attempt, policy.base, rng))
        except Exception as e:  # noqa: BLE001  a page that fails doesn't stop the others
            return {"error": str(e) or type(e).__name__, "attempts": attempt + 1}
    return {"error": error, "attempts": policy.tries}


def completion_of(status: int, body: str) -> dict:
    """What a chat completion says. 429, 5xx and an answer without choices may be mended by another try."""
    if status == 429 or status >= 500:
        raise Temporary(f"status {status}")
    if status >= 400:
        raise ValueError(f"status {status}: {body[:200]}")
    said = json.loads(body)
    if not said.get("choices"):
        raise Temporary(f"no choices: {json.dumps(said.get('error') or '')[:200]}")
    message, usage = said["choices"][0].get("message") or {}, said.get("usage") or {}
    numbers = {k: usage.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
    return {"content": message.get("content"), "reasoning": message.get("reasoning"), "cost": usage.get("cost"), "provider": said.get("provider")} | numbers


@dataclass(frozen=True)
class Endpoint:
    """A chat completion service over HTTP; a request's prompt, and its image (PNG bytes) if it has one, make one message."""

    url: str
    model: str
    token: str = ""
    seconds: float = 240.0

    def __call__(self, request: dict) -> dict:
        parts: list[dict] = [{"type": "text", "text": str(request.get("prompt") or request.get("text") or "")}]
        if request.get("image_png"):
            parts.append({"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(request["image_png"]).decode()}})
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": parts}]}).encode()
        asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {}))
        try:
            with urllib.request.urlopen(asked, timeout=self.seconds) as got:  # noqa: S310
                return completion_of(got.status, got.read().decode())
        except urllib.error.HTTPError as e:
            return completion_of(e.code, e.read().decode("utf-8", "replace"))
        except urllib.error.URLError as e:
            raise ConnectionError(str(e.reason)) from e


class Stub:
    """An offline provider: a YAML page made from the request's text; deterministic."""

    def __call__(self, request: dict) -> dict:
        text = str(request.get("text") or request.get("prompt") or "")
        body = "\n".join(f"  {x}" for x in text.splitlines()) or "  "
        digest = hashlib.md5(text.encode()).digest()
        return {"content": f"primary_language: en\nis_rotation_valid: true\nrotation_correction: 0\nis_table: false\nis_diagram: false\nnatural_text: |\n{body}", "prompt_tokens": len(text) // 4, "completion_tokens": digest[0], "total_tokens": len(text) // 4 + digest[0], "cost": 0.0, "provider": "stub"}


def complete(requests: DataFrame, open_provider: Callable[[], Provider] = Stub, policy: Policy = Policy(), at_once: int = 1, flag: Flag | None = None) -> DataFrame:
    """requests with the columns of RESULT: one provider for a partition, a row for each request, failures as rows.
    Two levels work side by side: partitions, and in each of them `at_once` requests, whose first starts are staggered
    if the policy says so.

    A call with a price is a failure that stops the run: the rows that a partition has left are NOT_ASKED, and with a
    flag (of a RunFlag on the driver) those of all other partitions, also of tasks that are repeated, retries included.
    Only calls that are under way at that moment can still be made. A task never fails for it, so answers aren't lost."""
    result = schema(RESULT)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider, slots, started, stopped = open_provider(), threading.Semaphore(policy.hung + at_once), 0, threading.Event()

        def asked(request: dict) -> dict:
            if stopped.is_set() or flag is not None and not flag.up():
                raise Stopped
            return provider(request)

        def one(index: int, request: dict) -> dict:
            rng = random.Random(index)
            if policy.staggered and index < at_once:
                policy.sleep(stagger(index, rng))
            try:
                return call(asked, request, policy, rng, slots)
            except Stopped:
                stopped.set()
                return {"error": NOT_ASKED, "attempts": 0}
            except CostIncurred as e:
                stopped.set()
                if flag is not None:
                    flag.stop(str(e))
                return {"error": str(e), "attempts": 1}

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    rows = list(pool.map(one, range(started, started + part.num_rows), part.to_pylist()))
                    started += part.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r.get(f.name) for r in rows], k) for f, k in zip(result.fields, kinds, strict=True))], [*part.schema.names, *result.names])

    return requests.mapInArrow(run, T.StructType([*requests.schema.fields, *result.fields]))
