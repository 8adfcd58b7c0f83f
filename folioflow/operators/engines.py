"""Engines that speak texts: silence and a tone made here, and adapters of hosted and local servers.

An engine is asked for whole batches in Arrow stages. It must give the same clip for the same text and round, as Spark may
run a task again; hosted servers are sent seeds and requests that are safe to repeat."""

from __future__ import annotations

import hashlib
import json
import math
import os
import shlex
import struct
import subprocess
import time
import urllib.error
import urllib.request
import wave
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import UTC
from email.utils import parsedate_to_datetime
from io import BytesIO
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.timing import Guard
from folioflow.sources.config import BatchEngine, HttpEngine

RETRY_STATUS = frozenset((408, 429))  # and all from 500 on
BUSY_STATUS = 409
BUSY_WAIT_S = 5.0
BUSY_MOST_S = 300.0


class Engine(Protocol):
    """What an engine offers."""

    name: str
    sample_rate: int
    max_batch: int
    max_chars: int
    retries: int

    def speak(self, texts: Sequence[str], attempt: int = 0, capped: bool = True) -> list[np.ndarray]:
        """One float32 array for each text, in order; another ``attempt`` gives another take, without a cap where it isn't ``capped``."""

    def fingerprint(self) -> list[str]:
        """The parts that decide how a text sounds."""


def seconds_of(text: str, chars_s: float = 15.0, least_s: float = 0.2) -> float:
    return max(least_s, len(text) / chars_s)


@dataclass(frozen=True)
class Silence:
    sample_rate: int = 24_000
    max_batch: int = 64
    max_chars: int = 125
    retries: int = 0
    name: str = "silence"

    def speak(self, texts: Sequence[str], attempt: int = 0, capped: bool = True) -> list[np.ndarray]:
        return [np.zeros(int(seconds_of(t) * self.sample_rate), dtype=np.float32) for t in texts]

    def fingerprint(self) -> list[str]:
        return [self.name, str(self.sample_rate)]


@dataclass(frozen=True)
class Tone:
    sample_rate: int = 24_000
    max_batch: int = 64
    max_chars: int = 125
    hertz: float = 440.0
    level: float = 0.2
    retries: int = 0
    name: str = "tone"

    def speak(self, texts: Sequence[str], attempt: int = 0, capped: bool = True) -> list[np.ndarray]:
        made = []
        for t in texts:
            at = np.arange(int(seconds_of(t) * self.sample_rate)) / self.sample_rate
            made.append((self.level * np.sin(2 * np.pi * self.hertz * at)).astype(np.float32))
        return made

    def fingerprint(self) -> list[str]:
        return [self.name, str(self.sample_rate), str(self.hertz)]


def to_pcm16(samples: np.ndarray) -> bytes:
    return (np.clip(samples, -1.0, 1.0) * 32767).round().astype("<i2").tobytes()


def from_pcm16(data: bytes) -> np.ndarray:
    if len(data) % 2:
        raise ValueError("16-bit samples come in pairs of bytes")
    return np.frombuffer(data, dtype="<i2").astype(np.float32) / 32768


def to_wav(pcm: bytes, rate: int) -> bytes:
    out = BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(pcm)
    return out.getvalue()


def retry_after(value: str | None, most: float = 60.0) -> float | None:
    """Seconds a server asks to wait, given as a number or as a date; None where it says nothing that can be read."""
    if not value:
        return None
    try:
        seconds = float(value)
    except ValueError:
        try:
            when = parsedate_to_datetime(value)
        except ValueError:
            return None
        seconds = (when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() - time.time()
    return min(max(seconds, 0.0), most)


def post(url: str, body: bytes, headers: dict[str, str], timeout: float, retries: int = 5, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes:
    """Posts until it works: waits 1, 2, 4 ... seconds or what the server asks for, after faults that may pass."""
    for n in range(retries + 1):
        try:
            with opener(urllib.request.Request(url, body, headers), timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS and e.code < 500 or n == retries:
                raise
            wait = retry_after(e.headers.get("Retry-After") if e.headers else None)
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if n == retries:
                raise
            wait = None
        sleep(2.0**n if wait is None else wait)
    raise AssertionError


def ask_local(url: str, body: bytes, headers: dict[str, str], timeout: float, resends: int = 1, opener: Callable = urllib.request.urlopen) -> bytes:
    """Posts to a server on this machine, without waiting. Only a dropped connection is tried again: after a timeout the server
    may still be at work, and a second request would make it do the batch twice."""
    while True:
        try:
            with opener(urllib.request.Request(url, body, headers), timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError:
            raise
        except (urllib.error.URLError, ConnectionError) as e:
            cause = e.reason if isinstance(e, urllib.error.URLError) else e
            if not isinstance(cause, ConnectionError) or resends < 1:
                raise
        resends -= 1


def request_of(config: HttpEngine, text: str, key: str) -> tuple[str, dict, dict[str, str]]:
    """(url, body, headers) of one text in the shape the service takes; all ask for raw 16-bit samples."""
    base, rate = config.url.rstrip("/"), config.sample_rate
    headers = {"Content-Type": "application/json"}
    if config.style == "openai":
        return f"{base}/v1/audio/speech", {"model": config.model, "voice": config.voice, "input": text, "response_format": "pcm"}, headers | ({"Authorization": f"Bearer {key}"} if key else {})
    if config.style == "deepgram":
        return f"{base}/v1/speak?model={config.model or config.voice}&encoding=linear16&sample_rate={rate}&container=none", {"text": text}, headers | ({"Authorization": f"Token {key}"} if key else {})
    if config.style == "elevenlabs":
        return f"{base}/v1/text-to-speech/{config.voice}?output_format=pcm_{rate}", {"text": text, "model_id": config.model}, headers | ({"xi-api-key": key} if key else {})
    raise ValueError(f"no request style {config.style!r}")


def longest_fitting(fits: Callable[[int], bool], most: int) -> int:
    """The largest number of characters up to ``most`` that ``fits``, which must hold up to some size and not beyond; 0 if none."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low


def until_free(send: Callable[[], bytes], sleep: Callable = time.sleep, wait: float = BUSY_WAIT_S, most: float = BUSY_MOST_S) -> bytes:
    """Sends again while a server says it is busy with another client, up to ``most`` seconds in all."""
    waited = 0.0
    while True:
        try:
            return send()
        except urllib.error.HTTPError as e:
            if e.code != BUSY_STATUS or waited >= most:
                raise
        sleep(wait)
        waited += wait


@dataclass
class Server:
    """A local server in use; ``close`` ends it only if it was started here."""

    process: subprocess.Popen | None = None

    def close(self, grace_s: float = 10.0) -> None:
        if self.process is None or self.process.poll() is not None:
            return
        self.process.terminate()
        try:
            self.process.wait(grace_s)
        except subprocess.TimeoutExpired:
            self.process.kill()
            self.process.wait()

    def __enter__(self) -> Server:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


def healthy(url: str, timeout: float = 2.0) -> bool:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status == 200
    except OSError:
        return False


def start_or_adopt(command: Sequence[str], health_url: str, start_s: float = 180.0, poll_s: float = 0.5, is_healthy: Callable[[str], bool] = healthy) -> Server:
    """The server that answers already, or a new one once it answers; one that dies or stays silent is an error."""
    if is_healthy(health_url):
        return Server()
    server = Server(subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL))
    until = time.monotonic() + start_s
    while time.monotonic() < until:
        if server.process.poll() is not None:
            raise RuntimeError(f"{command[0]} ended with {server.process.returncode} before it answered")
        if is_healthy(health_url):
            return server
        time.sleep(poll_s)
    server.close()
    raise RuntimeError(f"{command[0]} didn't answer within {start_s:g} s")


@dataclass(frozen=True)
class Hosted:
    """A hosted engine: one request a text, raw 16-bit samples back."""

    config: HttpEngine
    name: str
    send: Callable = post

    sample_rate = property(lambda self: self.config.sample_rate)
    max_chars = property(lambda self: self.config.max_chars)
    max_batch = property(lambda self: self.config.concurrency)
    retries = property(lambda self: 0)

    def speak(self, texts: Sequence[str], attempt: int = 0, capped: bool = True) -> list[np.ndarray]:
        key = os.environ.get(self.config.key_variable, "") if self.config.key_variable else ""

        def one(text: str) -> np.ndarray:
            url, body, headers = request_of(self.config, text, key)
            return from_pcm16(self.send(url, json.dumps(body).encode(), headers, self.config.timeout_s))

        with ThreadPoolExecutor(self.config.concurrency) as pool:
            return list(pool.map(one, texts))

    def fingerprint(self) -> list[str]:
        return [self.name, self.config.style, self.config.url, self.config.voice, self.config.model, str(self.config.sample_rate)]


@dataclass(frozen=True)
class Served:
    """A local server: many texts a request, segments back to back with their sizes before them."""

    config: BatchEngine
    name: str
    send: Callable = ask_local

    sample_rate = property(lambda self: self.config.sample_rate)
    max_batch = property(lambda self: self.config.max_batch)
    retries = property(lambda self: self.config.retries)

    @property
    def max_chars(self) -> int:
        """The setting, or fewer characters where voice, text and the cap of new tokens would leave the model's context. A text
        takes a token for each byte, four for the widest character."""
        c = self.config
        if not c.context_tokens or not c.frame_rate:
            return c.max_chars
        fits = longest_fitting(lambda n: c.voice_tokens + 4 * n + self.new_tokens(n) <= c.context_tokens, c.max_chars)
        if not fits:
            raise ValueError(f"{self.name}: the voice leaves no room in a context of {c.context_tokens} tokens")
        return fits

    def new_tokens(self, chars: int) -> int:
        guard = Guard()
        return math.ceil((guard.base_s + guard.long_s * chars) * guard.slack * self.config.frame_rate)

    def speak(self, texts: Sequence[str], attempt: int = 0, capped: bool = True) -> list[np.ndarray]:
        cap = {"max_new_tokens": self.new_tokens(max(map(len, texts)))} if self.config.frame_rate and capped else {}
        body = json.dumps({"texts": list(texts), "seed": self.config.seed + attempt} | cap).encode()
        answer = until_free(lambda: self.send(self.config.url, body, {"Content-Type": "application/json"}, self.config.timeout_s))
        return segments(answer, len(texts))

    def fingerprint(self) -> list[str]:
        return [self.name, self.config.url, str(self.config.seed), str(self.config.sample_rate)]


def segments(data: bytes, count: int) -> list[np.ndarray]:
    """Clips of an answer: a count, the size of each in bytes, then the samples; all sizes must add up."""
    (n,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{n}I", data, 4)
    head = 4 + 4 * n
    if n != count or head + sum(sizes) != len(data):
        raise ValueError(f"{n} segments of {sum(sizes)} bytes for {count} texts and {len(data) - head} bytes")
    made, at = [], head
    for size in sizes:
        made.append(from_pcm16(data[at : at + size]))
        at += size
    return made


FACTORIES: dict[str, Callable[[object], Engine]] = {"silence": lambda _: Silence(), "tone": lambda _: Tone()}


def available(settings=None) -> list[str]:
    return sorted({*FACTORIES, *((settings.engines or {}) if settings else {})})


def create(name: str, settings=None) -> Engine:
    if name in FACTORIES:
        return FACTORIES[name](settings)
    config = (settings.engines or {}).get(name) if settings else None
    if config is None:
        raise ValueError(f"no engine {name!r}; there are {', '.join(available(settings))}")
    return (Served if isinstance(config, BatchEngine) else Hosted)(config, name)


def ready(engine: Engine):
    """A context in which the engine answers: the local server it names runs, started here where none does."""
    command, health = (getattr(getattr(engine, "config", None), c, "") for c in ("command", "health_url"))
    return start_or_adopt(shlex.split(command), health) if command and health else nullcontext()


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


SPOKEN = "fp16 string, key string, text string, attempt int, capped boolean, seconds double, sample_rate int, n_samples long, n_trimmed long, pcm binary"


def spoken(batched: DataFrame, engine: Engine) -> DataFrame:
    """Clips of (key, text, batch, attempt, capped), spoken batch by batch: a batch is one request and stays in one task. A clip
    is kept whole; ``n_trimmed`` is its length without quiet ends, which is what a chapter takes of it."""
    fp16 = digest(engine.fingerprint())[:16]

    def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (_, attempt, capped), group in pdf.groupby(["batch", "attempt", "capped"], sort=True):
                texts = group["text"].tolist()
                clips = engine.speak(texts, int(attempt), bool(capped))
                if len(clips) != len(group):
                    raise ValueError(f"{engine.name} gave {len(clips)} clips for {len(group)} texts")
                rate = engine.sample_rate
                sizes, pcm = [len(c) for c in clips], [to_pcm16(c) for c in clips]
                told = {"fp16": fp16, "key": group["key"].tolist(), "text": texts, "attempt": int(attempt), "capped": bool(capped), "seconds": [n / rate for n in sizes], "sample_rate": rate}
                yield pd.DataFrame(told | {"n_samples": sizes, "n_trimmed": [len(trimmed(from_pcm16(p), rate)) for p in pcm], "pcm": pcm})

    given = lambda c, other: F.coalesce(c, F.lit(other)) if c in batched.columns else F.lit(other)
    asked = batched.select("key", "text", "batch", given("attempt", 0).alias("attempt"), given("capped", True).alias("capped"))
    return asked.repartition("batch").sortWithinPartitions("batch").mapInPandas(speak, SPOKEN)


def trimmed(samples: np.ndarray, rate: int, frame_s: float = 0.010, floor_db: float = -40.0, pad_s: float = 0.050) -> np.ndarray:
    """``samples`` without quiet ends: frames far below the loudest go, a pad stays; silence and broken input stay as they are."""
    frame = max(1, round(rate * frame_s))
    if len(samples) < frame or not np.isfinite(samples).all():
        return samples
    padded = np.pad(samples.astype(np.float64), (0, -len(samples) % frame)).reshape(-1, frame)
    rms = np.sqrt((padded**2).mean(axis=1))
    loud = np.flatnonzero(rms >= rms.max() * 10 ** (floor_db / 20)) if rms.max() > 0 else []
    if not len(loud):
        return samples
    pad = round(rate * pad_s)
    return samples[max(0, loud[0] * frame - pad) : min(len(samples), (loud[-1] + 1) * frame + pad)]


def assembled(clips: Sequence[np.ndarray], gaps: Sequence[float], rate: int) -> tuple[np.ndarray, list[tuple[float, float]], float]:
    """A chapter's samples, the (start, end) of each clip in seconds, and its length; none gives a tenth of a second."""
    if len(clips) != len(gaps):
        raise ValueError("a gap for each clip")
    if not clips:
        return np.zeros(int(0.1 * rate), dtype=np.float32), [], 0.1
    parts, at, now = [], [], 0.0
    for clip, gap in zip(clips, gaps):
        parts += [clip, np.zeros(int(gap * rate), dtype=np.float32)]
        at.append((now, now + len(clip) / rate))
        now += len(clip) / rate + gap
    whole = np.concatenate(parts)
    return whole, at, len(whole) / rate
