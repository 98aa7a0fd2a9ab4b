"""Generators: the one step outside Spark's plan, with rate limits, retries, fallback and offline stand-ins."""

from __future__ import annotations

import heapq
import math
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflux.errors import AuthError, ConfigError, FolioError, GenerationError, ProviderError, RateLimitError, TransientError
from folioflux.operators.context import ABSTENTION


@dataclass(frozen=True)
class Usage:
    provider: str
    model: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


@dataclass(frozen=True)
class Generation:
    text: str
    usage: Usage


class Generator(Protocol):
    context_window: int
    max_output_tokens: int

    def generate(self, system: str, user: str) -> Generation: ...


class ScriptedGenerator:
    """Answers in turn; exceptions among them are raised."""

    def __init__(self, answers: Sequence[str | Exception], context_window: int = 8192, max_output_tokens: int = 512):
        self.answers, self.at = list(answers), 0
        self.context_window, self.max_output_tokens = context_window, max_output_tokens

    def generate(self, system: str, user: str) -> Generation:
        answer = self.answers[self.at % len(self.answers)]
        self.at += 1
        if isinstance(answer, Exception):
            raise answer
        return Generation(answer, Usage("scripted", "scripted", len(user) // 4, len(answer) // 4))


class ExtractiveGenerator:
    """The first sentence of the first block, cited; the abstention without a block."""

    context_window, max_output_tokens = 8192, 512

    def generate(self, system: str, user: str) -> Generation:
        block = re.search(r"^\[(\d+)\]\n(.+?)(?:[.!?](?:\s|$)|\n|\Z)", user, re.M | re.S)
        text = f"{block[2].strip()}. [{block[1]}]" if block else ABSTENTION
        return Generation(text, Usage("extractive", "first-sentence", len(user) // 4, len(text) // 4))


class Allowance:
    """Requests and tokens a minute and requests a day, for one task.

    Each limit is a schedule: a cost moves the time at which the limit would be used up
    by its share of the period, and a request may go once that time is no more than a period
    away. A cost beyond a whole period's limit could never go and is refused.
    """

    def __init__(self, rpm: int | None = None, tpm: int | None = None, rpd: int | None = None, clock: Callable[[], float] = time.monotonic):
        if any(n is not None and n < 1 for n in (rpm, tpm, rpd)):
            raise ConfigError("a limit must be 1 or more", rpm=rpm, tpm=tpm, rpd=rpd)
        self.clock, self.closed_until = clock, -math.inf
        self.limits = [(n, period, by_tokens) for n, period, by_tokens in ((rpm, 60.0, False), (tpm, 60.0, True), (rpd, 86400.0, False)) if n]
        self.used_up = [-math.inf] * len(self.limits)

    def close(self, seconds: float) -> None:
        """Nothing goes for so long."""
        self.closed_until = max(self.closed_until, self.clock() + seconds)

    def book(self, tokens: int = 0) -> float:
        """0 if a request may go now, and then it is booked; otherwise the seconds until it may be asked for again."""
        now = self.clock()
        fresh = []
        for (n, period, by_tokens), at in zip(self.limits, self.used_up, strict=True):
            cost = tokens if by_tokens else 1
            if cost > n:
                raise ConfigError("a request costs more than the limit of a period", cost=cost, limit=n)
            fresh.append(max(at, now) + cost * period / n)
        wait = max([self.closed_until - now, *(at - now - period for at, (_, period, _) in zip(fresh, self.limits, strict=True))], default=0.0)
        if wait > 1e-9:
            return wait
        self.used_up = fresh
        return 0.0


@dataclass(frozen=True)
class Retries:
    """How often a request is tried again, and the ceilings of its pauses, which double."""

    more: int = 3
    first: float = 0.5
    ceiling: float = 30.0

    def __post_init__(self):
        if self.more < 0 or min(self.first, self.ceiling) <= 0:
            raise ConfigError("retries must be 0 or more and pauses positive")

    def pauses(self, rng: random.Random) -> Iterator[float]:
        for ceiling in (min(self.ceiling, self.first * (1 << k)) for k in range(self.more)):
            yield rng.random() * ceiling


def asked(generator: Generator, requests: Sequence[tuple[str, str]], retries: Retries = Retries(), allowance: Allowance | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> list[Generation | FolioError]:  # noqa: B008
    """What a generator makes of a batch of (system, user): an answer or an error for each.

    Requests wait in a queue by the time they are due. One that a service turns down for now
    goes back into it, due after the pause the service asked for or else its own next one, so
    the others go on meanwhile; a pause the service asked for also closes the allowance.
    """
    rng, out = rng or random.Random(), [None] * len(requests)
    queue = [(-math.inf, k, retries.pauses(rng)) for k in range(len(requests))]
    while queue:
        due, k, pauses = heapq.heappop(queue)
        system, user = requests[k]
        try:
            wait = max(due - clock(), allowance.book((len(system) + len(user) + 3) // 4) if allowance and due <= clock() else 0.0)
            if wait > 0:
                heapq.heappush(queue, (clock() + wait, k, pauses))
                sleep(max(0.0, queue[0][0] - clock()))
                continue
            out[k] = generator.generate(system, user)
        except (RateLimitError, TransientError) as e:
            out[k] = e
            wanted = getattr(e, "retry_after", None)
            own = next(pauses, None)
            if own is not None:
                if wanted and allowance:
                    allowance.close(wanted)
                heapq.heappush(queue, (clock() + (own if wanted is None or wanted < 0 else wanted), k, pauses))
        except FolioError as e:
            out[k] = e
    return out


class Chain:
    """Generators in order of preference: what one cannot answer goes on to the next. Refused credentials stand, as the others would hide them."""

    def __init__(self, *generators: Generator):
        if not generators:
            raise ConfigError("a chain needs a generator")
        self.generators = generators
        self.context_window, self.max_output_tokens = (min(getattr(g, c) for g in generators) for c in ("context_window", "max_output_tokens"))

    def asked(self, requests: Sequence[tuple[str, str]], **how) -> list[Generation | FolioError]:
        out: list = [GenerationError("no generator answered")] * len(requests)
        left = range(len(requests))
        for g in self.generators:
            for k, got in zip(left, asked(g, [requests[k] for k in left], **how), strict=True):
                out[k] = got
            left = [k for k in left if isinstance(out[k], ProviderError) and not isinstance(out[k], AuthError)]
        return out

    def generate(self, system: str, user: str) -> Generation:
        got = self.asked([(system, user)], retries=Retries(0))[0]
        if isinstance(got, Exception):
            raise got
        return got


def answer(prompts: DataFrame, make: Callable[[], Generator], retries: Retries = Retries(), allow: Callable[[], Allowance] | None = None) -> DataFrame:  # noqa: B008
    """(query_id, answer, provider, model, prompt_tokens, completion_tokens, error, error_kind); queries without blocks get the abstention and no call.

    A generator and an allowance are made once a task, and a batch of prompts is asked at once; a failing call becomes its row's error.
    """
    kind = prompts.schema["query_id"].dataType.simpleString()
    names = ["answer", "provider", "model", "prompt_tokens", "completion_tokens", "error", "error_kind"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator, allowance = make(), allow() if allow else None
        ask = generator.asked if isinstance(generator, Chain) else lambda requests, **how: asked(generator, requests, **how)
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True))
            got = iter(ask([(s, u) for s, u, blocks in rows if blocks], retries=retries, allowance=allowance))
            out = []
            for _, _, blocks in rows:
                g = next(got) if blocks else Generation(ABSTENTION, Usage("none", "none"))
                if isinstance(g, Exception):
                    out.append((*[None] * 5, str(g), type(g).__name__))
                else:
                    out.append((g.text, g.usage.provider, g.usage.model, g.usage.prompt_tokens, g.usage.completion_tokens, None, None))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["query_id", *names])

    schema = f"query_id {kind}, answer string, provider string, model string, prompt_tokens long, completion_tokens long, error string, error_kind string"
    return prompts.select("query_id", "system", "user", "n_blocks").mapInArrow(run, schema)
