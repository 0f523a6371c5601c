"""Text generation by external providers, with fallback: the data flow around it.

A provider is a function that is built once for each task and gives a reply to a prompt, or its parts
one after another. One that takes a second argument gets the limits of the call: how many tokens a
reply may have, and the temperature. The default one is deterministic and needs no network.

Calls of a task run at once up to a bound, as they mostly wait. A call that fails is tried again after
a pause that doubles; a provider that keeps failing is left alone for a while, and its prompts go to
the next one without delay, until a single call tries it again.
"""

from __future__ import annotations

import hashlib
import inspect
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[], Callable[..., "str | Iterable[str] | None"]]
# Limits of a call.
MAX_TOKENS, TEMPERATURE = 1500, 0.1


@dataclass(frozen=True)
class Limits:
    max_tokens: int = MAX_TOKENS
    temperature: float = TEMPERATURE


@dataclass(frozen=True)
class Policy:
    """Calls of a task at once; tries of a prompt at a provider, and seconds before the second; failed
    calls in a row that open a provider's breaker, and seconds until it is tried again."""

    at_once: int = 4
    tries: int = 1
    pause: float = 0.5
    failures: int = 5
    rest: float = 30.0


def stub() -> Callable[[str], str]:
    """A reply that follows from the prompt alone, in the form that the other operators read."""

    def reply(prompt: str) -> str:
        mark = hashlib.sha256(prompt.encode()).hexdigest()[:8]
        return f"EXECUTIVE_SUMMARY: Summary {mark}.\nASSUMPTIONS: - Team stays as it is\nRECOMMENDATIONS: - Start early\n| R01 | Risk {mark} | High | Medium | High |"

    return reply


class Breaker:
    """Whether a provider may be called: closed, open for a while after many failures in a row, then
    half open for one call, which closes or opens it again."""

    def __init__(self, failures: int, rest: float, clock: Callable[[], float] = time.monotonic):
        self.failures, self.rest, self.clock = failures, rest, clock
        self.failed, self.until, self.trying = 0, 0.0, False
        self.lock = threading.Lock()

    def allows(self) -> bool:
        with self.lock:
            if self.failed < self.failures:
                return True
            if self.trying or self.clock() < self.until:
                return False
            self.trying = True
            return True

    def tell(self, ok: bool) -> None:
        with self.lock:
            self.trying = False
            self.failed = 0 if ok else self.failed + 1
            if self.failed >= self.failures:
                self.until = self.clock() + self.rest


class Chain:
    """The providers of a task, in the order in which they are asked."""

    def __init__(self, providers: list[Provider], limits: Limits, policy: Policy):
        self.limits, self.policy = limits, policy
        self.calls = [(call, len(inspect.signature(call).parameters) > 1, Breaker(policy.failures, policy.rest)) for call in (make() for make in providers)]

    def ask(self, prompt: str | None) -> tuple[str | None, str | None]:
        """(reply, error): the first provider's that replies; null and the last error if none does.
        Parts of a reply are joined only when all have come, so that a provider that breaks off leaves
        nothing behind; an empty reply counts as one."""
        error = None
        for call, limited, breaker in self.calls:
            for attempt in range(self.policy.tries):
                if not breaker.allows():
                    error = error or "Unavailable: the provider failed too often"
                    break
                try:
                    answer = call(prompt or "", self.limits) if limited else call(prompt or "")
                    reply = answer if isinstance(answer, str) else "".join(p for p in answer or () if p)
                except Exception as e:  # noqa: BLE001  whatever a provider raises, the next one is asked
                    breaker.tell(False)
                    error = f"{type(e).__name__}: {e}"
                    if attempt + 1 < self.policy.tries:
                        time.sleep(self.policy.pause * 2**attempt)
                else:
                    breaker.tell(True)
                    return reply, None
        return None, error


def generated(rows: DataFrame, prompt: str, providers: list[Provider] | None = None, out: str = "reply", limits: Limits = Limits(), policy: Policy = Policy()) -> DataFrame:
    """rows with a reply and an error."""
    chain = providers or [stub]

    @F.pandas_udf(f"struct<{out}: string, {out}_error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        built = Chain(chain, limits, policy)
        with ThreadPoolExecutor(policy.at_once) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(built.ask, batch)), columns=[out, f"{out}_error"])

    return rows.withColumn("_r", run(F.col(prompt))).select("*", "_r.*").drop("_r")
