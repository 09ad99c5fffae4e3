"""A client that asks a completion service, with retries; one lives in each task that asks."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from lectern.plans.report import request

#: Answers that mean that trying again is of no use.
FINAL = (401, 403)
#: Answers that mean that the service can't hold to a schema.
NO_SCHEMA = (400, 422)


@dataclass
class Reply:
    status: int
    body: str = ""
    retry_after: float | None = None


Transport = Callable[[dict], Reply]


class Failed(Exception):
    pass


def wait(attempt: int, asked: float | None = None, chance: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: doubling up to 16, up to a quarter longer by chance, and never less than asked."""
    return max(min(2.0**attempt, 16.0) * (1 + chance() / 4), asked or 0.0)


def outermost(text: str) -> dict:
    """The JSON object of a text, or the one between its first and its last brace."""
    for t in (text, *re.findall(r"(?s)\{.*\}", text)):
        try:
            if isinstance(x := json.loads(t), dict):
                return x
        except ValueError:
            continue
    raise Failed("no JSON object in the answer")


@dataclass
class Client:
    """Callable with a batch of requests, as :class:`lectern.plans.pipeline.Answerer` wants it. ``transport`` sends a
    request's body; it must be picklable, as the client goes to the executors."""

    transport: Transport
    model: str
    terms: list[str] = field(default_factory=list)
    attempts: int = 4
    sleep: Callable[[float], None] = time.sleep
    schema: bool = True
    tokens_in: int = 0
    tokens_out: int = 0

    def body(self, batch: list[dict]) -> dict:
        kind = "json_schema" if self.schema else "json_object"
        return {"model": self.model, "messages": [{"role": "user", "content": request(self.terms, batch)}], "response_format": {"type": kind}}

    def __call__(self, batch: list[dict]) -> list[dict]:
        attempt = 0
        while True:
            reply = self.transport(self.body(batch))
            if reply.status == 200:
                answer = json.loads(reply.body)
                usage = answer.get("usage") or {}
                self.tokens_in += usage.get("prompt_tokens", 0)
                self.tokens_out += usage.get("completion_tokens", 0)
                return outermost(answer["choices"][0]["message"]["content"]).get("results", [])
            if reply.status in FINAL:
                raise Failed(f"refused with {reply.status}")
            if reply.status in NO_SCHEMA and self.schema:
                self.schema = False
                continue
            attempt += 1
            if attempt >= self.attempts:
                raise Failed(f"{reply.status} after {attempt} attempts")
            self.sleep(wait(attempt - 1, reply.retry_after))
