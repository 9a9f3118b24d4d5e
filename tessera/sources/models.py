"""Interfaces of model calls. The engine knows callables only; providers are the caller's, and these are the stand-ins and wrappers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

Call = Callable[[str], str]
STRICTER = "\n\nReply with valid JSON and nothing else."


def parse(reply: str) -> object | None:
    """The JSON value of a reply: whole, between the first opening and the last closing bracket, or that without trailing commas; None if there is none."""
    block = re.search(r"[\[{].*[\]}]", reply, re.DOTALL)
    for candidate in (reply.strip(), block[0] if block else "", re.sub(r",(\s*[}\]])", r"\1", block[0]) if block else ""):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def with_retries(call: Call, retries: int = 3) -> Call:
    """A call whose reply is JSON: one try and some more with a stricter prompt, then the error. Bounded, and free of side effects, so a task may be run again."""

    def run(prompt: str) -> str:
        last: Exception | None = None
        for attempt in range(retries + 1):
            try:
                reply = call(prompt + STRICTER * (attempt > 0))
                if parse(reply) is not None:
                    return reply
                last = ValueError("the reply is not JSON")
            except Exception as e:  # noqa: BLE001  any provider's error
                last = e
        raise last or ValueError("no reply")

    return run


def pattern_extractor(pattern: str = r"(\w+) (is|has|makes) (\w+)") -> Call:
    """The offline stand-in for triple extraction: subject, verb and object of plain clauses."""

    def run(chunk: str) -> str:
        node = lambda name: {"name": name, "type": "Concept", "abstraction_level": "Universal"}
        return json.dumps({"triples": [{"source": node(s), "relation": v.upper(), "target": node(o), "properties": {"modality": "Fact", "provenance": chunk[:80]}} for s, v, o in re.findall(pattern, chunk)]})

    return run
