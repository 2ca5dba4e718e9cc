"""Alerts on new hits: channels that each get a batch, the failure of one kept from the others."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

Channel = Callable[[list[dict]], None]
#: Hits that a channel is told at once; more are told in further pages.
PAGE = 200


def stdout_channel(hits: list[dict]) -> None:
    for hit in hits:
        print(json.dumps(hit, ensure_ascii=False, default=str))


def file_channel(path: str) -> Channel:
    """Appends a line of JSON per hit."""

    def write(hits: list[dict]) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(json.dumps(hit, ensure_ascii=False, default=str) + "\n" for hit in hits)

    return write


def posting_channel(post: Callable[[str, bytes], None], url: str) -> Channel:
    """Sends a batch as one JSON document through a transport that is handed in."""
    return lambda hits: post(url, json.dumps({"hits": hits}, ensure_ascii=False, default=str).encode())


def alerting(channels: dict[str, Channel]) -> Callable[[DataFrame], dict[str, str | None]]:
    """A function for ``watch.poll``: tells every channel of all hits, page by page, and gives each one's error, if any.

    A channel that fails is told no further page of the batch; the others are.
    """

    def tell(fresh: DataFrame) -> dict[str, str | None]:
        errors: dict[str, str | None] = dict.fromkeys(channels)
        rows = (r.asDict() for r in fresh.orderBy("rule_id", "url").toLocalIterator())
        while page := list(itertools.islice(rows, PAGE)):
            for name, channel in channels.items():
                if errors[name] is None:
                    try:
                        channel(page)
                    except Exception as e:
                        errors[name] = f"{type(e).__name__}: {e}"
        return errors

    return tell


def readiness(channels: dict[str, tuple[str, ...]], settings: dict[str, str]) -> dict[str, list[str]]:
    """The settings that each channel still lacks."""
    return {name: [s for s in needed if not settings.get(s)] for name, needed in channels.items()}
