"""Validation of decks by something outside: each deck to ok, error and result; no failure ends the job."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from .metrics import success_rate

TIMEOUT, WORKERS = 60, 8


def command(argv: list[str], timeout: int = TIMEOUT) -> Callable[[str], dict]:
    """A validator that gives the deck to a program and reads its JSON reply."""

    def run(deck: str) -> dict:
        try:
            done = subprocess.run(argv, input=deck, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return {"error": f"no reply in {timeout} s"}
        except OSError as e:
            return {"error": f"cannot run: {e}"}
        try:
            reply = json.loads(done.stdout)
        except ValueError:
            return {"error": (done.stderr or done.stdout or "no reply").strip()[:500]}
        return reply if isinstance(reply, dict) else {"result": reply}

    return run


def validated(decks: DataFrame, validator: Callable[[str], dict], id: str = "seq", deck: str = "deck", workers: int = WORKERS) -> DataFrame:
    """(id, ok, error, result as JSON) of each deck; a reply with an error, or an exception, is not ok.

    A task has up to `workers` decks under way at a time: a validator mostly waits for a program."""

    def one(text: str | None) -> tuple:
        try:
            reply = validator(text or "")
        except Exception as e:  # whatever a validator does becomes the row's error
            reply = {"error": f"{type(e).__name__}: {e}"}
        error = reply.get("error")
        return not error, error or None, None if error else json.dumps(reply, ensure_ascii=False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in frames:
                out = pd.DataFrame(list(pool.map(one, pdf[deck])), columns=["ok", "error", "result"], index=pdf.index)
                yield pd.concat([pdf[[id]], out], axis=1)

    return decks.select(id, deck).mapInPandas(run, f"{id} {decks.schema[id].dataType.simpleString()}, ok boolean, error string, result string")


def rate(checked: DataFrame) -> DataFrame:
    """One row (n, n_ok, rate) of validated decks; the rate of none is 0."""
    return success_rate(checked)
