"""The one opaque step: a model writes claims about a unit. Adapters are plugged in; the default is deterministic.

Results are kept by the digest of their input, so that only what changed is
asked again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unit input (JSON) -> answer (JSON). Runs in Spark tasks.
Adapter = Callable[[str], str]


def mock(request: str) -> str:
    """A deterministic answer: one event for each request line of the unit, titled by its first words."""
    lines = json.loads(request).get("lines", [])
    return json.dumps({"events": [{"title": " ".join(x["text"].split()[:6]), "kind": "question" if x["role"] == "user" else "outcome", "line": k} for k, x in enumerate(lines)]})


def checked(answer: str) -> str | None:
    """Why an answer is refused: not JSON, no list of events, or an event without title or kind; None where it is fine."""
    try:
        events = json.loads(answer)["events"]
    except (ValueError, KeyError, TypeError):
        return "unreadable answer"
    good = isinstance(events, list) and all(isinstance(e, dict) and isinstance(e.get("title"), str) and isinstance(e.get("kind"), str) for e in events)
    return None if good else "event without title or kind"


def ask(units: DataFrame, adapter: Adapter = mock, repairs: int = 1) -> DataFrame:
    """(unit_id, digest, answer, error, attempts) of units (unit_id, request); a refused answer is asked for again ``repairs`` times."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for unit_id, digest, request in zip(pdf["unit_id"], pdf["digest"], pdf["request"], strict=True):
                answer, error, n = None, "not asked", 0
                while error and n <= repairs:
                    answer, n = adapter(request), n + 1
                    error = checked(answer)
                rows.append((unit_id, digest, None if error else answer, error, n))
            yield pd.DataFrame(rows, columns=["unit_id", "digest", "answer", "error", "attempts"])

    keyed = units.select("unit_id", F.sha2("request", 256).alias("digest"), "request")
    return keyed.mapInPandas(run, f"unit_id {dict(units.dtypes)['unit_id']}, digest string, answer string, error string, attempts int")


def ask_changed(units: DataFrame, kept: DataFrame, adapter: Adapter = mock) -> DataFrame:
    """As ``ask``, but units whose digest is among ``kept`` (digest, answer) take the answer from there, with no attempt."""
    keyed = units.withColumn("digest", F.sha2("request", 256))
    known = keyed.join(kept.where("answer IS NOT NULL").select("digest", "answer").dropDuplicates(["digest"]), "digest").select("unit_id", "digest", "answer", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    return known.unionByName(ask(keyed.join(kept.where("answer IS NOT NULL").select("digest"), "digest", "left_anti").select("unit_id", "request"), adapter))


def claims(answers: DataFrame) -> DataFrame:
    """(unit_id, pos, title, kind, line): the events of good answers."""
    events = F.from_json("answer", "events array<struct<title:string,kind:string,line:int>>")["events"]
    return answers.where("answer IS NOT NULL").select("unit_id", F.posexplode(events).alias("pos", "e")).select("unit_id", "pos", "e.*")
