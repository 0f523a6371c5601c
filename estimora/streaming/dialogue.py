"""Questionnaires that are answered on a stream: a cursor for each project, kept as state.

An answer is for the question that the project stands at. A valid one is kept and the next question
follows, an invalid one is asked again; `reset` starts anew; a project that is silent for longer than
`patience` of event time is dropped and said to have timed out. Answers to a complete questionnaire
are passed through.

Rules are columns: each answer is judged by the rules of every sort of question before it is dealt by
project, and the state picks the judgement that its question calls for.

Defined results: events of a batch go by time, then event_id; rows without a project are dropped; an
unknown action is a submission; events behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from estimora.operators.validation import LONG_FIELDS, SHORT_FIELDS, TEAM_FIELDS, validated
from estimora.sources.dims import FIELDS

SCHEMA = "project_id long, event_id long, outcome string, ord int, key string, valid boolean, error string, cleaned string, answered int, complete boolean, context array<string>"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def sort_of(field: str) -> str:
    """A question with the same rules."""
    for fields in (TEAM_FIELDS, LONG_FIELDS, SHORT_FIELDS):
        if field in fields:
            return fields[0] if fields is not SHORT_FIELDS else "timeline"
    return "project_name" if field == "project_name" else "project_type"


SORTS = tuple(dict.fromkeys(map(sort_of, FIELDS)))


def judged(events: DataFrame) -> DataFrame:
    """events(answer, ...) with a judgement (valid, error, cleaned) for each sort of question."""
    out = events
    for name in SORTS:
        out = validated(out.withColumn("key", F.lit(name))).withColumn(f"as_{name}", F.struct("valid", "error", "cleaned")).drop("key", "valid", "error", "cleaned")
    return out


class Cursor(StatefulProcessor):
    """The question that a project stands at, and its answers so far."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getValueState("answers", "answers array<string>")
        self.due = handle.getValueState("due", "due long")

    def _row(self, project, event_id, outcome, at, valid, error, cleaned, answers) -> tuple:
        whole = len(answers) == len(FIELDS)
        return (project, event_id, outcome, at, FIELDS[at - 1] if at <= len(FIELDS) else None, valid, error, cleaned, len(answers), whole, list(answers) if whole else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        answers = list(self.answers.get()[0]) if self.answers.exists() else []
        out, last = [], 0
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").to_dict("records"):
            last = max(last, int(r["ts"].timestamp() * 1000))
            at = len(answers) + 1
            if r["action"] == "reset":
                answers = []
                out.append(self._row(key[0], r["event_id"], "reset", 1, True, "", "", answers))
            elif at > len(FIELDS):
                out.append(self._row(key[0], r["event_id"], "submit", at, True, "", r["answer"] or "", answers))
            else:
                found = r[f"as_{sort_of(FIELDS[at - 1])}"]
                if found["valid"]:
                    answers.append(found["cleaned"])
                out.append(self._row(key[0], r["event_id"], "submit", at, bool(found["valid"]), found["error"], found["cleaned"], answers))
        self.answers.update((answers,))
        due = max(last + self.patience_ms, self.due.get()[0] if self.due.exists() else 0)
        if self.due.exists() and self.due.get()[0] != due:
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((due,))
        self.handle.registerTimer(due)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        answers = list(self.answers.get()[0]) if self.answers.exists() else []
        self.answers.clear()
        self.due.clear()
        yield self._frame([self._row(key[0], None, "timed out", len(answers) + 1, None, None, None, answers)])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_COLUMNS)
        return out.astype({"project_id": "int64", "event_id": "Int64", "ord": "int32", "answered": "int32", "valid": "boolean", "complete": "bool"})

    def close(self) -> None:
        pass


def dialogue(events: DataFrame, patience: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A row for each of events(event_id, ts, project_id, action, answer), and for each project that
    timed out. The session must keep state in RocksDB."""
    milliseconds = int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = events.filter("project_id IS NOT NULL").withWatermark("ts", late)
    return judged(rows).groupBy("project_id").transformWithStateInPandas(Cursor(milliseconds), SCHEMA, "Append", "EventTime")
