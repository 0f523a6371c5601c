"""Questionnaires on a stream, against the batch rules and a dialogue by force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from estimora.operators import validation
from estimora.sources.dims import FIELDS
from estimora.sources.projects import projects
from estimora.streaming import dialogue
from estimora.streaming.watch import _ROCKS

D = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp, project_id long, action string, answer string"


def streamed(spark, tmp_path, batches, **options):
    """All rows of a stream that reads a file for each batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    folder, out = tmp_path / "in", []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"{k}"))
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(folder))
        q = dialogue.dialogue(events, **options).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return out


def test_progress_is_that_of_the_batch(spark, tmp_path):
    """Answers up to the first invalid one leave each project where dialogue_progress has it."""
    checked = validation.validated(validation.long_answers(projects(spark, D).limit(40))).cache()
    want = {r["project_id"]: (r["next_ord"], r["complete"]) for r in validation.progress(checked).collect()}
    start = datetime(2026, 1, 1)
    rows = [(r["project_id"] * 100 + r["ord"], start + timedelta(seconds=r["ord"]), r["project_id"], "submit", r["answer"]) for r in checked.collect() if r["ord"] <= want[r["project_id"]][0]]
    found = {}
    for r in streamed(spark, tmp_path, [[r for r in rows if r[0] % 100 <= 4], [r for r in rows if r[0] % 100 > 4]]):
        found.setdefault(r["project_id"], []).append(r)
    assert found.keys() == want.keys()
    cleaned = {(r["project_id"], r["ord"]): (r["valid"], r["error"], r["cleaned"]) for r in checked.collect()}
    for project, events in found.items():
        last = max(events, key=lambda r: r["event_id"])
        assert (last["answered"] + 1, last["complete"]) == want[project]
        assert all((r["valid"], r["error"], r["cleaned"]) == cleaned[project, r["ord"]] for r in events)
        if last["complete"]:
            assert last["context"] == [cleaned[project, k][2] for k in range(1, 12)]


def test_dialogues_by_force(spark, tmp_path):
    """Random answers, resets and silence in three batches, against a cursor in plain Python."""
    rng = random.Random(4)
    pool = ["", "x", "ok", "3", "a long answer of its own", "  ", "<>", "y" * 501, "nobody", "five testers"]
    start, rows = datetime(2026, 1, 1), []
    for k in range(400):
        action = "reset" if rng.random() < 0.03 else "submit"
        rows.append((k, start + timedelta(seconds=k), rng.randrange(4) if k else None, action, rng.choice(pool) if rng.random() < 0.95 else None))
    batches = [rows[:100], rows[100:250], rows[250:], [(1000, start + timedelta(hours=3), 99, "submit", "zz")], [(1001, start + timedelta(hours=4), 99, "submit", "zz")]]
    found = streamed(spark, tmp_path, batches, patience="1 hour")
    every = [(f, a) for f in FIELDS for a in {r[4] for r in rows}]
    rules = {(r["key"], r["answer"]): (r["valid"], r["error"], r["cleaned"]) for r in validation.validated(spark.createDataFrame(every, "key string, answer string")).collect()}
    state, want = {}, {}
    for k, _, project, action, answer in rows:
        if project is None:
            continue
        answers = state.setdefault(project, [])
        at = len(answers) + 1
        if action == "reset":
            answers.clear()
            want[k] = ("reset", 1, True, "", "", 0)
        elif at > 11:
            want[k] = ("submit", at, True, "", answer or "", 11)
        else:
            valid, error, cleaned = rules[FIELDS[at - 1], answer]
            if valid:
                answers.append(cleaned)
            want[k] = ("submit", at, valid, error, cleaned, len(answers))
    got = {r["event_id"]: (r["outcome"], r["ord"], r["valid"], r["error"], r["cleaned"], r["answered"]) for r in found if r["event_id"] is not None and r["event_id"] < 1000}
    assert got == want
    expired = {r["project_id"]: r["answered"] for r in found if r["outcome"] == "timed out"}
    assert expired == {p: len(a) for p, a in state.items()}


def test_sorts_of_questions():
    assert {dialogue.sort_of(f) for f in FIELDS} == set(dialogue.SORTS) and len(dialogue.SORTS) == 5
