"""Accepted documents go back into the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimora.functions.text import blank, without_front_matter
from estimora.operators.report import write_documents

ACCEPTED = ("yes", "partially")


def accepted(feedback: DataFrame, notes_needed: bool = False) -> DataFrame:
    """Rows of feedback(strategy_id, feedback, notes, body) to keep, their body under a new header.
    With notes_needed a partial acceptance counts only with notes."""
    keep = F.col("feedback").isin(*ACCEPTED)
    if notes_needed:
        keep &= (F.col("feedback") != "partially") | ~blank(F.col("notes"))
    head = F.concat(F.lit("---\nfeedback: "), "feedback", F.lit("\nnotes: "), F.coalesce("notes", F.lit("")), F.lit("\n---\n\n"))
    return feedback.filter(keep).withColumn("body", F.concat(head, without_front_matter(F.col("body"))))


#: The folder of the corpus that accepted documents go to (fixed value).
FOLDER = "generated_strategies"


def kept(feedback: DataFrame, root: str, notes_needed: bool = False) -> None:
    """Write the accepted rows of feedback(strategy_id, file_name, feedback, notes, body) below the root
    of the corpus, where the next ingest or the watcher finds them; a name that is there is replaced."""
    write_documents(accepted(feedback, notes_needed).select("file_name", "body"), f"{root.rstrip('/')}/{FOLDER}")
