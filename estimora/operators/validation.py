"""Validation of questionnaire answers, one row for each answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimora.functions.text import contains_any, stripped
from estimora.functions.words import NOBODY_WORDS, NUMBER_WORDS
from estimora.sources.dims import FIELDS

# Limits, characters that are taken out, and messages.
MOST, NAME_MOST, LONG_LEAST, LEAST = 500, 50, 10, 2
DANGEROUS, NOT_IN_NAMES = r"[<>{}|\\]", r'[/\\:*?"<>|]'
LONG_FIELDS = ("project_description", "known_risks")
SHORT_FIELDS = ("team_qa_size", "team_dev_size", "timeline", "methodology", "existing_automation", "compliance_requirements")
TEAM_FIELDS = ("team_qa_size", "team_dev_size")
EMPTY = "Please provide an answer to continue."
NOTHING_LEFT = "Please provide a valid answer."
TOO_LONG = "Answer is too long (max 500 characters). Please be more concise."
BAD_NAME = "Project name contains only invalid characters. Please use letters and numbers."
SHORT_NAME = "Project name is too short. Please use at least 2 characters."
TOO_SHORT = "Answer seems too short — please be more specific (at least 10 characters)."
NO_NUMBER = "Please specify a number (e.g., '3') or describe the setup (e.g., 'no dedicated QA')."
DEFAULT_SHORT = "Answer seems too short — please be more specific."


def project_name(c: Column) -> Column:
    """A name as it can stand in file names, before it is cut to its greatest length."""
    return F.regexp_replace(stripped(F.regexp_replace(c, NOT_IN_NAMES, "")), r"(?U)\s+", "_")


def validated(answers: DataFrame) -> DataFrame:
    """answers(key, answer, ...) with valid, error and cleaned: the first rule that fails decides."""
    key, name = F.col("key"), F.col("_name")
    out = answers.withColumn("_raw", stripped(F.coalesce("answer", F.lit(""))))
    out = out.withColumn("_text", F.regexp_replace("_raw", DANGEROUS, "")).withColumn("_name", project_name(F.col("_text")))
    says_size = F.col("_text").rlike(r"(?U)\d") | contains_any(F.col("_text"), NUMBER_WORDS + NOBODY_WORDS)
    error = (
        F.when(F.col("_raw") == "", EMPTY)
        .when(F.col("_text") == "", NOTHING_LEFT)
        .when(F.length("_text") > MOST, TOO_LONG)
        .when((key == "project_name") & (name == ""), BAD_NAME)
        .when((key == "project_name") & (F.length(name) < LEAST), SHORT_NAME)
        .when(key.isin(*LONG_FIELDS) & (F.length("_text") < LONG_LEAST), TOO_SHORT)
        .when(key.isin(*TEAM_FIELDS) & ~says_size, NO_NUMBER)
        .when(~key.isin("project_name", *LONG_FIELDS, *SHORT_FIELDS) & (F.length("_text") < LEAST), DEFAULT_SHORT)
        .otherwise("")
    )
    out = out.withColumn("error", error).withColumn("valid", F.col("error") == "")
    cleaned = F.when(~F.col("valid"), "").when(key == "project_name", F.substring(name, 1, NAME_MOST)).otherwise(F.col("_text"))
    return out.withColumn("cleaned", cleaned).drop("_raw", "_text", "_name")


def long_answers(projects: DataFrame) -> DataFrame:
    """Projects as rows of project_id, ord, key and answer."""
    pairs = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(f).alias("key"), F.col(f).alias("answer")) for k, f in enumerate(FIELDS, 1)))
    return projects.select("project_id", F.explode(pairs).alias("a")).select("project_id", "a.*")


def progress(checked: DataFrame) -> DataFrame:
    """For each project: answered, valid ones, whether it is complete, and the next question's number.

    An answer counts only if all before it are valid, as in a dialogue that asks again."""
    bad = F.min(F.when(~F.col("valid"), F.col("ord")))
    return checked.groupBy("project_id").agg(
        F.count(F.when(F.coalesce(stripped(F.col("answer")), F.lit("")) != "", 1)).alias("answered"),
        F.count(F.when(F.col("valid"), 1)).alias("n_valid"),
        (F.count(F.when(F.col("valid"), 1)) == len(FIELDS)).alias("complete"),
        F.coalesce(bad, F.lit(len(FIELDS) + 1)).cast("int").alias("next_ord"),
    )


def overlaid(projects: DataFrame, templates: DataFrame, choice: str) -> DataFrame:
    """Projects with the fields of the template that column `choice` names, where it names one."""
    chosen = templates.drop("label").withColumnsRenamed({f: f"t_{f}" for f in FIELDS}).withColumnRenamed("template", choice)
    out = projects.join(F.broadcast(chosen), choice, "left")
    return out.withColumns({f: F.coalesce(f"t_{f}", f) for f in FIELDS}).drop(*(f"t_{f}" for f in FIELDS))
