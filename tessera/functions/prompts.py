"""Prompts as columns, with our own wording; the cut lengths and the rule for thin contexts follow the reference behaviour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THIN_CONTEXT, TEACHER_CUT, JUDGE_CUT = 5, 5000, 8000
NO_CONTEXT = "(no context was found)"
EXTRACTION = "List the facts of the passage as JSON triples with source, relation, target and qualifiers.\n\nPassage:\n"
RESOLUTION = "Say for each name which canonical name stands for it, as JSON decisions.\n\nNames:\n"


def context_or_notice(context: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(context, F.lit("")))) < THIN_CONTEXT, NO_CONTEXT).otherwise(context)


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context, as JSON with the field answer.\n\nContext:\n"), context_or_notice(context), F.lit("\n\nQuestion: "), question)


def teacher_prompt(context: Column) -> Column:
    return F.concat(F.lit("Write one question with answer and key facts about this text, as JSON.\n\n"), F.substring(context, 1, TEACHER_CUT))


def judge_prompt(question: Column, facts: Column, prediction: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Grade the answer from 0 to 5, as JSON with the field score.\n\nQuestion: "), question, F.lit("\n\nFacts:\n"), F.array_join(facts, "\n"),
        F.lit("\n\nAnswer: "), prediction, F.lit("\n\nContext:\n"), F.substring(context, 1, JUDGE_CUT),
    )


def extraction_prompt(chunk: Column) -> Column:
    return F.concat(F.lit(EXTRACTION), chunk)


def resolution_prompt(names: Column) -> Column:
    return F.concat(F.lit(RESOLUTION), F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n"))
