"""JSON out of model replies: fences, balanced blocks, trailing commas, scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def greedy_object(text: Column) -> Column:
    """From the first { to the last }; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def greedy_array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def without_fences(text: Column) -> Column:
    inner = F.regexp_replace(F.trim(text), r"(?s)^```+\s*(?i:json)?\s*", "")
    return F.trim(F.regexp_replace(inner, r"(?s)\s*```+$", ""))


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def _balanced(text: str | None, arrays_first: bool) -> str | None:
    if text is None:
        return None
    kinds = [("[", "]"), ("{", "}")]
    if not arrays_first:
        kinds.sort(key=lambda k: text.find(k[0]) if k[0] in text else len(text))
    for opened, closed in kinds:
        depth, first = 0, text.find(opened)
        for i in range(first, len(text) if first >= 0 else first):
            depth += (text[i] == opened) - (text[i] == closed)
            if depth == 0:
                return text[first : i + 1]
    return None


def balanced_block(text: Column, arrays_first: bool = False) -> Column:
    """The first balanced block, whichever bracket comes first; arrays_first prefers an array wherever it stands. Quotes are not looked at."""

    @F.pandas_udf("string")
    def block(values: pd.Series) -> pd.Series:
        return values.map(lambda t: _balanced(t, arrays_first))

    return block(text)


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def repaired(text: Column, arrays_first: bool = False) -> Column:
    """JSON text: the whole reply, else its balanced block, else that without trailing commas, else null."""
    plain = without_fences(text)
    block = balanced_block(plain, arrays_first)
    return F.coalesce(_valid(plain), _valid(block), _valid(without_trailing_commas(block)))


def answer(reply: Column) -> Column:
    """(answer, error): the answer field of the reply's object; a reply that isn't JSON is the answer itself, flagged."""
    obj = _valid(greedy_object(reply))
    return F.struct(F.coalesce(F.get_json_object(obj, "$.answer"), F.when(obj.isNull(), F.trim(reply)), F.lit("")).alias("answer"), obj.isNull().alias("error"))


def grade(reply: Column, best: float = 5.0) -> Column:
    """The score of a grading reply over `best`, held to 0..1; unreadable: 0."""
    raw = F.get_json_object(_valid(greedy_object(reply)), "$.score").try_cast("double")
    return unit_score(raw, best)


def unit_score(raw: Column, best: float = 5.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0)) / F.lit(best)))


def decisions(reply: Column) -> Column:
    """array of (original_name, target_canonical) from an object with `decisions` or a bare array; unreadable: null. The action is not used."""
    item = "array<struct<original_name:string,action:string,target_canonical:string>>"
    text = repaired(reply)
    found = F.when(F.trim(text).startswith("["), F.from_json(text, item)).otherwise(F.from_json(text, f"struct<decisions:{item}>")["decisions"])
    return F.transform(found, lambda d: F.struct(d["original_name"].alias("original_name"), F.coalesce(d["target_canonical"], d["original_name"]).alias("target_canonical")))
