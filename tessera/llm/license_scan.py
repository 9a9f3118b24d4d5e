"""License scan by ordered signature rules, in DataFrame functions alone.

A text is brought to words in lower case, each between two blanks, so that a rule is a plain regular expression over whole words and a place is a count of blanks.
The rules (`license_rules`) are written by hand as word patterns, each with label, keyword and priority: identifiers, texts of licenses, notices,
grants, names and mentions. A rule is tried only where its keyword occurs, and texts without any keyword skip the rules altogether. A detection is dropped when its interval lies inside that of a detection that goes before it: higher priority, then longer,
then earlier rule. The base phrases are counted on their own and are never dropped.

Defined cases: null and empty texts have no words, no places and score 0; an empty table gives an empty result; input columns other than
doc_id and text play no part but stay in `detections`; repeated rows each give a row; places of one label may touch; texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, SEPARATORS, UPPER
from .license_rules import CONFIDENCE, RULES

#: Phrases and labels of the contract.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
BASE_CONFIDENCE = 0.9
def pattern(words: str) -> str:
    """A word pattern as a regular expression: words part at blanks, `?` makes a word optional, `|` parts alternatives, `a:b` stands for two words."""
    out = ""
    for word in words.split():
        optional = word.endswith("?")
        body = word[:-1] if optional and not word.startswith("v?") else word
        parts = "|".join("".join(f" {w} " for w in alternative.split(":")) for alternative in body.split("|"))
        out += f"(?:{parts})?" if optional and body != word else f"(?:{parts})"
    return out


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(rule number, label, keyword as a spaced word, regular expression, priority, confidence)."""
    out = []
    for line in RULES:
        priority, label, keyword, words = line.split(" ", 3)
        out.append((len(out), label, f" {keyword} ", pattern(words), int(priority), CONFIDENCE[int(priority)]))
    return out


#: Every text that a rule or base phrase can match holds one of these words.
TRIGGERS = sorted({line.split(" ", 3)[2] for line in RULES} | {"license", "apache", "cc"})


def words_of(text: Column) -> Column:
    """The words of the text in lower case (A-Z only); null: none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS), ""), F.array().cast("array<string>"))


def spaced(words: Column) -> Column:
    """Every word between two blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def _count(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _places(norm: Column, expression: Column) -> Column:
    """array of (first, words) for each match, first counted in words from 0."""
    matches = F.transform(F.regexp_extract_all(norm, expression, F.lit(0)), _count)
    gaps = F.transform(F.split(norm, expression, -1), _count)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,words:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        return F.struct((first + x["words"]).alias("at"), F.array_append(acc["found"], F.struct(first.alias("first"), x["words"].alias("words"))).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("words")))
    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def _overlapping(hits: Column) -> Column:
    """The detections in groups of places that overlap, which keeps a text with thousands of places from comparing all with all."""
    kind = "array<struct<first:int,words:int,label:string,priority:int,confidence:double,rule:int>>"
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(*[h[c].alias(c) for c in ("first", "words", "label", "priority", "confidence", "rule")])))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("closed"))

    def step(acc: Column, d: Column) -> Column:
        end = d["first"] + d["words"]
        joined = F.struct(F.greatest(acc["end"], end).alias("end"), F.array_append(acc["open"], d).alias("open"), acc["closed"].alias("closed"))
        fresh = F.struct(end.alias("end"), F.array(d).alias("open"), F.array_append(acc["closed"], acc["open"]).alias("closed"))
        return F.when(d["first"] < acc["end"], joined).otherwise(fresh)

    return F.aggregate(ordered, start, step, lambda acc: F.array_append(acc["closed"], acc["open"]))


def _named(label: str):
    return lambda x: F.struct(x["first"].alias("first"), F.lit(label).alias("label"))


def detections(docs: DataFrame) -> DataFrame:
    """docs with n_words, base (places of base phrases: first, label) and found (detections that stand: label, first, words, priority, confidence, rule)."""
    made = {"n_words", "base", "found", "norm_", "words_"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    triggers = F.array(*[F.lit(w) for w in TRIGGERS])
    split = docs.select(*kept, words_of(F.col("text")).alias("words_"))
    spaced_ = split.select(*kept, F.size("words_").cast("long").alias("n_words"), F.when(F.arrays_overlap("words_", triggers), spaced(F.col("words_"))).alias("norm_"))
    base = F.flatten(F.array(*[
        F.when(F.contains("norm_", F.lit(pattern(phrase).replace("(?:", "").replace(")", ""))), F.transform(_places(F.col("norm_"), F.lit(pattern(phrase))), _named(label)))
        .otherwise(F.array().cast("array<struct<first:int,label:string>>"))
        for phrase, label in BASE
    ]))
    table = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(expression).alias("expression"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))
        for n, label, key, expression, priority, confidence in rules()
    ])
    open_rules = F.filter(table, lambda r: F.contains(F.col("norm_"), r["key"]))
    hits = F.flatten(F.transform(open_rules, lambda r: F.transform(_places(F.col("norm_"), r["expression"]), lambda x: F.struct(
        r["label"].alias("label"), x["first"].alias("first"), x["words"].alias("words"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["rule"].alias("rule")))))
    none = F.array().cast("array<struct<label:string,first:int,words:int,priority:int,confidence:double,rule:int>>")
    raw = spaced_.select("*", F.when(F.col("norm_").isNotNull(), base).otherwise(F.array().cast("array<struct<first:int,label:string>>")).alias("base"), F.when(F.col("norm_").isNotNull(), hits).otherwise(none).alias("hits_"))

    def before(e: Column, d: Column) -> Column:
        inside = (e["first"] <= d["first"]) & (e["first"] + e["words"] >= d["first"] + d["words"])
        equal = (e["priority"] == d["priority"]) & ((e["words"] > d["words"]) | ((e["words"] == d["words"]) & (e["rule"] < d["rule"])))
        return inside & ((e["priority"] > d["priority"]) | equal)

    return raw.withColumn("found", F.flatten(F.transform(_overlapping(F.col("hits_")), lambda c: F.filter(c, lambda d: ~F.exists(c, lambda e: before(e, d)))))).drop("hits_", "norm_")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    starts = F.transform("base", lambda x: x["first"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.array_distinct(F.transform("found", lambda x: x["label"]))))
    sure = F.transform("found", lambda x: x["confidence"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0), F.coalesce(F.array_max(sure), F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """DuckDB SQL for digest(detections(documents)) with the same rules; its regular expressions are those of Spark."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {quoted(label)}, {quoted(key)}, {quoted(e)}, {p}, {c:g})" for n, label, key, e, p, c in rules())
    # the base places on their own, word by word, without the rules' expressions
    base = " UNION ALL ".join(
        f"SELECT r, {quoted(label)} AS label, i - 1 AS first FROM u WHERE {' AND '.join(f'w[i + {k}] = {quoted(word)}' for k, word in enumerate(phrase.split()))}" for phrase, label in BASE
    )
    places = """SELECT {keys}, CAST(g AS INTEGER) + CAST(coalesce(sum(g2 + w) OVER (PARTITION BY {part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS first, w AS words
      FROM (SELECT *, (length(p[i]) - length(replace(p[i], ' ', ''))) // 2 AS g, (length(p[i]) - length(replace(p[i], ' ', ''))) // 2 AS g2, (length(m[i]) - length(replace(m[i], ' ', ''))) // 2 AS w
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(norm, e) AS m, string_split_regex(norm, e) AS p FROM {source})))"""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
n AS (SELECT r, doc_id, regexp_extract_all(t, '{ALNUM_WORD}') AS w, len(regexp_extract_all(t, '{ALNUM_WORD}')) AS n_words, ' ' || trim(regexp_replace(t, '{SEPARATORS}', '  ', 'g'), ' ') || ' ' AS norm FROM d),
rules(rule, label, key, e, priority, confidence) AS (VALUES {values}),
u AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM n),
bp AS ({base}),
h AS ({places.format(keys="r, label, priority, confidence, rule", part="r, rule", source="(SELECT r, norm, rules.* FROM n JOIN rules ON contains(norm, key) WHERE regexp_matches(norm, e))")}),
f AS (SELECT * FROM h AS d WHERE NOT EXISTS (SELECT 1 FROM h AS e WHERE e.r = d.r AND e.first <= d.first AND e.first + e.words >= d.first + d.words
      AND (e.priority > d.priority OR e.priority = d.priority AND (e.words > d.words OR e.words = d.words AND e.rule < d.rule)))),
b AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM bp GROUP BY r),
l AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT r, label FROM bp UNION ALL SELECT r, label FROM f) GROUP BY r),
c AS (SELECT r, max(CAST(confidence AS DOUBLE)) AS sure FROM f GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN {BASE_CONFIDENCE:g} ELSE 0 END, coalesce(sure, 0))::DOUBLE AS score
FROM n LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)
"""
