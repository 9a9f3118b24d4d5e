"""Text preparation as column expressions that stay on the JVM."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the reference behaviour: words that are no search terms.
QUERY_STOP_WORDS = ["what", "how", "does", "fix", "caused", "affect", "best", "for"]
#: Fixed values of the reference behaviour: words that don't bridge passages.
BRIDGE_STOP_WORDS = [
    "the", "and", "is", "of", "to", "in", "a", "that", "for", "with", "horse", "rider", "are", "this", "from", "have", "ride", "riding", "very",
    "much", "many", "some", "time", "good", "well", "should", "when", "then", "will", "what", "where", "training", "horses", "chapter", "page",
    "section", "figure", "table",
]
#: Fixed values of the reference behaviour: abbreviations whose full stops end no sentence, by language (is: Icelandic; all others: en).
ABBREVIATIONS = {
    "en": ["mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "e.g.", "i.e.", "etc.", "vs.", "al.", "fig.", "no.", "vol."],
    "is": ["þ.e.", "t.d.", "o.s.frv.", "o.fl.", "bls.", "sbr.", "þ.m.t.", "t.a.m."],
}
#: Fixed values of the reference behaviour: the stand-in for a protected full stop, and the text of an empty page.
PROTECTED_STOP, EMPTY_PAGE = "§", "[No extractable text on this page]"
#: Fixed value of the reference behaviour: what ends a sentence, with the closing marks behind it.
SENTENCE_END = r"([.!?…]+)([)\"»’”\]]*)(?U:\s)+"


def clean_text(text: Column) -> Column:
    """All white space (Unicode) to single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@cache
def _folding() -> tuple[str, str]:
    """Arguments of translate() that decompose and drop non-spacing marks, derived from the Unicode tables.

    Characters that decompose into several base characters (Hangul syllables) are left as they are; both sides of
    a comparison go through the same function, so they still match. `normalize_exact` decomposes them too.
    """
    changed, to, dropped = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            dropped.append(c)
        elif unicodedata.decomposition(c) and len(base := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) == 1 and base != c:
            changed.append(c)
            to.append(base)
    return "".join(changed + dropped), "".join(to)


def normalize_text(text: Column) -> Column:
    """Decomposed, without non-spacing marks, then in lower case."""
    return F.lower(F.translate(text, *_folding()))


def normalize_exact(text: Column) -> Column:
    """The same through Python's Unicode tables, for texts with characters that decompose into several."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower())

    return fold(text)


def title_case(text: Column) -> Column:
    """Capital letters after every non-letter, as str.title() has them; initcap() has them after white space alone."""

    @F.pandas_udf("string")
    def title(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else t.title())

    return title(text)


def words(text: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def passage_tokens(text: Column) -> Column:
    """Tokens of passages and their queries: normalized."""
    return words(normalize_text(text))


def node_tokens(text: Column) -> Column:
    """Tokens of graph nodes and their queries: lower case, accents and punctuation kept."""
    return words(F.lower(text))


def without_punctuation(text: Column) -> Column:
    return F.translate(text, string.punctuation, "")


def search_terms(query: Column) -> Column:
    """Normalized words of over 3 characters that are not stop words; duplicates stay."""
    stop = F.array(*[F.lit(w) for w in QUERY_STOP_WORDS])
    return F.filter(words(without_punctuation(normalize_text(query))), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


def bridge_keywords(text: Column) -> Column:
    """Distinct lower-case words of over 4 characters that are not stop words; accents stay."""
    stop = F.array(*[F.lit(w) for w in BRIDGE_STOP_WORDS])
    return F.array_distinct(F.filter(words(F.lower(without_punctuation(text))), lambda w: (F.length(w) > 4) & ~F.array_contains(stop, w)))


def _each_abbreviation(text: Column, which: list[str], protect: bool, whole_words: bool) -> Column:
    for plain in sorted(which, key=lambda a: (-len(a), a)):
        for form in dict.fromkeys([plain, plain[0].upper() + plain[1:]]):
            hidden = form.replace(".", PROTECTED_STOP)
            if not protect:
                text = F.replace(text, F.lit(hidden), F.lit(form))
            elif whole_words:
                quoted = "".join(rf"\{c}" if c in string.punctuation else c for c in form)
                text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}]){quoted}", hidden)
            else:
                text = F.replace(text, F.lit(form), F.lit(hidden))
    return text


def protect_abbreviations(text: Column, language: str = "en", whole_words: bool = False) -> Column:
    """Full stops of abbreviations as a stand-in. Found as plain parts of the text, unless whole_words is set."""
    return _each_abbreviation(text, ABBREVIATIONS[language], True, whole_words)


def sentences(text: Column, lang: Column, whole_words: bool = False, empty_page: str = EMPTY_PAGE) -> Column:
    """Array of sentences of at least 2 characters, split after end marks, closing quotes and brackets that white space follows."""

    def split(language: str) -> Column:
        flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
        marked = F.regexp_replace(protect_abbreviations(flat, language, whole_words), SENTENCE_END, "$1$2\u0001")
        back = F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.replace(s, F.lit(PROTECTED_STOP), F.lit("."))))
        return F.filter(back, lambda s: (F.length(s) >= 2) & (s != empty_page))

    return F.when(F.lower(F.coalesce(lang, F.lit("en"))).startswith("is"), split("is")).otherwise(split("en"))


def format_source(book: Column, chapter_num: Column, chapter_name: Column, subchapter: Column, page: Column) -> Column:
    """Parts that are not empty, joined by bars; chapter 0 is left out."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    chapter = F.when(chapter_num > 0, F.concat_ws(" ", F.concat(F.lit("Chapter "), chapter_num.cast("string")), filled(chapter_name)))
    return F.concat_ws(" | ", filled(book), chapter, filled(subchapter), F.concat(F.lit("p. "), page.cast("string")))


def clean_question(text: Column) -> Column:
    """Without phrases that point at the source (fixed values of the reference behaviour); the first letter as a capital."""
    cut = F.regexp_replace(text, r"(?i)(According to|Based on|In) the (text|passage|excerpt|context|documents?),?", "")
    cut = F.regexp_replace(cut, r"(?i)What does the text say about", "What is")
    cut = F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")
    return F.concat(F.upper(F.substring(cut, 1, 1)), F.substr(cut, F.lit(2)))


def category(raw: Column, default: str = "Unknown", mend_hyphen: bool = True) -> Column:
    """In title case; mend_hyphen writes Multi-Hop as Multi-hop."""
    named = F.trim(title_case(F.coalesce(raw, F.lit(default))))
    named = F.when(named == "Multi-Hop", "Multi-hop").otherwise(named) if mend_hyphen else named
    return F.when(named == "", default).otherwise(named)


def facts(facts_: Column, key_facts: Column) -> Column:
    return F.coalesce(facts_, key_facts, F.array().cast("array<string>"))


def text_hash(text: Column) -> Column:
    """md5 of the UTF-8 bytes."""
    return F.md5(text.cast("binary"))


def property_text(props: Column) -> Column:
    """Values of a map of strings joined by blanks, without source_reference."""
    return F.array_join(F.map_values(F.map_filter(props, lambda k, v: k != "source_reference")), " ")


def without_reference(props: Column) -> Column:
    return F.map_filter(props, lambda k, v: k != "source_reference")


def node_data(raw: Column) -> Column:
    """A node as text is its own id with a readable name; a node as JSON object gives id, label and name."""
    obj = F.from_json(raw, "id string, label string, name string")
    is_object = F.trim(raw).startswith("{")
    return F.struct(
        F.when(is_object, obj["id"]).otherwise(raw).alias("id"),
        F.when(is_object, F.coalesce(obj["label"], F.lit("Concept"))).otherwise("Concept").alias("label"),
        F.when(is_object, F.coalesce(obj["name"], obj["id"])).otherwise(title_case(F.replace(raw, F.lit("_"), F.lit(" ")))).alias("name"),
    )


def triple_text(source: Column, relation: Column, target: Column, props: Column) -> Column:
    """Source --[RELATION]--> Target (qualifiers as JSON, unless there are none)."""

    def quoted(c: Column) -> Column:
        listed = F.to_json(F.array(c))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    body = F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", ")
    tail = F.when(F.size(props) > 0, F.concat(F.lit(" ({"), body, F.lit("})"))).otherwise("")
    return F.concat(source, F.lit(" --["), relation, F.lit("]--> "), target, tail)


def readable_triple(source: Column, relation: Column, target: Column, props: Column) -> Column:
    listed = F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit(" is "), e["value"])), ", ")
    return F.concat_ws(" ", source, relation, F.concat(target, F.lit(". "), listed))


#: Our own wording of the head above listed triples.
LEGEND = "Facts from the graph, each as: subject --[relation]--> object (qualifiers)\n"


def bulleted(lines: Column, head: str = LEGEND) -> Column:
    """An array of lines under the head, each with a dash."""
    return F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))


def hybrid_context(text_context: Column, graph_context: Column) -> Column:
    return F.concat(F.lit("## Passages\n"), F.coalesce(text_context, F.lit("")), F.lit("\n\n## Graph\n"), F.coalesce(graph_context, F.lit("")))


def token_count(text: Column) -> Column:
    """Tokens by a rule: letter or digit runs in pieces of up to 6 characters, and each other mark; null or empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,6}|[^\s\p{L}\p{N}]")), F.lit(0))
