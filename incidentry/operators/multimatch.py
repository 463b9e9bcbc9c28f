"""Many keywords at once (F1, J1, P7 at scale): an Aho-Corasick automaton over every rule's keywords.

``tags_by_rules`` tests each keyword on each text, so its cost grows with the rules. Here a text is read once whatever the
number of rules. The rules are configuration: they travel with the function, and each task builds the automaton once.
Texts and keywords are both lower-cased by Spark, so both ways give the same tags.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from incidentry.session import pickle_by_value


def lowered_keywords(rules: list[tuple[str, list[str]]]) -> list[list[str]]:
    """The keywords of each rule as ``lower`` of Spark gives them."""
    text = json.dumps([list(words) for _, words in rules], ensure_ascii=False)
    lowered = SparkSession.active().range(1).select(F.lower(F.lit(text)).alias("words")).first().words
    return json.loads(lowered)


def build_automaton(words: list[list[str]]):
    """(automaton or None, rules that every text satisfies): a keyword's value is the numbers of its rules."""
    import ahocorasick
    holders: dict[str, set[int]] = {}
    for rule, keywords in enumerate(words):
        for word in keywords:
            holders.setdefault(word, set()).add(rule)
    always = holders.pop("", set())
    automaton = ahocorasick.Automaton()
    for word, rules in holders.items():
        automaton.add_word(word, tuple(rules))
    automaton.make_automaton()
    return (automaton if holders else None), always


def tags_by_automaton(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Ordered tags of ``text`` (null: empty) under any number of rules; a rule without keywords never applies, an empty
    keyword always does."""
    words, names = lowered_keywords(rules), [tag for tag, _ in rules]

    @F.pandas_udf("array<string>")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, always = build_automaton(words)
        for texts in batches:
            found = []
            for value in texts:
                hits = set(always)
                if automaton is not None:
                    for _, holders in automaton.iter(value):
                        hits.update(holders)
                found.append([names[i] for i in sorted(hits)])
            yield pd.Series(found, dtype=object)

    return tags(F.lower(F.coalesce(text, F.lit(""))))


pickle_by_value(__name__)
