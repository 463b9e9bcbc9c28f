"""Keyword tagging.

A tag applies when any of its keywords is a case-insensitive substring of the message; tags come out in rule order.

Rules are configuration, as in the application, which holds them all in memory. The default rules are compiled into one
projection (``array_compact(array(when(<any keyword hit>, tag), ...))``). Given rules, few or many, become two literal
arrays and one expression over them (``filter(tags, exists(keywords, contains))``) up to ``TESTED_KEYWORDS`` keywords, and
one automaton over all of them beyond (``operators.multimatch``), with equal tags. Either way the logs are neither shuffled
nor joined, the work is linear in their text, and the same expression runs unchanged on a stream.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.operators.multimatch import tags_by_automaton
from incidentry.sources.rules import DEFAULT_TAG_RULES, tag_rules_from_table

#: Up to this many keywords are tested one by one; more are sought together.
TESTED_KEYWORDS = 64


def rule_hit(lowered_text: Column, keywords: list[str]) -> Column:
    """F1 for one rule: OR of substring tests against the lower-cased text."""
    if not keywords:
        return F.lit(False)
    tests = [F.contains(lowered_text, F.lower(F.lit(k))) for k in keywords]
    return reduce(lambda a, b: a | b, tests)


def tags_expr(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Ordered tags of ``text`` under a few rules, compiled."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(rule_hit(lowered, kws), F.lit(tag)) for tag, kws in rules]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))


def tags_by_rules(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Ordered tags of ``text`` under any number of rules. The rules travel as JSON texts, which the optimizer folds into
    literal arrays, so the expression is as small for thousands of rules as for one."""
    tags = F.from_json(F.lit(json.dumps([tag for tag, _ in rules], ensure_ascii=False)), "array<string>")
    words = F.from_json(F.lower(F.lit(json.dumps([list(kws) for _, kws in rules], ensure_ascii=False))),
                        "array<array<string>>")
    # the text is lower-cased once, as the one element of an array, not once per keyword
    lowered = F.array(F.lower(F.coalesce(text, F.lit(""))))
    found = F.transform(lowered, lambda m: F.filter(
        tags, lambda _, i: F.exists(F.get(words, i), lambda k: F.contains(m, k))))
    return F.get(found, 0)


def tag_logs(logs: DataFrame, rules=None, text_col: str = "message", out_col: str = "tags") -> DataFrame:
    """J1. ``rules``: None (defaults), a list of (tag, [keywords]) already normalised, or a rules DataFrame."""
    if rules is None:
        return logs.withColumn(out_col, tags_expr(F.col(text_col), DEFAULT_TAG_RULES))
    if isinstance(rules, DataFrame):
        rules = tag_rules_from_table(rules)
    rules = list(rules)
    many = sum(len(words) for _, words in rules) > TESTED_KEYWORDS
    return logs.withColumn(out_col, (tags_by_automaton if many else tags_by_rules)(F.col(text_col), rules))
