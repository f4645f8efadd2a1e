"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of consecutive words, whatever lines they stand on: twice as
many as the template has, starting every template length, so that each passage as
long as the template lies in one. A template is found in a block that holds at least
``containment`` of the template's distinct words. Words are ordered by how many
documents have them, rarest first; a block that meets the threshold must have one
of the first m - need + 1 words of a template of m words that needs ``need`` of
them (prefix filter), must have ``need`` words that templates use at all (length
filter), and from the first word in common on, both sides must have enough words
left (positional filter). What passes is counted exactly.

Only Spark's own functions take part. Templates are a fixed list, so the word
order, a count for each of their words, is small whatever the corpus.

Defined cases: a null text has no words and no labels; a text shorter than a block
is one block; repeated rows give repeated results; an empty table gives none; other
columns stay, those named like the output are replaced.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

_ASCII_BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BETWEEN = f"[{_ASCII_BETWEEN}]+"

# Fixed by contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening sentences of public license notices.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution International License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "reserved": "All rights reserved",
}
CONTAINMENT = 0.8
OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(lowered: Column) -> Column:
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def template_list(template: str) -> list[str]:
    return [w for w in re.split(BETWEEN, template.lower()) if w]


def template_words(templates: dict[str, str]) -> dict[str, set[str]]:
    return {label: set(template_list(text)) for label, text in templates.items()}


def template_lengths(templates: dict[str, str]) -> dict[str, int]:
    return {label: len(template_list(text)) for label, text in templates.items()}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_order(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by the number of documents that have the word, rarest first."""
    found = F.array_intersect(words(lower(F.col(text))), _strings(vocabulary))
    counts = dict(docs.select(F.explode(found).alias("word")).groupBy("word").count().collect())  # one row for each template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _prefix(members: set[str], rank: dict[str, int], containment: float) -> tuple[list[str], int, list[str]]:
    """The words of a template, rarest first, how many of them a block needs, and those of which it must have one."""
    ordered, need = sorted(members, key=rank.__getitem__), math.ceil(containment * len(members) - 1e-9)
    return ordered, need, ordered[: len(ordered) - need + 1]


def word_blocks(lowered: Column, length: int) -> Column:
    """The texts of all windows of 2 * ``length`` words that start every ``length`` words."""
    word = f"[^{_ASCII_BETWEEN}]++[{_ASCII_BETWEEN}]*+"
    return F.regexp_extract_all(lowered, F.lit(f"(?=((?:{word}){{1,{2 * length}}}+))(?:{word}){{1,{length}}}+"), F.lit(1))


def template_matches(blocks: DataFrame, order: list[str], templates: dict[str, str], containment: float) -> DataFrame:
    """(the columns of ``blocks``, label, share) of the blocks that hold enough of a template.

    ``blocks`` have their ``words`` and the template ``length`` that they were cut for.
    """
    spark = blocks.sparkSession
    rank, lengths = {word: n for n, word in enumerate(order)}, template_lengths(templates)
    prefixes = []
    for label, members in template_words(templates).items():
        ordered, need, prefix = _prefix(members, rank, containment)
        prefixes += [(word, lengths[label], at, label, ordered, need) for at, word in enumerate(prefix)]
    index = spark.createDataFrame(prefixes, "word string, length int, template_at int, label string, template array<string>, need int")
    known = blocks.withColumn("words", F.array_intersect(_strings(order), "words"))
    keys = [c for c in blocks.columns if c not in ("words", "length")]
    placed = known.select(*keys, "length", "words", F.posexplode("words").alias("block_at", "word"))
    pairs = placed.join(index, ["word", "length"]).where(F.size("words") >= F.col("need"))
    pairs = pairs.where(1 + F.least(F.size("template") - F.col("template_at") - 1, F.size("words") - F.col("block_at") - 1) >= F.col("need"))
    common = F.size(F.array_intersect("words", "template"))
    # A pair may come up by a later common word; counting it again does no harm.
    return pairs.where(common >= F.col("need")).select(*keys, "label", (common / F.size("template")).alias("share"))


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` with the columns of OUTPUT.

    ``score`` is 1 where a phrase stands, else the largest share of a template
    that a block holds, else 0.
    """
    members = template_words(templates)
    order = word_order(docs, text, sorted(set().union(*members.values())))
    rank = {word: n for n, word in enumerate(order)}
    prefixes: dict[int, set[str]] = {}
    for label, length in template_lengths(templates).items():
        prefixes.setdefault(length, set()).update(_prefix(members[label], rank, containment)[2])

    mark = "_"  # begins the names of columns for the time being
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    low, split, line, print_, base, found, share, id_of, print_of = (mark + c for c in ("low", "words", "line", "print", "base", "found", "share", "id_of", "print_of"))

    either = "|".join(sorted(phrases, key=lambda p: (-len(p), p)))
    here = f"(?<= )(?:{either})(?= )"
    based = docs.drop(*OUTPUT).withColumn(low, lower(F.coalesce(F.col(text), F.lit("")))).withColumn(split, words(F.col(low)))
    # Only texts with the last word of a phrase are joined up again.
    lasts = sorted({p.split()[-1] for p in phrases})
    joined_up = F.when(F.arrays_overlap(split, _strings(lasts)), F.concat(F.lit(" "), F.array_join(split, " "), F.lit(" ")))
    based = based.withColumn(line, joined_up).withColumn(print_, F.xxhash64(low))

    def blanks(column: Column) -> Column:
        return (F.char_length(column) - F.char_length(F.replace(column, F.lit(" "), F.lit(""))) - 1).cast("long")

    places = F.regexp_extract_all(line, F.lit(here), F.lit(0))
    labels = F.array_sort(F.array_distinct(F.transform(places, lambda p: F.element_at(F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair]), p))))
    stands = F.col(line).rlike(here)
    none = F.expr("cast(array() as array<string>)")
    counted = based.withColumns(
        {
            "n_words": F.size(split).cast("long"),
            "n_base": F.when(stands, F.size(places)).otherwise(0).cast("long"),
            "first_word": F.when(stands, blanks(F.regexp_extract(line, f"(?s)^(.*?){here}", 1))),
            "last_word": F.when(stands, blanks(F.regexp_extract(line, f"(?s)^(.*){here}", 1))),
            base: F.when(stands, labels).otherwise(none),
        }
    )

    def cut(length: int, prefix: set[str]) -> Column:
        """The blocks for templates of ``length`` words in texts that have a word of a prefix."""
        held = F.when(F.arrays_overlap(split, _strings(sorted(prefix))), F.array_distinct(word_blocks(F.col(low), length))).otherwise(none)
        having = F.filter(held, lambda b: reduce(or_, [b.contains(w) for w in sorted(prefix)]))
        return F.transform(having, lambda b: F.struct(F.lit(length).alias("length"), b.alias("block")))

    rare = sorted(set().union(*prefixes.values()))
    blocks = based.where(F.arrays_overlap(split, _strings(rare))).select(
        F.col("doc_id").alias(id_of), F.col(print_).alias(print_of), F.explode(F.concat(*[cut(n, p) for n, p in sorted(prefixes.items())])).alias("cut")
    )
    matches = template_matches(blocks.select(id_of, print_of, "cut.length", words(F.col("cut.block")).alias("words")), order, templates, containment)
    # Labels depend on the text alone, so rows with the same id and text may share them.
    hits = matches.groupBy(id_of, print_of).agg(F.collect_set("label").alias(found), F.max("share").alias(share))
    same = F.col("doc_id").eqNullSafe(F.col(id_of)) & (F.col(print_) == F.col(print_of))
    joined = counted.drop(low, split, line).join(hits, same, "left")
    every = F.array_sort(F.array_union(base, F.coalesce(found, none)))
    return joined.withColumns(
        {
            "base_labels": F.array_join(base, ","),
            "labels": F.array_join(every, ","),
            "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))),
        }
    ).drop(base, found, share, id_of, print_of, print_)
