"""Operator 4, licence scans by a positional rare-token index; DataFrame functions only.

The index holds, for every licence template, the rarest words of its mandatory key phrase (highest inverse document
frequency over all documents) with their positions. A document's words are looked up for the rarest one; each hit gives
a template and the place where it would begin; the second-rarest word must stand at its relative position; then the
whole key phrase is verified word for word. What survives is a labelled place, scored by the share of the template's
IDF weight that stands at the right relative positions.

Everything happens within a document's row: there is no shuffle after the document frequencies, so frequent licences,
hot sources and very long texts cannot pile up anywhere. Work is linear in words and hits.

Cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned each; null doc_ids are kept;
only doc_id and text are read, so other columns cannot clash; an empty table gives no rows. Words of equal rarity are
taken by their position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gaugewise.llm.common import lower_ascii, text_or_empty

#: Fixed value: the word rule of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text`` around the mandatory ``key`` phrase, which begins at word ``at`` of it. ``base``: asked for by contract."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def keys(self) -> list[str]:
        return self.key.split()

    @property
    def at(self) -> int:
        n = len(self.keys)
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.keys)


#: Phrases and labels. The first three are the contract's, the others are the method's own.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("gpl", "licensed under the gnu general public license", "gnu general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification",
             "redistribution and use in source and binary forms"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy",
             "permission is hereby granted free of charge"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every licence word, over all documents; one row per licence word is collected."""
    known = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(words(text_or_empty()), F.array(*map(F.lit, known)))
    rows = docs.select(F.explode(F.array_insert(found, 1, F.lit(""))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in known}


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES,
            idf: dict[str, float] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, and ``places``: template number, first word of the key phrase, and score."""
    idf = idf or rarity(docs, templates)
    entries = []
    for number, t in enumerate(templates):
        order = sorted(range(len(t.keys)), key=lambda j: (-idf[t.keys[j]], j))
        first, second = order[0], order[min(1, len(order) - 1)]
        total = sum(idf[w] for w in t.words)
        weights = [idf[w] / total if total else 1 / len(t.words) for w in t.words]
        entries.append(F.struct(
            F.lit(number).alias("t"), F.lit(t.keys[first]).alias("w"), F.lit(first).alias("j"),
            F.lit(t.keys[second]).alias("w2"), F.lit(second).alias("j2"), F.array(*map(F.lit, t.keys)).alias("key"),
            F.lit(t.at).alias("at"), F.array(*map(F.lit, t.words)).alias("text"),
            F.array(*map(F.lit, weights)).alias("weights")))
    index = F.array(*entries)
    rarest = sorted({templates[i].keys[max(range(len(templates[i].keys)), key=lambda j: (
        idf[templates[i].keys[j]], -j))] for i in range(len(templates))})

    rows = docs.select("doc_id", words(text_or_empty()).alias("ws"))
    hits = F.filter(F.transform("ws", lambda w, i: F.when(w.isin(rarest), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "ws", hits.alias("hits"))
    looked_up = F.flatten(F.transform("hits", lambda i: F.transform(
        F.filter(index, lambda e: e["w"] == F.get("ws", i)),
        lambda e: F.struct(e.alias("e"), (i - e["j"]).alias("start")))))
    agree = F.filter(looked_up, lambda c: (c["start"] >= 0) & (
        F.get("ws", c["start"] + c["e"]["j2"]) == c["e"]["w2"]))
    verified = F.filter(agree, lambda c: F.slice("ws", c["start"] + 1, F.size(c["e"]["key"])) == c["e"]["key"])

    def score(c: Column) -> Column:
        shares = F.transform(c["e"]["text"], lambda w, k: F.when(
            F.coalesce(F.get("ws", c["start"] - c["e"]["at"] + k) == w, F.lit(False)),
            F.get(c["e"]["weights"], k)).otherwise(0.0))
        return F.aggregate(shares, F.lit(0.0), lambda total, x: total + x)

    places = F.transform(verified, lambda c: F.struct(
        c["e"]["t"].alias("t"), c["start"].cast("long").alias("word"), score(c).alias("score")))
    return rows.select("doc_id", F.size("ws").cast("long").alias("n_words"), places.alias("places"))


def reported(scan: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The digest of ``scanned``: counts, first and last base place, labels and the best score."""
    labels = F.array(*(F.lit(t.label) for t in templates))
    base = F.filter("places", lambda p: p["t"].isin([i for i, t in enumerate(templates) if t.base]))

    def named(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(labels, p["t"])))), ",")

    starts = F.transform(F.col("base"), lambda p: p["word"])
    best = F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0))
    return scan.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), named(F.col("base")).alias("base_labels"),
        named(F.col("places")).alias("labels"), F.least(F.round(best, 6), F.lit(1.0)).alias("score"))
