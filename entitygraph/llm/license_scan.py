"""Licence scans by diagonal voting, in DataFrame operations only.

Hashes of all runs of ``GRAM`` words of the texts are joined to the places where templates
hold them.  A hit votes for the diagonal (place in the text minus place in the template) on
which the template would lie.  Neighbouring diagonals, as far apart as the edits that are
allowed, are merged; what has enough votes is cut out of its text and verified word by word.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entitygraph.llm.common import broadcast_if_small, fresh, settle

#: Words of texts and templates: runs of ASCII digits, small letters and anything beyond ASCII.
LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words where A-Z have not been made small.
CASED_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words whose hash is joined; no template is shorter.
GRAM = 3
#: Share of a notice's words that may be inserted, deleted or replaced.
EDITS = 0.2
#: Candidate spans (about 60 bytes each) and documents with spans up to which they are broadcast to the documents.
BROADCAST_ROWS = 200_000
#: The first code of a template's words as characters; foreign words have this one.
FOREIGN = 33


@dataclass(frozen=True)
class Template:
    """Words that tell of a licence: a phrase stands exactly, a notice with up to ``edits`` of its words changed."""

    label: str
    text: str
    base: bool = False
    edits: float = 0.0

    @property
    def words(self) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in self.text.lower()).split()

    @property
    def allowed(self) -> int:
        return math.floor(self.edits * len(self.words))

    @property
    def votes(self) -> int:
        """Runs of ``GRAM`` words that must be left after so many edits."""
        return max(1, len(self.words) - GRAM + 1 - GRAM * self.allowed)


# Phrases by which licences are named, and the notices that their texts prescribe.
TEMPLATES = (
    Template("mit", "under the MIT License", base=True),
    Template("apache-2", "Apache License Version 2", base=True),
    Template("cc-by-nc", "CC BY NC", base=True),
    Template("apache-2", "Apache License 2.0"),
    Template("gpl-2", "GNU General Public License version 2"),
    Template("gpl-3", "GNU General Public License version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl-3", "GNU Affero General Public License"),
    Template("mpl-2", "Mozilla Public License"),
    Template("bsd-2-clause", "BSD 2-Clause"),
    Template("bsd-3-clause", "BSD 3-Clause"),
    Template("cc-by-sa", "CC BY-SA"),
    Template("cc-by-nd", "CC BY-ND"),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        edits=EDITS,
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        edits=EDITS,
    ),
    Template(
        "gpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version",
        edits=0.05,
    ),
    Template(
        "gpl-2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version",
        edits=0.05,
    ),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", edits=EDITS),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", edits=EDITS),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License", edits=EDITS),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", edits=EDITS),
)


def words_of(text: str) -> Column:
    """The words of a text as an array; A-Z count as small letters, null as no words."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(LICENSE_WORDS), F.lit(0))


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(tpl, label, base, allowed, votes, said): one row a template; a table as small as the parameter."""
    if any(len(t.words) < GRAM or len(set(t.words)) > 90 for t in templates):
        raise ValueError(f"templates have {GRAM} words or more, and at most 90 different ones")
    rows = [F.struct(F.lit(i).alias("tpl"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.allowed).alias("allowed"), F.lit(t.votes).alias("votes"), F.split(F.lit(" ".join(t.words)), " ").alias("said")) for i, t in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def grams(words: DataFrame, keep: list[str], column: str = "w") -> DataFrame:
    """(*keep, pos, g): the hash of every run of ``GRAM`` words, by its place from 0."""
    w = F.col(column)
    later = [F.slice(w, F.lit(i + 1), F.greatest(F.size(w) - i, F.lit(0))) for i in range(1, GRAM)]
    at = words.select(*keep, F.posexplode(F.arrays_zip(w, *later)).alias("pos", "run"))
    parts = [F.col("run")[name] for name in at.schema["run"].dataType.names]
    return at.where(parts[-1].isNotNull()).select(*keep, "pos", F.xxhash64(*parts).alias("g"))


def candidates(docs: DataFrame, named: DataFrame, text: str) -> DataFrame:
    """(_kh, _th, tpl, start, stop): spans whose merged diagonals have the votes of a template."""
    read = docs.select("_kh", "_th", words_of(text).alias("w")).where(F.size("w") >= GRAM)
    places = grams(named, ["tpl"], "said").withColumnRenamed("pos", "tpos")
    # The templates are a parameter, so the table that is broadcast does not grow with the texts.
    hits = grams(read, ["_kh", "_th"]).join(F.broadcast(places), "g")
    votes = hits.groupBy("_kh", "_th", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("seen"))
    votes = votes.join(F.broadcast(named.select("tpl", "allowed", "votes")), "tpl")
    order = Window.partitionBy("_kh", "_th", "tpl").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("allowed"), F.lit(True))
    votes = votes.withColumn("_new", apart.cast("int")).withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    band = votes.groupBy("_kh", "_th", "tpl", "band", "votes").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("seen") + GRAM).alias("stop"),
    )
    return band.where("n >= votes").select("_kh", "_th", "tpl", "start", "stop")


def verified(docs: DataFrame, spans: DataFrame, named: DataFrame, text: str) -> DataFrame:
    """(_kh, _th, label, base, start, stop, score) of the spans that stand in their texts with no more edits than allowed.

    Words are written as characters, by their place among the template's words, so that an edit
    distance over characters counts words.
    """
    rows = docs.select("_kh", "_th", text).join(broadcast_if_small(spans, limit=BROADCAST_ROWS), ["_kh", "_th"])
    cut = rows.select("_kh", "_th", "tpl", "start", "stop", F.slice(words_of(text), F.col("start") + 1, F.col("stop") - F.col("start")).alias("found")).join(F.broadcast(named), "tpl")
    cut = cut.withColumn("_codes", F.array_distinct("said"))
    coded = lambda c: F.array_join(F.transform(c, lambda w: F.char(F.array_position("_codes", w) + FOREIGN)), "")
    edits = F.when(F.col("found") == F.col("said"), 0).otherwise(F.levenshtein(coded("found"), coded("said")))
    fits = cut.withColumn("edits", edits).where(F.col("edits") <= F.col("allowed"))
    score = F.lit(1.0) - F.col("edits") / F.size("said")
    return fits.select("_kh", "_th", "label", "base", F.col("start").cast("long"), F.col("stop").cast("long"), score.alias("score")).distinct()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(key, n_words, licenses) of every row: the spans where templates stand, as (start, stop, label, base, score) in their order.

    ``start`` and ``stop`` count words from 0, the end exclusive.  A null text is an empty one;
    texts with fewer words than a run have no spans.  The result hangs on a row's text alone:
    repeated rows are returned alike, null keys as they are; different texts under one key have
    their own spans.  Other columns are not read.  An empty table gives an empty result.
    """
    named = template_table(docs.sparkSession, templates)
    keyed = docs.select(F.xxhash64(key).alias("_kh"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    spans = settle(candidates(keyed, named, "_text"), "license-candidates", compact=True, heavy=True)
    found = settle(verified(keyed, spans, named, "_text"), "licenses", compact=True, heavy=True)
    licenses, kh, th = fresh(docs, "licenses"), fresh(docs, "_kh"), fresh(docs, "_th")
    of = found.groupBy(F.col("_kh").alias(kh), F.col("_th").alias(th)).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label", "base", "score"))).alias(licenses))
    rows = docs.select(key, F.xxhash64(key).alias(kh), F.xxhash64(text).alias(th), F.coalesce(F.regexp_count(text, F.lit(CASED_WORDS)), F.lit(0)).cast("long").alias("n_words"))
    rows = rows.join(broadcast_if_small(of, limit=BROADCAST_ROWS), [kh, th], "left")
    return rows.select(key, "n_words", F.coalesce(F.col(licenses), F.array().cast(of.schema[licenses].dataType)).alias("licenses"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Places of the base phrases, labels and the best score of every row of :func:`scan`."""
    base = F.filter("licenses", lambda s: s.base)
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s.label))), ",")
    starts = F.transform(base, lambda s: s.start)
    return found.select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda s: s.score)), F.lit(0.0)).alias("score"),
    )


def _sql(templates: Sequence[Template] = TEMPLATES) -> str:
    rows = ", ".join(f"({i}, '{t.label}', {t.base}, {t.allowed}, {t.votes}, ['" + "', '".join(t.words) + "'])" for i, t in enumerate(templates))
    return f"""
with t(tpl, label, base, allowed, votes, said) as (values {rows}),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{LICENSE_WORDS}') as w from documents),
tg as (select tpl, allowed, votes, i - 1 as tpos, said[i] as a, said[i + 1] as b, said[i + 2] as c from t, unnest(range(1, len(said) - 1)) as u(i)),
dg as (select r, i - 1 as pos, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
hit as (select r, tpl, allowed, votes, pos, tpos, pos - tpos as diagonal from dg join tg using (a, b, c)),
line as (select r, tpl, allowed, votes, diagonal, min(pos) as first, max(pos) as last, list(distinct tpos) as seen from hit group by all),
step as (select *, coalesce(diagonal - lag(diagonal) over (partition by r, tpl order by diagonal) > allowed, true)::int as new from line),
band as (select *, sum(new) over (partition by r, tpl order by diagonal rows unbounded preceding) as band from step),
span as (select r, tpl, min(first) as start, max(last) + {GRAM} as stop from band group by r, tpl, band, votes having len(list_distinct(flatten(list(seen)))) >= votes),
cut as (select s.r, s.start, s.stop, t.label, t.base, t.allowed, t.said, d.w[s.start + 1 : s.stop] as found from span s join t using (tpl) join d using (r)),
fit as (select *, case when found = said then 0 else levenshtein(
  list_aggregate(list_transform(found, lambda x: chr((coalesce(list_position(said, x), 0) + {FOREIGN})::int)), 'string_agg', ''),
  list_aggregate(list_transform(said, lambda x: chr((list_position(said, x) + {FOREIGN})::int)), 'string_agg', '')) end as edits from cut),
good as (select distinct r, start, stop, label, base, 1.0::double - edits::double / len(said) as score from fit where edits <= allowed)
select doc_id, len(w)::bigint as n_words, count(start) filter (where base)::bigint as n_base, min(start) filter (where base)::bigint as first_word, max(start) filter (where base)::bigint as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(score), 0.0)::double as score
from d left join good using (r) group by r, doc_id, w
"""


SQL = _sql()
