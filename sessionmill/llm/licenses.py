"""License scans by ordered signature rules.

Several hundred rules are regular expressions over a document's words: sentences
that licences are known by, written one by one, and ways of naming a licence, built
from a list of licences and templates. A keyword prefilter decides which documents
are looked at, and each rule's own keyword whether it is tried; both come from the
rules. Overlapping
detections are settled by interval containment: one that lies within another of
the same or a better priority is dropped. All work is in SQL functions on one row;
there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.columns import MARK, folded, let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Families: label, the names that texts use, the versions that it has. Any match of a rule has the rule's name.
FAMILIES = [
    ("gpl", ["gpl", "gnu gpl"], ["1", "2", "3"]),
    ("gpl", ["gnu general public license", "gnu general public licence"], ["1", "2", "3"]),
    ("lgpl", ["lgpl", "gnu lgpl"], ["2", "2 1", "3"]),
    ("lgpl", ["gnu lesser general public license"], ["2 1", "3"]),
    ("agpl", ["agpl", "gnu agpl"], ["1", "3"]),
    ("agpl", ["gnu affero general public license"], ["1", "3"]),
    ("apache", ["apache", "apache license", "apache software license"], ["1", "1 1", "2", "2 0"]),
    ("mit", ["mit", "mit license", "mit licence"], []),
    ("bsd", ["bsd", "bsd license", "new bsd", "simplified bsd", "modified bsd"], ["0 clause", "1 clause", "2 clause", "3 clause", "4 clause"]),
    ("mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("mpl", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("epl", ["epl"], ["1 0", "2 0"]),
    ("epl", ["eclipse public license"], ["1 0", "2 0"]),
    ("cddl", ["cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public license"], ["1 0"]),
    ("isc", ["isc", "isc license"], []),
    ("zlib", ["zlib", "zlib license", "zlib libpng license"], []),
    ("bsl", ["boost software license"], ["1 0"]),
    ("artistic", ["artistic license"], ["1 0", "2 0"]),
    ("unlicense", ["unlicense", "the unlicense"], []),
    ("wtfpl", ["wtfpl"], ["2"]),
    ("eupl", ["eupl"], ["1 1", "1 2"]),
    ("ofl", ["ofl", "sil ofl"], ["1 0", "1 1"]),
    ("ofl", ["sil open font license"], ["1 0", "1 1"]),
    ("odbl", ["odbl"], ["1 0"]),
    ("ncsa", ["ncsa", "university of illinois ncsa open source license"], []),
    ("psf", ["python software foundation license"], ["2"]),
    ("postgresql", ["postgresql license"], []),
    ("ms-pl", ["microsoft public license"], []),
    ("afl", ["academic free license"], ["2 1", "3 0"]),
    ("cc0", ["cc0"], ["1 0"]),
    ("cc-by", ["cc by"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["cc by sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["cc by nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["cc by nc"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["cc by nc sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", ["cc by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", ["creative commons attribution"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["creative commons attribution sharealike", "creative commons attribution share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["creative commons attribution noncommercial", "creative commons attribution non commercial"], ["2 0", "2 5", "3 0", "4 0"]),
]

# Texts that state a licence without its name: label, words that any match has, signature.
STATEMENTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "software is provided as is", r"this software is provided as is without any express or implied warranty"),
    ("public-domain", "the public domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?[0-9]{4}"),
    ("gpl", "free software you can redistribute it", r"(?:this (?:program|file|library) |it )?is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you can redistribute it", r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "free software you can redistribute it", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "a copy of the gnu", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "a copy of the gnu", r"you should have received a copy of the gnu affero general public license"),
    ("gpl-or-later", "or at your option", r"(?:either )?version [123] (?:of the license )?or at your option any later version"),
    ("apache", "may not use this file", r"you may not use this file except in compliance with the license"),
    ("apache", "distributed on an", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "without restriction including", r"to deal in the software without restriction including without limitation the rights to use copy modify"),
    ("mit", "above copyright notice and", r"the above copyright notice and this permission notice shall be included in all"),
    ("bsd", "must retain the above", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "must reproduce the above", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote products", r"(?:may|to) (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("mpl", "source code form is", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "subject to the mozilla", r"(?:contents of this file are )?subject to the mozilla public license"),
    ("epl", "accompanying materials are made", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common development and distribution", r"common development and distribution license"),
    ("zlib", "altered source versions must", r"altered source versions must be plainly marked as such"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl", "obtaining a copy of the software and accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to(?: public license)?"),
    ("cc0", "waived all copyright", r"waived all copyright and related (?:or|and) neighbo(?:u)?ring rights"),
    ("cc-by", "creative commons attribution", r"creative commons attribution [0-9] [0-9] international"),
    ("cc-by-sa", "attribution sharealike", r"attribution sharealike [0-9] [0-9] (?:international|unported)"),
    ("public-domain", "dedicate", r"dedicate (?:any and all copyright interest|this (?:work|software)) (?:in this software )?to the public domain"),
    ("proprietary", "proprietary and confidential", r"(?:strictly |is )?proprietary and confidential"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "without the prior written permission", r"(?:reproduced|copied|distributed|used|transmitted) without the prior written permission"),
    ("openssl", "openssl license", r"openssl license"),
    ("openssl", "for use in the openssl toolkit", r"developed by the openssl project for use in the openssl toolkit"),
    ("artistic", "artistic license", r"the artistic license(?: [12] 0)?"),
    ("perl", "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("ofl", "font software", r"this font software is licensed under the sil open font license"),
    ("eupl", "european union public", r"european union public licen[cs]e"),
    ("odbl", "open database license", r"open database license"),
    ("commons-clause", "commons clause", r"commons clause(?: license)? condition"),
]

# Ways in which texts name a licence, best first: priority, pattern around the name, weight of the evidence.
TEMPLATES = [
    (1, r"spdx license identifier {name}", 1.0),
    (2, r"(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 0.95),
    (3, r"(?:license|licence) (?:is )?(?:the )?{name}", 0.8),
    (4, r"{name} (?:license|licence|licensed)", 0.7),
    (5, r"{name}", 0.5),
]
STATED = 0.6


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str
    weight: float


def rules() -> list[Rule]:
    """All rules in order. A name that may carry a version is tried with and without one; the bare name alone is too weak where it is a common word."""
    out = []
    for priority, template, weight in TEMPLATES:
        for label, names, versions in FAMILIES:
            for name in names:
                if priority == 5 and " " not in name and name not in ("lgpl", "agpl", "cc0", "wtfpl", "unlicense", "cddl", "eupl", "odbl"):
                    continue
                if priority == 4 and name.endswith(("license", "licence")):
                    continue
                version = f"(?: (?:version |v ?)?(?:{'|'.join(sorted(versions, key=len, reverse=True))})(?: 0)?(?: or later| only)?)?" if versions else ""
                out.append(Rule(label, priority, name, template.format(name=name + version), weight))
    return out + [Rule(label, 2, keyword, pattern, STATED) for label, keyword, pattern in STATEMENTS]


def prefilter() -> str:
    """What a lower-case text has if any rule or base phrase can match: the whole words of one of their keywords, with anything between them that separates words."""
    words = {r.keyword for r in rules()} | set(BASE)
    # a keyword that holds another one adds nothing
    least = sorted(k for k in words if not any(o != k and f" {o} " in f" {k} " for o in words))
    letters = sorted({k[0] for k in least})
    by_letter = "|".join(f"{x}(?:{'|'.join(k[1:].replace(' ', NOT_WORD) for k in least if k[0] == x)})" for x in letters)
    return rf"(?:^|(?<={NOT_WORD[:-1]}))(?:{by_letter})(?:$|(?={NOT_WORD[:-1]}))"


PLACE = "array<struct<start:bigint,end:bigint>>"


def _places(norm: Column, pattern: Column) -> Column:
    """(start, end) words of each match of ``pattern`` in ' w w w ': matches are marked, and the marked words' places are the result."""

    def listed(words: Column) -> Column:
        at = F.transform(words, lambda w, i: F.struct(i.cast("bigint").alias("i"), w.startswith(MARK).alias("first"), w.endswith(MARK).alias("last")))
        starts = F.transform(F.filter(at, lambda w: w["first"]), lambda w: w["i"])
        ends = F.transform(F.filter(at, lambda w: w["last"]), lambda w: w["i"])
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))

    def found(marked: Column) -> Column:
        return F.when(F.contains(marked, F.lit(MARK)), let(F.split(F.trim(marked), " ", -1), listed)).otherwise(F.array().cast(PLACE)).cast(PLACE)

    return let(F.regexp_replace(norm, pattern, F.lit(f"{MARK}$0{MARK}")), found)


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def scan(docs: DataFrame) -> DataFrame:
    """License labels of every whole text.

    Returns doc_id, n_words, n_base (places of the base phrases), first_word and
    last_word (their smallest and largest start), base_labels, labels (base and
    rules', distinct, sorted), score (the strongest evidence, 1 for a base place,
    0 for none), and detections: array of (start, end, priority, label).

    Null texts are as empty: no words, no labels, null places, score 0. Repeated
    rows get a row each, a null doc_id stays null, other columns are ignored, and an
    empty table gives an empty result. A tie of equal intervals goes to the better
    priority, then to the earlier label.
    """
    table = rules()
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    looked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lower.alias("lower"))
    looked = looked.select("doc_id", F.regexp_count("lower", F.lit(WORD)).cast("bigint").alias("n_words"), F.when(F.col("lower").rlike(prefilter()), F.concat(F.lit(" "), F.regexp_replace("lower", NOT_WORD, " "), F.lit(" "))).alias("norm"))
    looked = looked.withColumn("norm", F.regexp_replace("norm", "^ +| +$", " "))

    base = F.when(F.col("norm").isNotNull(), _places(F.col("norm"), F.lit(_bounded("|".join(BASE)))))
    phrases = [F.when(F.contains("norm", F.lit(f" {p} ")), label) for p, label in BASE.items()]
    looked = looked.withColumns({"base": F.coalesce(base, F.array().cast(PLACE)), "of_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*phrases))))})

    listed = F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(_bounded(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight")) for r in table])
    tried = F.filter(listed, lambda r: F.col("norm").contains(F.concat(F.lit(" "), r["keyword"], F.lit(" "))))

    def detect(r: Column) -> Column:
        return F.transform(_places(F.col("norm"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))

    kind = "array<struct<start:bigint,back:bigint,priority:int,label:string,weight:double>>"
    found = F.when(F.col("norm").isNotNull(), F.array_sort(F.flatten(F.transform(tried, detect))))
    looked = looked.withColumn("found", F.coalesce(found, F.array()).cast(kind))

    # in order of start and, from the same start, of length: a detection lies within an earlier one if that reaches as far
    tiers = sorted({r.priority for r in table})
    begin = {"reach": F.array(*[F.lit(-1).cast("bigint") for _ in tiers])}

    def settle(acc: Column, d: Column) -> tuple[dict[str, Column], Column, Column]:
        covered = F.exists(F.sequence(F.lit(1), F.array_position(F.array(*map(F.lit, tiers)), d["priority"])), lambda t: F.element_at(acc["reach"], t.cast("int")) >= -d["back"])
        reach = F.transform(acc["reach"], lambda e, i: F.when(F.get(F.array(*map(F.lit, tiers)), i) == d["priority"], F.greatest(e, -d["back"])).otherwise(e))
        return {"reach": reach}, d, ~covered

    looked = looked.withColumn("kept", F.when(F.size("found") > 0, folded(F.col("found"), kind[len("array<") : -1], begin, settle)["out"]).otherwise(F.array().cast(kind)))
    starts = F.transform("base", lambda p: p["start"])
    return looked.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("of_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("of_base", F.transform("kept", lambda d: d["label"]))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0))).alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"))).alias("detections"),
    )
