"""License scans by ordered signature rules.

A few hundred signatures, regular expressions over the words of a text, name licenses. A signature
is only tried where its keyword is among the words and the text holds all of its fixed parts. Detections are intervals of the text; one that
lies inside another of the same or higher priority is suppressed, so "GNU Lesser General Public
License" does not also count as the plain one, and what is left gives labels and a score.

The signatures are built from ``FAMILIES``: a family has a keyword, a label, the ways to write its name
and its versions, and ``FORMS`` are the sentences a name is found in, each with a priority.

Base phrases are looked up in the same words; their labels are always part of the result.

Scale: no shuffle and no Python; every row is judged by itself, with DataFrame functions only. Texts
without any keyword, nearly all of them, never reach a signature. Detections are combined in one pass
over a sorted array, so a text with very many of them stays cheap.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are judged
alike; an empty table gives an empty result; other columns pass through ``scan``.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.let import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases: words that stand consecutively, and the label they give.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

#: keyword, label, names (``?`` optional word, ``|`` choice), versions.
FAMILIES = (
    ("mit", "mit", ("mit", "mit x11", "mit expat"), ()),
    ("apache", "apache", ("apache ?software", "apache ?software ?foundation"), ("1 0", "1 1", "2 0", "2")),
    ("general", "gpl", ("?gnu general public",), ("1", "2", "3", "2 0", "3 0")),
    ("lesser", "lgpl", ("?gnu lesser general public",), ("2 1", "3", "3 0")),
    ("library", "lgpl", ("?gnu library general public",), ("2", "2 0")),
    ("affero", "agpl", ("?gnu affero general public",), ("1", "3", "3 0")),
    ("gpl", "gpl", ("?gnu gpl",), ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", "lgpl", ("?gnu lgpl",), ("2", "2 1", "3", "3 0")),
    ("agpl", "agpl", ("?gnu agpl",), ("3", "3 0")),
    ("documentation", "gfdl", ("?gnu free documentation",), ("1 1", "1 2", "1 3")),
    ("bsd", "bsd", ("bsd", "2|3|4 clause bsd", "bsd 2|3|4 clause", "simplified|revised|modified|new bsd"), ()),
    ("mozilla", "mpl", ("mozilla public",), ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", ("mpl",), ("1 0", "1 1", "2 0")),
    ("eclipse", "epl", ("eclipse public",), ("1 0", "2 0")),
    ("epl", "epl", ("epl",), ("1 0", "2 0")),
    ("creative", "cc", ("creative commons",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("attribution", "cc-by", ("creative commons attribution", "cc attribution"), ("2 0", "2 5", "3 0", "4 0")),
    ("sharealike", "cc-by-sa", ("creative commons attribution sharealike",), ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", "cc0", ("cc0", "creative commons cc0"), ("1 0",)),
    ("isc", "isc", ("isc", "isc ?style"), ()),
    ("zlib", "zlib", ("zlib", "zlib libpng"), ()),
    ("unlicense", "unlicense", ("the unlicense", "unlicense"), ()),
    ("artistic", "artistic", ("?perl artistic", "clarified artistic"), ("1 0", "2 0")),
    ("boost", "bsl", ("boost ?software",), ("1 0",)),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2",)),
    ("european", "eupl", ("european union public",), ("1 0", "1 1", "1 2")),
    ("common", "cddl", ("common development and distribution",), ("1 0", "1 1")),
    ("open", "ofl", ("sil open font",), ("1 0", "1 1")),
    ("database", "odbl", ("open database", "open data commons open database"), ("1 0",)),
    ("python", "psf", ("python ?software ?foundation",), ("2", "2 0")),
    ("php", "php", ("php",), ("3 0", "3 01")),
    ("openssl", "openssl", ("openssl",), ()),
    ("academic", "afl", ("academic ?free",), ("2 1", "3 0")),
    ("microsoft", "ms-pl", ("microsoft public", "microsoft reciprocal"), ()),
    ("ibm", "ipl", ("ibm public",), ("1 0",)),
    ("educational", "ecl", ("educational community",), ("1 0", "2 0")),
)

#: words around a name (``{n}``), priority (0 is the highest), weight of the evidence.
FORMS = (
    ("licensed|released|distributed|available under ?the ?terms ?of ?the {n} license|licence {v}", 0, 0.98),
    ("under ?the ?terms ?of ?the {n} license|licence {v}", 1, 0.95),
    ("{n} license|licence {v}", 2, 0.9),
    ("{n} version|v {v!}", 2, 0.85),
    ("{n} {v!}", 3, 0.7),
)

#: keyword, label, words, priority, weight: notices that name no family.
NOTICES = (
    ("reserved", "proprietary", "all rights reserved", 2, 0.6),
    ("confidential", "proprietary", "proprietary and confidential", 1, 0.8),
    ("domain", "public-domain", "in|into|to the public domain", 2, 0.7),
    ("permission", "mit", "permission is hereby granted free of charge to any person obtaining a copy", 0, 0.95),
    ("redistribution", "bsd", "redistribution and use in source and binary forms", 0, 0.95),
    ("permission", "isc", "permission to use copy modify and or distribute this software for any purpose", 0, 0.95),
)


@dataclass(frozen=True)
class Signature:
    keyword: str
    label: str
    pattern: str
    priority: int
    weight: float


def pattern(words: str) -> str:
    """A regular expression over a text whose words each stand between two spaces of their own."""
    out = []
    for word in words.split():
        optional, word = word.startswith("?"), word.removeprefix("?")
        part = f"(?: (?:{word}) )" if "|" in word else f" {word} "
        out.append(f"(?:{part})?" if optional else part)
    return "".join(out)


def signatures() -> list[Signature]:
    """All rules in order: by priority, and longer ones first."""
    found = []
    for keyword, label, names, versions in FAMILIES:
        known = "(?: version | v )?(?:" + "|".join(pattern(v) for v in versions) + ")" if versions else ""
        for form, priority, weight in FORMS:
            if "{v!}" in form and not versions:
                continue
            for name in names:
                before, _, after = form.partition("{n}")
                after, _, _ = after.partition("{v")
                tail = known if "{v!}" in form else f"(?:{known})?" if known else ""
                found.append(Signature(keyword, label, pattern(before) + pattern(name) + pattern(after) + tail, priority, weight))
    found += [Signature(k, label, pattern(words), priority, weight) for k, label, words, priority, weight in NOTICES]
    found = sorted(set(found), key=lambda s: (s.priority, -len(s.pattern), s.pattern, s.label))
    return found


def must_hold(pattern: str) -> list[str]:
    """Plain strings that any match of the pattern holds: stretches outside all groups, and what the choices
    of a group that is not optional have in common at their start."""
    held, run, at = [], "", 0
    while at < len(pattern):
        if pattern[at] != "(":
            run, at = run + pattern[at], at + 1
            continue
        end, depth = at, 0
        while True:
            depth += (pattern[end] == "(") - (pattern[end] == ")")
            end += 1
            if not depth:
                break
        held.append(run)
        run, group, at = "", pattern[at + 3 : end - 1], end
        if pattern[at : at + 1] == "?":
            at += 1
        elif choice := re.fullmatch(r" \(\?:([^()]*)\) ", group):
            held.append(" " + os.path.commonprefix(choice[1].split("|")))
        elif "(" not in group:
            held.append(os.path.commonprefix(group.split("|")))
    return sorted({h for h in [*held, run] if h.strip()}, key=len, reverse=True)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """``array<struct<start, label>>``: where a phrase's words stand consecutively."""

    def at(i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in phrases:
            same = F.lit(True)
            for k, word in enumerate(phrase):
                same = same & (F.coalesce(F.get(words, i + k), F.lit("")) == word)
            label = F.when(same, name).otherwise(label)
        return F.struct(i.cast("long").alias("start"), label.alias("label"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), at), lambda p: p.label.isNotNull())


def detections(words: Column, rules: list[Signature]) -> Column:
    """``array<struct<start, back, priority, rule, label, weight>>`` of all signatures whose keyword
    is there, sorted by start and, at one start, longest first. ``back`` is minus the end."""
    table = F.array(
        *[
            F.struct(
                F.lit(s.keyword).alias("keyword"), F.lit(s.pattern).alias("pattern"), F.lit(s.priority).alias("priority"),
                F.lit(i).alias("rule"), F.lit(s.label).alias("label"), F.lit(s.weight).alias("weight"), F.array(*map(F.lit, must_hold(s.pattern))).alias("holds"),
            )
            for i, s in enumerate(rules)
        ]
    )
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    keywords = F.array_intersect(words, F.array(*[F.lit(k) for k in sorted({s.keyword for s in rules})]))
    kind = "array<struct<start:int,back:int,priority:int,rule:int,label:string,weight:double>>"

    def intervals(text: Column, rule: Column) -> Column:
        """One pass of the expression for the hits and one for what lies between; both are bound, so that no
        hit runs them again."""
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def ends(parts: Column) -> Column:
            lengths = F.zip_with(parts.hits, parts.gaps, lambda h, g: F.struct(F.length(h).alias("hit"), F.length(g).alias("gap")))
            lengths = F.filter(lengths, lambda x: x.hit.isNotNull())  # there is one gap more
            step = lambda acc, x: F.struct((acc.at + x.gap + x.hit).alias("at"), F.array_append(acc.out, acc.at + x.gap + x.hit).alias("out"))
            return F.aggregate(lengths, none, step, lambda acc: acc.out)

        def places(parts: Column) -> Column:
            one = lambda end, hit: F.struct(
                (end - F.length(hit)).alias("start"), (-end).alias("back"), rule.priority.alias("priority"), rule.rule.alias("rule"),
                rule.label.alias("label"), rule.weight.alias("weight"),
            )
            return let(ends(parts), lambda found: F.zip_with(found, parts.hits, one))

        hits = F.regexp_extract_all(text, rule.pattern, F.lit(0))
        return let(
            hits, lambda found: F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(
                let(F.struct(found.alias("hits"), F.split(text, rule.pattern, -1).alias("gaps")), places)
            )
        )

    return let(
        F.struct(spaced.alias("text"), keywords.alias("keywords")),
        lambda doc: F.sort_array(
            F.flatten(
                F.transform(
                    F.filter(table, lambda r: F.array_contains(doc.keywords, r.keyword) & F.forall(r.holds, lambda part: F.contains(doc.text, part))),
                    lambda r: intervals(doc.text, r),
                )
            )
        ),
    )


def resolve(found: Column, priorities: list[int]) -> Column:
    """``struct<labels, score, n>`` of the detections that are not suppressed. Whatever could contain a
    detection stands before it in the order, so the furthest end so far, by priority, decides."""
    none = F.struct(
        *[F.lit(-1).alias(f"end{p}") for p in priorities],
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"),
    )

    def step(acc: Column, d: Column) -> Column:
        end = -d.back
        inside = F.lit(False)
        for p in priorities:
            inside = inside | ((d.priority >= p) & (acc[f"end{p}"] >= end))
        return F.struct(
            *[
                F.when(d.priority == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}")
                for p in priorities
            ],
            F.when(inside, acc.labels).otherwise(F.array_union(acc.labels, F.array(d.label))).alias("labels"),
            F.when(inside, acc.score).otherwise(F.greatest(acc.score, d.weight)).alias("score"),
            (acc.n + F.when(inside, 0).otherwise(1)).alias("n"),
        )

    return F.aggregate(found, none, step, lambda acc: F.struct(acc.labels.alias("labels"), acc.score.alias("score"), acc.n.alias("n")))


def scan(docs: DataFrame, text: str = "text", out: str = "license", rules: list[Signature] | None = None) -> DataFrame:
    """``docs`` with ``out``: ``n_words``, base ``places``, and the method's ``labels``, ``score`` and
    number ``n`` of detections left."""
    rules = signatures() if rules is None else rules
    priorities = sorted({s.priority for s in rules})
    gate = "(?:" + "|".join(sorted({s.keyword for s in rules} | {p[0][-1] for p in PHRASES})) + ")"
    nothing = F.struct(
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n")
    )
    no_places = F.array().cast("array<struct<start:bigint,label:string>>")

    def judge(words: Column) -> Column:
        some = F.size(words) > 0
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.when(some, phrase_places(words)).otherwise(no_places).alias("places"),
            F.when(some, resolve(detections(words, rules), priorities)).otherwise(nothing).alias("found"),
        )

    def either(lower: Column) -> Column:
        # Most texts hold no keyword: their words are counted, not taken out.
        plain = F.struct(
            F.regexp_count(lower, F.lit(WORD)).cast("long").alias("n_words"), no_places.alias("places"), nothing.alias("found")
        )
        return F.when(lower.rlike(gate), let(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), judge)).otherwise(plain)

    return docs.withColumn(out, let(lowered(F.col(text)), either))
