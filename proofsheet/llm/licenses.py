"""Operator 2: licence scan by ordered signature rules.

A few hundred signatures run over the words of a text (lower case, single
spaces).  A keyword gate decides which rules look at a text at all; a rule's
regular expression then marks its places.  Detections are word intervals with
a priority; one that lies inside another of the same or a higher priority is
suppressed, by sweeps over blocks of the intervals in order.

Native: one pass of Column functions, no shuffle; rows stay where they are.

Defined results: null and empty texts have no words and no labels ('' and
score 0); every repeated row gets its own result; an empty table gives an
empty result; input columns named like outputs are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.text import n_spaced, spaced_words

#: Phrases that are labels by themselves (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

CC_KINDS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial",
            "by nd": "attribution no ?deriv(?:ative)?s(?: works)?", "by nc sa": "attribution non ?commercial share ?alike",
            "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
GNU = {"gpl": ("general public", ["1", "2", "3"]), "lgpl": ("(?:lesser|library) general public", ["2", "2 1", "3"]),
       "agpl": ("affero general public", ["1", "3"]), "gfdl": ("free documentation", ["1 1", "1 2", "1 3"])}
SPDX = ["0bsd", "afl 3 0", "apache 1 1", "apache 2 0", "artistic 1 0", "artistic 2 0", "blueoak 1 0 0", "bsd 1 clause",
        "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "bsl 1 0", "busl 1 1", "cc0 1 0", "cddl 1 0", "cddl 1 1", "cecill 2 1",
        "cpl 1 0", "ecl 2 0", "epl 1 0", "epl 2 0", "eupl 1 1", "eupl 1 2", "isc", "lppl 1 3c", "mit", "mit 0", "mpl 1 0",
        "mpl 1 1", "mpl 2 0", "ms pl", "ms rl", "mulanpsl 2 0", "ncsa", "odbl 1 0", "ofl 1 1", "osl 3 0", "pddl 1 0",
        "php 3 01", "postgresql", "psf 2 0", "python 2 0", "ruby", "sspl 1 0", "unlicense", "upl 1 0", "vim", "wtfpl",
        "x11", "zlib", "zpl 2 1"]
#: label, priority, keyword, expression over single-spaced words, confidence
SINGLE = [
    ("mit", 3, "mit licen", "(?:the )?mit licen[cs]e", 0.9),
    ("mit", 2, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", 1, "without warranty of any kind", "the software is provided as is without warranty of any kind", 0.5),
    ("isc", 2, "permission to use", "permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("isc", 3, "isc licen", "isc licen[cs]e", 0.9),
    ("bsd", 2, "redistribution and use", "redistributions? and use in source and binary forms with or without modification", 0.9),
    ("bsd", 1, "redistributions of source", "redistributions of source code must retain the above copyright notice", 0.7),
    ("bsd", 1, "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice", 0.7),
    ("bsd-3-clause", 2, "neither the name", "neither the name of .{1,80}? nor the names of its contributors", 0.9),
    ("bsd-4-clause", 2, "advertising materials", "all advertising materials mentioning features or use of this software", 0.9),
    ("bsd", 2, "bsd", "bsd (?:style )?licen[cs]e", 0.85),
    ("bsd-2-clause", 3, "bsd", "(?:2|two) clause bsd|simplified bsd|bsd 2 clause", 0.9),
    ("bsd-3-clause", 3, "bsd", "(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd 3 clause", 0.9),
    ("apache-2.0", 3, "apache", "apache licen[cs]e (?:version )?2(?: 0)?", 0.95),
    ("apache-1.1", 3, "apache", "apache (?:software )?licen[cs]e (?:version )?1 1", 0.95),
    ("apache", 2, "apache", "apache (?:software )?licen[cs]e", 0.8),
    ("apache-2.0", 3, "apache org", "apache org licenses license 2 0", 0.95),
    ("apache-2.0", 1, "in compliance with the license", "you may not use this file except in compliance with the license", 0.7),
    ("mpl-2.0", 3, "mozilla", "mozilla public licen[cs]e (?:version |v )?2(?: 0)?", 0.95),
    ("mpl-1.1", 3, "mozilla", "mozilla public licen[cs]e (?:version |v )?1 1", 0.95),
    ("mpl", 2, "mozilla", "mozilla public licen[cs]e", 0.8),
    ("epl", 2, "eclipse", "eclipse public licen[cs]e", 0.85),
    ("epl-2.0", 3, "eclipse", "eclipse public licen[cs]e (?:version |v )?2(?: 0)?", 0.95),
    ("cddl", 2, "common development", "common development and distribution licen[cs]e", 0.9),
    ("eupl", 2, "european union", "european union public licen[cs]e", 0.9),
    ("cecill", 2, "cecill", "cecill(?: [abc])? licen[cs]e", 0.9),
    ("boost", 2, "boost", "boost software licen[cs]e", 0.9),
    ("zlib", 2, "zlib", "zlib(?: libpng)? licen[cs]e", 0.85),
    ("zlib", 1, "altered source versions", "altered source versions must be plainly marked as such", 0.8),
    ("artistic", 2, "artistic licen", "(?:the )?artistic licen[cs]e", 0.85),
    ("artistic-2.0", 3, "artistic licen", "artistic licen[cs]e (?:version )?2 0", 0.95),
    ("psf", 2, "python software foundation", "python software foundation licen[cs]e", 0.9),
    ("php", 2, "php licen", "php licen[cs]e", 0.8),
    ("postgresql", 2, "postgresql licen", "postgresql licen[cs]e", 0.9),
    ("ofl", 2, "open font", "(?:sil )?open font licen[cs]e", 0.9),
    ("odbl", 2, "open database", "open database licen[cs]e|open data commons", 0.85),
    ("ogl", 2, "open government", "open government licen[cs]e", 0.9),
    ("ms-pl", 2, "microsoft", "microsoft public licen[cs]e", 0.9),
    ("ms-rl", 2, "microsoft", "microsoft reciprocal licen[cs]e", 0.9),
    ("sspl", 2, "server side", "server side public licen[cs]e", 0.9),
    ("busl", 2, "business source", "business source licen[cs]e", 0.9),
    ("elastic", 2, "elastic licen", "elastic licen[cs]e", 0.85),
    ("wtfpl", 2, "do what the", "do what the f[a-z]* you want to public licen[cs]e", 0.95),
    ("unlicense", 2, "unencumbered software", "free and unencumbered software released into the public domain", 0.95),
    ("unlicense", 3, "unlicense", "(?:the )?unlicense", 0.85),
    ("public-domain", 2, "public domain", "(?:(?:released|dedicated|placed) (?:in|into|to) )?the public domain", 0.7),
    ("public-domain", 1, "public domain", "public domain", 0.5),
    ("cc0", 3, "cc0", "cc0(?: 1 0(?: universal)?)?", 0.9),
    ("cc0", 3, "creativecommons", "creativecommons org publicdomain zero 1 0", 0.95),
    ("cc", 1, "creative commons", "creative commons(?: licen[cs]e)?", 0.5),
    ("copyright", 1, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 0.6),
    ("copyright", 1, "copyright", "copyright notice", 0.4),
    ("reserved", 3, "rights reserved", "(?:all|some|no) rights reserved", 0.7),
    ("proprietary", 2, "proprietary", "proprietary and confidential|confidential and proprietary", 0.8),
    ("proprietary", 2, "written permission", "without (?:the )?(?:prior |express )*written permission", 0.6),
    ("proprietary", 2, "reproduced", "(?:may not|must not|no part .{1,60}? may) be reproduced", 0.7),
    ("proprietary", 2, "not for redistribution", "not for redistribution", 0.7),
    ("non-commercial", 2, "non commercial", "non commercial (?:use|purposes?)(?: only)?", 0.7),
    ("non-commercial", 2, "noncommercial", "noncommercial (?:use|purposes?)(?: only)?", 0.7),
    ("non-commercial", 2, "personal use", "for personal use only", 0.6),
    ("as-is", 1, "provided as is", "provided as is", 0.3),
    ("terms", 1, "terms", "terms (?:of (?:use|service)|and conditions)", 0.4),
    ("cla", 1, "contributor licen", "contributor licen[cs]e agreement", 0.5),
    ("eula", 2, "end user", "end user licen[cs]e agreement", 0.8),
    ("redistributable", 1, "redistribut", "freely redistributable|may be (?:freely )?redistributed", 0.5),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    expression: str
    confidence: float

    @property
    def pattern(self) -> str:
        """Over text with a space before, between and after its words."""
        return f" ({self.expression})(?= )"


def _families() -> list[Rule]:
    """Rules that differ by kind and version only."""
    out = []
    for kind, name in CC_KINDS.items():
        label = "cc-" + kind.replace(" ", "-")
        out += [Rule(label, 2, f"cc {kind}", f"cc {kind}", 0.8), Rule(label, 2, "creative commons", f"creative commons {name}", 0.85)]
        for v in CC_VERSIONS:
            versioned = f"{label}-{v.replace(' ', '.')}"
            out += [Rule(versioned, 3, f"cc {kind} {v}", f"cc {kind} {v}", 0.95),
                    Rule(versioned, 3, "creativecommons org", f"creativecommons org licenses {kind} {v}", 0.95),
                    Rule(versioned, 3, "creative commons", f"creative commons {name} {v}(?: international| unported)?", 0.95)]
    for short, (name, versions) in GNU.items():
        keyword = name.rpartition(") ")[2].rpartition(" ")[2] + " licen" if short != "gfdl" else "free documentation"
        out += [Rule(short, 2, keyword, f"(?:gnu )?{name} licen[cs]e", 0.85)]
        for v in versions:
            versioned, dotted = f"{short}-{v.replace(' ', '.')}", f"{v}(?: 0)?"
            out += [Rule(versioned, 3, keyword, f"(?:gnu )?{name} licen[cs]e(?: as published by the free software foundation)?"
                                                f"(?: either)? (?:version |v )?{dotted}", 0.95),
                    Rule(versioned + "-or-later", 4, keyword, f"(?:gnu )?{name} licen[cs]e(?: as published by the free software foundation)?"
                                                             f"(?: either)? (?:version |v )?{dotted} (?:of the licen[cs]e )?or (?:at your option )?(?:any )?later(?: version)?", 0.95),
                    Rule(versioned, 2, short, f"{short} ?(?:v ?|version )?{dotted}", 0.8),
                    Rule(versioned + "-only", 4, short, f"{short} {dotted} only", 0.95),
                    Rule(versioned + "-or-later", 4, short, f"{short} {dotted} or later", 0.95)]
    for x in SPDX:
        out += [Rule(x.replace(" ", "-"), 4, "spdx license identifier", f"spdx license identifier {x}", 0.98),
                Rule(x.replace(" ", "-"), 3, "opensource org", f"opensource org licenses {x}", 0.9)]
    return out


RULES = [Rule(*x) for x in SINGLE] + _families()
LEVELS = sorted({r.priority for r in RULES})
#: Words of one block of the suppression, at least.
BLOCK_WORDS = 64


def gate_words(rules: list[Rule]) -> list[str]:
    """Shortest keywords such that each rule's keyword starts with one of them."""
    words: list[str] = []
    for keyword in sorted({r.keyword for r in rules}, key=len):
        if not any(keyword.startswith(w) for w in words):
            words.append(keyword)
    return words


def gate_pattern(words: list[str]) -> str:
    """Looks at word starts only, first letter first."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    return "(?= (" + "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in sorted(by_letter.items())) + "))"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def detections(padded: Column, rules: list[Rule]) -> Column:
    """Places of all rules whose gate word the text has: array of
    (first, last, priority, label, confidence), words from 0."""
    words = gate_words(rules)
    # one literal, parsed once by the optimizer
    table = F.from_json(F.lit(json.dumps([
        {"label": r.label, "priority": r.priority, "gate": next(w for w in words if r.keyword.startswith(w)), "keyword": r.keyword,
         "pattern": r.pattern, "confidence": r.confidence} for r in rules])),
        "array<struct<label:string,priority:int,gate:string,keyword:string,pattern:string,confidence:double>>")
    gates = F.array_distinct(F.regexp_extract_all(padded, F.lit(gate_pattern(words)), F.lit(1)))
    fired = F.flatten(F.transform(F.array(gates), lambda found: F.filter(
        table, lambda r: F.array_contains(found, r["gate"]) & F.contains(padded, F.concat(F.lit(" "), r["keyword"]))
        & F.rlike(padded, r["pattern"]))))

    def places(r: Column) -> Column:
        marked = F.split(F.trim(F.regexp_replace(padded, r["pattern"], F.lit(" \u0002$1\u0003"))), " ")
        at = F.transform(marked, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        firsts = F.filter(at, lambda x: x["w"].startswith("\u0002"))
        lasts = F.filter(at, lambda x: x["w"].endswith("\u0003"))
        return F.transform(F.arrays_zip(firsts.alias("a"), lasts.alias("b")), lambda z: F.struct(
            z["a"]["i"].alias("first"), z["b"]["i"].alias("last"), r["priority"].alias("priority"),
            r["label"].alias("label"), r["confidence"].alias("confidence")))

    return F.flatten(F.transform(fired, places))


def suppress(found: Column) -> Column:
    """Detections that lie in no other of at least their priority.

    In the order of start, then longest, then highest priority, whatever holds
    an interval comes before it.  The order is cut into blocks by first word, as
    wide as the longest detection at least, so that a holder lies in the same
    block or in the one before: each block is swept with the one before ahead
    of it, and the work grows with the number of blocks.  The sweep carries the
    furthest end so far of each priority level and above."""
    ordered = F.transform(
        F.sort_array(F.transform(found, lambda d: F.struct(
            d["first"].alias("first"), (-d["last"]).alias("neg_last"), (-d["priority"]).alias("neg_priority"),
            d["label"].alias("label"), d["confidence"].alias("confidence")))),
        lambda d: F.struct(d["first"].alias("first"), (-d["neg_last"]).alias("last"), (-d["neg_priority"]).alias("priority"),
                           d["label"].alias("label"), d["confidence"].alias("confidence")))

    def end(s, d):
        out = F.lit(-1)
        for level in LEVELS:
            out = F.when(d["priority"] == level, s[f"e{level}"]).otherwise(out)
        return out

    def sweep(part: Column, own_from: Column) -> Column:
        def step(s, d):
            ends = [F.when(d["priority"] >= level, F.greatest(s[f"e{level}"], d["last"])).otherwise(s[f"e{level}"]).alias(f"e{level}") for level in LEVELS]
            kept = F.when((d["first"] < own_from) | (end(s, d) >= d["last"]), s["kept"]).otherwise(F.concat(s["kept"], F.array(d)))
            return F.struct(*ends, kept.alias("kept"))

        start = F.struct(*[F.lit(-1).alias(f"e{level}") for level in LEVELS], F.slice(part, 1, 0).alias("kept"))
        return F.aggregate(part, start, step)["kept"]

    def in_blocks(o: Column) -> Column:
        width = F.greatest(F.lit(BLOCK_WORDS), F.array_max(F.transform(o, lambda d: d["last"] - d["first"] + 1)))

        def swept(o: Column, width: Column) -> Column:
            block = lambda i: F.floor(F.get(o, i)["first"] / width)
            begins = F.filter(F.transform(o, lambda d, i: i), lambda i: (i == 0) | (block(i) != block(i - 1)))
            return F.flatten(bound(begins, lambda at: F.transform(at, lambda begin, k: sweep(
                F.slice(o, F.coalesce(F.get(at, k - 1), F.lit(0)) + 1, F.coalesce(F.get(at, k + 1), F.size(o)) - F.coalesce(F.get(at, k - 1), F.lit(0))),
                F.get(o, begin)["first"]))))

        return bound(width, lambda w: swept(o, w))

    return bound(ordered, in_blocks)


def scan_licenses(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels,
    score and the surviving ``detections``."""
    rules = RULES if rules is None else rules
    padded, base = F.col("__padded"), "|".join(BASE)
    spaced = docs.withColumn("__spaced", spaced_words(F.col(text)))
    work = spaced.withColumns({"n_words": n_spaced(F.col("__spaced")), "__padded": F.concat(F.lit(" "), "__spaced", F.lit(" "))})
    gate = F.rlike(padded, F.lit(gate_pattern(gate_words(rules))))
    has_base = F.lit(False)
    for phrase in BASE:
        has_base = has_base | F.contains(padded, F.lit(f" {phrase} "))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    # a zero-width mark before each place keeps places that share words
    work = work.withColumn("__parts", F.when(has_base, F.split(F.regexp_replace(padded, f"(?= (?:{base}) )", "\u0001"), "\u0001")))
    work = work.withColumn("__found", F.when(gate, suppress(detections(padded, rules))))
    n_base = F.when(F.col("__parts").isNull(), 0).otherwise(F.size("__parts") - 1)
    base_set = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {p} ")), F.lit(x)) for p, x in BASE.items()]))
    found = F.col("__found")
    out = {"n_base": n_base.cast("long"),
           "first_word": F.when(F.col("__parts").isNotNull(), spaces(F.element_at("__parts", 1))).cast("long"),
           "last_word": F.when(F.col("__parts").isNotNull(), F.col("n_words") + 1 - spaces(F.element_at("__parts", -1))).cast("long"),
           "__base": F.when(has_base, base_set).otherwise(F.array().cast("array<string>"))}
    work = work.withColumns(out)
    mine = F.coalesce(F.transform(found, lambda d: d["label"]), F.array().cast("array<string>"))
    score = F.coalesce(F.array_max(F.transform(found, lambda d: d["confidence"])), F.lit(0.0))
    work = work.withColumns({
        "base_labels": F.array_join(F.sort_array("__base"), ","),
        "labels": F.array_join(F.sort_array(F.array_distinct(F.concat("__base", mine))), ","),
        "score": score, "detections": found})
    return work.drop("__spaced", "__padded", "__parts", "__found", "__base")
