"""License detection by ordered signature rules.

A text's words are joined by single blanks; rules are regular expressions over that, so layout and punctuation do
not matter. A rule runs only where its keyword occurs (prefilter). Every match is an interval of words with the
rule's priority. Of overlapping detections one is suppressed if its interval lies within that of another with a
higher priority, or the same priority and a longer interval; of equal intervals the earlier rule stays.
Base phrases are found apart and always stay.

Defined results: null or empty text has no words, no labels and score 0. Repeated rows each get their result.
Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words_table, python_tasks

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Names by which licenses are called, as patterns over lower-case words, by label.
FAMILIES = {
    "gpl-1.0": r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?1(?: 0)?",
    "gpl-2.0": r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?2(?: 0)?",
    "gpl-3.0": r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?3(?: 0)?",
    "lgpl-2.0": r"(?:gnu )?(?:lgpl|library general public licen[sc]e)(?: version)? v?2(?: 0)?",
    "lgpl-2.1": r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version)? v?2 1",
    "lgpl-3.0": r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version)? v?3(?: 0)?",
    "agpl-3.0": r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version)? v?3(?: 0)?",
    "gfdl-1.3": r"(?:gnu )?(?:gfdl|free documentation licen[sc]e)(?: version)? v?1 3",
    "apache-1.1": r"apache(?: software)? licen[sc]e(?: version)? v?1 1",
    "apache-2.0": r"apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?",
    "mit-0": r"mit(?: no attribution|-0| 0)(?: licen[sc]e)?",
    "mit": r"(?:the )?(?:mit|expat)(?: x11)? licen[sc]e",
    "bsd-2-clause": r"(?:simplified |2 clause |two clause |freebsd )bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?",
    "bsd-3-clause": r"(?:revised |new |modified |3 clause |three clause )bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?",
    "bsd-4-clause": r"(?:original |4 clause |four clause )bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?",
    "isc": r"isc(?: software)? licen[sc]e",
    "zlib": r"zlib(?: libpng)? licen[sc]e",
    "mpl-1.1": r"(?:mpl|mozilla public licen[sc]e)(?: version)? v?1 1",
    "mpl-2.0": r"(?:mpl|mozilla public licen[sc]e)(?: version)? v?2(?: 0)?",
    "epl-1.0": r"(?:epl|eclipse public licen[sc]e)(?: version)? v?1(?: 0)?",
    "epl-2.0": r"(?:epl|eclipse public licen[sc]e)(?: version)? v?2(?: 0)?",
    "cddl-1.0": r"(?:cddl|common development and distribution licen[sc]e)(?: version)? v?1(?: 0)?",
    "eupl-1.2": r"(?:eupl|european union public licen[sc]e)(?: version)? v?1 2",
    "artistic-2.0": r"artistic licen[sc]e(?: version)? v?2(?: 0)?",
    "boost-1.0": r"boost software licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "unlicense": r"(?:the )?unlicen[sc]e(?! [a-z]*ed)",
    "wtfpl": r"wtfpl|do what the fuck you want to public licen[sc]e",
    "postgresql": r"postgresql licen[sc]e",
    "python-2.0": r"(?:python|psf) (?:software foundation )?licen[sc]e(?: version)?(?: v?2(?: 0)?)?",
    "openssl": r"openssl licen[sc]e",
    "ofl-1.1": r"(?:sil )?open font licen[sc]e(?: version)?(?: v?1 1)?",
    "cc0-1.0": r"cc0(?: 1 0)?(?: universal)?|creative commons zero",
    "cc-by-nc-nd": r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no derivatives?|noderivatives)(?: \d 0)?",
    "cc-by-nc-sa": r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: \d 0)?",
    "cc-by-nc": r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: \d 0)?",
    "cc-by-nd": r"(?:cc|creative commons) (?:by|attribution) (?:nd|no derivatives?|noderivatives)(?: \d 0)?",
    "cc-by-sa": r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: \d 0)?",
    "cc-by-4.0": r"(?:cc|creative commons) (?:by|attribution)(?: licen[sc]e)?(?: version)? 4 0",
    "cc-by-3.0": r"(?:cc|creative commons) (?:by|attribution)(?: licen[sc]e)?(?: version)? 3 0",
    "public-domain": r"public domain(?: dedication)?",
    "proprietary": r"proprietary licen[sc]e|all rights reserved",
}
# How a name is used, as a template around it, and the priority of that evidence.
TEMPLATES = [
    ("grant", r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}(?: or (?:at your option )?(?:any )?later(?: version)?)?", 5),
    ("distributed", r"(?:released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?{name}", 5),
    ("identifier", r"spdx licen[sc]e identifier {name}", 6),
    ("heading", r"(?:^|licen[sc]e(?: is)? |licen[sc]e type ){name}", 4),
    ("subject", r"subject to (?:the )?(?:terms of (?:the )?)?{name}", 4),
    ("choice", r"(?:either|under your choice of) (?:the )?{name} or", 4),
    ("mention", r"{name}", 2),
]
# Words of the license texts themselves, and what they belong to.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 8),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 8),
    ("bsd-2-clause", r"redistribution and use in source and binary forms with or without modification are permitted", 7),
    ("bsd-3-clause", r"redistribution and use in source and binary forms(?: [^ ]+){1,120}? neither the name of", 8),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[sc]e", 8),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 7),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e", 8),
    ("agpl", r"under the terms of the gnu affero general public licen[sc]e", 8),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 8),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 8),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", 7),
    ("gpl", r"gnu general public licen[sc]e", 1), ("apache", r"apache licen[sc]e", 1), ("mit", r"mit licen[sc]e", 1),
    ("cc-by", r"cc by|creative commons attribution", 1), ("bsd", r"bsd licen[sc]e", 1),
]
#: Words without which no rule can match: a literal part of every rule.
KEYWORDS = ("licen", "gpl", "apache", "mit", "bsd", "mpl", "epl", "cddl", "eupl", "cc ", "cc0", "creative commons", "public domain",
            "wtfpl", "gfdl", "all rights reserved", "gnu", "redistribution", "hereby granted", "permission to use", "unencumbered",
            "provided as is")


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: re.Pattern
    pattern: re.Pattern
    priority: int


def _keyword(label: str) -> str:
    """What every name of a family contains."""
    parts = {"gpl": "gpl|general public", "lgpl": "lgpl|general public", "agpl": "agpl|affero", "gfdl": "gfdl|free documentation",
             "cc": "cc |creative commons", "cc0": "cc0|creative commons zero", "mpl": "mpl|mozilla", "epl": "epl|eclipse",
             "cddl": "cddl|common development", "eupl": "eupl|european union", "mit": "mit|expat", "ofl": "open font",
             "public": "public domain", "python": "python|psf", "proprietary": "proprietary|all rights", "unlicense": "unlicen",
             "wtfpl": "wtfpl|do what the"}
    head = label.split("-")[0]
    return parts.get(head, head)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: every template around every family's names, then the license texts."""
    made = [Rule(f"{label}/{use}", label, re.compile(_keyword(label)),
                 re.compile(r"(?<![^ ])(?:" + around.replace("{name}", f"(?:{name})") + r")(?![^ ])"), priority)
            for label, name in FAMILIES.items() for use, around, priority in TEMPLATES]
    made += [Rule(f"{label}/text{i}", label, re.compile(re.escape(pattern.split("(")[0].split("[")[0].split("|")[0].strip()[:12])
                                                        + ("|creative" if "creative" in pattern else "")),
                  re.compile(r"(?<![^ ])(?:" + pattern + r")(?![^ ])"), priority) for i, (label, pattern, priority) in enumerate(TEXTS)]
    return tuple(made)


TABLE = ascii_words_table()
_ANY = re.compile("|".join(map(re.escape, KEYWORDS)))
_BASE = [(p, label, re.compile(r"(?<![^ ])(?=" + re.escape(p) + r"(?![^ ]))")) for p, label in BASE.items()]


def suppress(found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """The detections ``(start, end, priority, order, label)`` that no stronger one contains. Stronger ones come first,
    so each is compared with kept ones only, and of those the one that reaches farthest from the left decides."""
    kept: list[tuple[int, int, int, int, str]] = []
    starts: list[int] = []
    reach: list[int] = []  # largest end of kept detections with that start or a smaller one
    for d in sorted(found, key=lambda d: (-d[2], -(d[1] - d[0]), d[0], d[3])):
        k = bisect_right(starts, d[0])
        if k and reach[k - 1] >= d[1]:
            continue
        kept.append(d)
        starts.insert(k, d[0])
        reach.insert(k, max(d[1], reach[k - 1] if k else 0))
        for i in range(k + 1, len(reach)):
            if reach[i] >= d[1]:
                break
            reach[i] = d[1]
    return sorted(kept)


def scan(text: str | None) -> tuple:
    """``(n_words, n_base, first_word, last_word, base_labels, labels, score)`` of one text."""
    words = (text or "").encode("utf-8", "replace").translate(TABLE).split()
    n = len(words)
    joined = b" ".join(words).decode("utf-8", "replace")
    if not _ANY.search(joined):
        return n, 0, None, None, "", "", 0.0
    position = _word_numbers(joined)
    starts, base = [], set()
    for phrase, label, pattern in _BASE:
        if phrase in joined:
            for m in pattern.finditer(joined):
                starts.append(position(m.start()))
                base.add(label)
    found = []
    for order, rule in enumerate(rules()):
        if rule.keyword.search(joined):
            found += [(m.start(), m.end(), rule.priority, order, rule.label) for m in rule.pattern.finditer(joined)]
    kept = suppress(found)
    best = max([d[2] for d in kept], default=0)
    score = max(best / (best + 2.0) if best else 0.0, 0.5 if base else 0.0)
    labels = ",".join(sorted(base | {d[4] for d in kept}))
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, score


def _word_numbers(joined: str):
    """The number of the word that starts at a place, counted on from the last place asked for where it lies before."""
    last = [0, 0]

    def number(at: int) -> int:
        if at < last[0]:
            last[:] = [0, 0]
        last[1] += joined.count(" ", last[0], at)
        last[0] = at
        return last[1]

    return number


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``FIELDS``."""
    python_tasks(docs.sparkSession)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([scan(t) for t in texts], columns=names)
        return rows.astype({c: "Int64" for c in names[:4]})

    kept = [c for c in docs.columns if c not in names]
    return docs.withColumn("_found", run(F.col(text))).select(*kept, *[f"_found.{c}" for c in names])
