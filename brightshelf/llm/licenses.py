"""Licence scan: ordered signature rules behind a keyword filter, overlaps settled by priority.

A text is lower-cased (A-Z) and read once by a keyword automaton. Only rules whose keyword occurs
are tried. Where detections overlap, those of higher priority stand first and swallow what lies
inside them; phrase rules (`always`) are never swallowed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brightshelf.llm.frames import TEXT, scan_text, text_buffer
from brightshelf.llm.words import LETTER_OR_DIGIT, code_points, split

_W = rb"0-9a-z\x80-\xff"
_GAP = rb"[^" + _W + rb"]+"
# What a blank of a name, form or notice stands for: blanks and line ends with the comment signs
# of the next line, so that wrapped and commented wordings match.
_SIGNS = r"*/#;%!>|\"'\\<~+=\-"
_SPACE = r" \t\r\n\f\v"
_BLANK = rf"(?:[{_SIGNS}]{{0,4}}[{_SPACE}](?:[{_SPACE}{_SIGNS}]|(?<=\n)(?:\.|::)){{0,160}})"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: bytes
    keywords: tuple[str, ...]  # the rule is tried when one of them occurs in the lower-cased text
    priority: int
    score: float
    always: bool = False


def phrase(label: str, words: str, keyword: str) -> Rule:
    """Words that stand consecutively, whatever separates them."""
    body = _GAP.join(w.encode() for w in words.split())
    return Rule(label, rb"(?<![" + _W + rb"])" + body + rb"(?![" + _W + rb"])", (keyword,), 0, 0.6, True)


def spread(pattern: str) -> bytes:
    """The pattern with every blank widened to `_BLANK`; a blank that must stay one is written \\x20."""

    def wide(m: re.Match) -> str:
        found = m[0]
        if found == "[- ]":
            return rf"(?:-{_BLANK}?|{_BLANK})"
        if found[0] == "[":
            return found.replace(" ", _SPACE + _SIGNS) if " " in found else found
        return _BLANK + ("?" if found == " *" else "")

    return re.sub(r"\[[^\]]*\]| \*?", wide, pattern).encode()


# Label, identifiers, how prose names it (regex on lower-cased text), keyword of the name.
FAMILIES: list[tuple[str, str, str, str]] = [
    ("apache-1.1", r"apache-1\.1", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1", "apache"),
    ("apache-2.0", r"apache-2(?:\.0)?", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", "apache"),
    ("mit", r"mit", r"mit(?: \(expat\)|/x11)? licen[sc]e", "mit"),
    ("mit-0", r"mit-0", r"mit no attribution(?: licen[sc]e)?", "attribution"),
    ("x11", r"x11", r"x11 licen[sc]e", "x11"),
    ("isc", r"isc", r"isc licen[sc]e", "isc"),
    ("0bsd", r"0bsd", r"(?:zero|0)[- ]clause bsd(?: licen[sc]e)?", "bsd"),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:simplified bsd|freebsd|(?:2|two)[- ]clause bsd|bsd (?:2|two)[- ]clause)(?: licen[sc]e)?", "bsd"),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|(?:3|three)[- ]clause bsd|bsd (?:3|three)[- ]clause)(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:original bsd|(?:4|four)[- ]clause bsd|bsd (?:4|four)[- ]clause)(?: licen[sc]e)?", "bsd"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v\.? ?)1(?:\.0)?", "g"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v\.? ?)2(?:\.0)?", "g"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v\.? ?)3(?:\.0)?", "g"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:library general public licen[sc]e|lgpl),? ?(?:version |v\.? ?)2(?:\.0)?(?!\.1)", "g"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v\.? ?)2\.1", "g"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v\.? ?)3(?:\.0)?", "g"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:affero general public licen[sc]e|agpl),? ?(?:version |v\.? ?)?3(?:\.0)?", "g"),
    ("gfdl-1.2", r"gfdl-1\.2(?:-only|-or-later)?", r"(?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)1\.2", "documentation"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", r"(?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)1\.3", "documentation"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[sc]e,? (?:version |v\.? ?)1\.1", "mozilla"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?", "mozilla"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[sc]e,? (?:version |v\.? ?|- v ?)1(?:\.0)?", "eclipse"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[sc]e,? (?:version |v\.? ?|- v ?)2(?:\.0)?", "eclipse"),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution licen[sc]e(?:,? (?:version |v\.? ?)1\.0)?", "distribution"),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[sc]e(?:,? (?:version |v\.? ?)1\.0)?", "common"),
    ("eupl-1.2", r"eupl-1\.2", r"european union public licen[sc]e(?:,? (?:version |v\.? ?)1\.2)?", "european"),
    ("artistic-1.0", r"artistic-1\.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?1\.0", "artistic"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", "artistic"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "boost"),
    ("busl-1.1", r"busl-1\.1", r"business source licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?", "business"),
    ("zlib", r"zlib", r"zlib licen[sc]e", "zlib"),
    ("unlicense", r"unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", r"do what the f\S{1,6} you want to public licen[sc]e", "want"),
    ("python-2.0", r"(?:psf|python)-2\.0", r"python software foundation licen[sc]e", "python"),
    ("postgresql", r"postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("php-3.01", r"php-3\.01", r"php licen[sc]e,? (?:version |v\.? ?)?3\.01", "php"),
    ("ruby", r"ruby", r"ruby licen[sc]e", "ruby"),
    ("openssl", r"openssl", r"openssl licen[sc]e", "openssl"),
    ("ofl-1.1", r"ofl-1\.1", r"(?:sil )?open font licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?", "font"),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons )?(?:open )?database licen[sc]e", "database"),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution licen[sc]e", "commons"),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication (?:and|&) licen[sc]e", "domain"),
    ("ms-pl", r"ms-pl", r"microsoft public licen[sc]e", "microsoft"),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft"),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[sc]e", "server"),
    ("elastic-2.0", r"elastic-2\.0", r"elastic licen[sc]e(?:,? (?:version |v\.? ?)?2\.0)?", "elastic"),
    ("osl-3.0", r"osl-3\.0", r"open software licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?", "software"),
    ("afl-3.0", r"afl-3\.0", r"academic free licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?", "academic"),
    ("ecl-2.0", r"ecl-2\.0", r"educational community licen[sc]e(?:,? (?:version |v\.? ?)?2\.0)?", "community"),
    ("ncsa", r"ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", "ncsa"),
    ("vim", r"vim", r"vim licen[sc]e", "vim"),
    ("cc0-1.0", r"cc0-1\.0", r"(?:creative commons )?(?:cc0|zero)(?: licen[sc]e| universal| 1\.0)", "c"),
    ("cc-by-2.0", r"cc[- ]by[- ]2\.0", r"(?:creative commons attribution|cc[- ]by)(?: licen[sc]e)? 2\.0", "c"),
    ("cc-by-3.0", r"cc[- ]by[- ]3\.0", r"(?:creative commons attribution|cc[- ]by)(?: licen[sc]e)? 3\.0", "c"),
    ("cc-by-4.0", r"cc[- ]by[- ]4\.0", r"(?:creative commons attribution|cc[- ]by)(?: licen[sc]e)? 4\.0", "c"),
    ("cc-by-sa-3.0", r"cc[- ]by-sa[- ]3\.0", r"(?:creative commons attribution[- ]share[- ]?alike|cc[- ]by-sa)(?: licen[sc]e)? 3\.0", "c"),
    ("cc-by-sa-4.0", r"cc[- ]by-sa[- ]4\.0", r"(?:creative commons attribution[- ]share[- ]?alike|cc[- ]by-sa)(?: licen[sc]e)? 4\.0", "c"),
    ("cc-by-nc-4.0", r"cc[- ]by-nc[- ]4\.0", r"(?:creative commons attribution[- ]non[- ]?commercial|cc[- ]by-nc)(?: licen[sc]e)? 4\.0", "c"),
    ("cc-by-nd-4.0", r"cc[- ]by-nd[- ]4\.0", r"(?:creative commons attribution[- ]no[- ]?deriv(?:ative)?s|cc[- ]by-nd)(?: licen[sc]e)? 4\.0", "c"),
    ("cc-by-nc-sa-4.0", r"cc[- ]by-nc-sa[- ]4\.0", r"(?:creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike|cc[- ]by-nc-sa)(?: licen[sc]e)? 4\.0", "c"),
    ("cc-by-nc-nd-4.0", r"cc[- ]by-nc-nd[- ]4\.0", r"(?:creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s|cc[- ]by-nc-nd)(?: licen[sc]e)? 4\.0", "c"),
]
# "cc" with whatever may follow it inside a name.
_CC = tuple("cc" + sign for sign in "-*/#;%!>|\"'\\<~+= \t\r\n\f\v")
# Short keywords of the table stand for these; the automaton looks for the longer forms.
_KEYWORDS = {"g": ("general", "gpl"), "c": ("commons", *_CC, "cc0", "zero")}


def stems(ident: str) -> tuple[str, ...]:
    """Literal beginnings of an identifier regex; every match starts with one of them."""
    group, rest = re.fullmatch(r"(?:\(\?:([a-z|]+)\))?(.*)", ident).groups()
    rest = re.split(r"\(\?:|\[", rest)[0].replace("\\.", ".")
    return tuple(head + rest for head in (group or "").split("|"))



# Further names of a list, up to the end of its sentence; the licence found there is a group of its own.
_LISTED = r"(?:[a-z0-9+()\x20\t-]|\.(?=[0-9])|,)*?(?<=[^a-z0-9.+-])(?:or|and|and/or) (?:the )?({name}|{id})"
# How a text refers to a licence: regex around the name, priority, score. A group is the span to report.
FORMS: list[tuple[str, str, int, float]] = [
    # An SPDX expression ends with its line unless it stands in parentheses.
    ("spdx", r"spdx-license-identifier:[\x20\t]*(?:\( *|(?:\([a-z0-9.+( -]*?|[a-z0-9.+()\x20\t-]*?)(?<=[^a-z0-9.+-])(?:or|and) (?:\( *)?)?({id})(?![0-9a-z.-])", 90, 1.0),
    ("grant", rf"licen[sc]ed (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:(?:{{name}}|{{id}})|{_LISTED})(?![0-9a-z])", 80, 0.98),
    ("release", rf"(?:released|distributed|published|available|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:(?:{{name}}|{{id}})|{_LISTED})(?![0-9a-z])", 70, 0.95),
    ("terms", r"terms (?:and conditions )?of (?:the )?(?:{name})(?![0-9a-z])", 60, 0.9),
    ("field", r"(?<![0-9a-z])licen[sc]e: *(?:the )?(?:{name}|{id})(?![0-9a-z])", 50, 0.9),
    ("name", r"(?<![0-9a-z])(?:the )?(?:{name})(?![0-9a-z])", 20, 0.8),
]

# Notices without one licence's name.
NOTICES: list[tuple[str, str, tuple[str, ...], int, float]] = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", ("hereby",), 85, 0.97),
    ("isc", r"permission to use, copy, modify, and/or distribute this software for any purpose", ("permission",), 85, 0.97),
    ("bsd", r"redistribution and use in source and binary forms,? with or without modification", ("redistribution",), 85, 0.95),
    ("gpl", r"this program is free software[:;,] you can redistribute it and/or modify it", ("redistribute",), 85, 0.95),
    ("apache-2.0", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0", ("apache.org",), 75, 0.95),
    ("mpl-2.0", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0", ("mozilla.org",), 75, 0.95),
    ("cc", r"https?://creativecommons\.org/(?:licenses|publicdomain)/[a-z0-9/.-]+", ("creativecommons.org",), 75, 0.9),
    ("gpl", r"https?://(?:www\.)?gnu\.org/licenses/[a-z0-9.-]*gpl[a-z0-9.-]*", ("gnu.org",), 75, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",), 85, 0.97),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", ("domain",), 40, 0.8),
    ("cc-by-nc", r"(?<![0-9a-z])cc[- ]by-nc(?![0-9a-z-])", _CC, 15, 0.7),
    ("cc-by-sa", r"(?<![0-9a-z])cc[- ]by-sa(?![0-9a-z-])", _CC, 15, 0.7),
    ("cc-by-nd", r"(?<![0-9a-z])cc[- ]by-nd(?![0-9a-z-])", _CC, 15, 0.7),
    ("lgpl", r"(?:lesser|library) general public licen[sc]e", ("general",), 16, 0.7),
    ("agpl", r"affero general public licen[sc]e", ("general",), 16, 0.7),
    ("copyright", r"(?:copyright|©|\(c\)) *(?:\(c\)|©)? *(?:19|20)[0-9][0-9]", ("copyright", "©", "(c)"), 5, 0.4),
    ("proprietary", r"(?:proprietary and confidential|unauthori[sz]ed (?:copying|use|reproduction)(?:(?!unauthori)[a-z ,])*?(?:is )?(?:strictly )?prohibited)", ("proprietary", "unauthori"), 30, 0.8),
    ("no-license", r"no part of this (?:publication|book|work) may be reproduced", ("reproduced",), 30, 0.8),
]

BASE = [phrase("cc-by", "cc by", "cc"), phrase("gpl", "general public license", "general"), phrase("reserved", "all rights reserved", "reserved")]


def signature_rules() -> list[Rule]:
    """All rules, highest priority first; families times forms give several hundred regexes."""
    rules = list(BASE)
    for label, ident, name, keyword in FAMILIES:
        for form, shape, priority, score in FORMS:
            gate = ("spdx-license",) if form == "spdx" else _KEYWORDS.get(keyword, (keyword,))
            # Identifiers of Creative Commons begin with a keyword of the name.
            if form != "spdx" and "{id}" in shape and keyword != "c":
                gate += stems(ident)
            rules.append(Rule(label, spread(shape.replace("{id}", ident).replace("{name}", name)), gate, priority, score))
    for label, pattern, keywords, priority, score in NOTICES:
        rules.append(Rule(label, spread(pattern), keywords, priority, score))
    return sorted(rules, key=lambda r: -r.priority)


def settle(found: list[tuple[int, int, int]], rules: list[Rule]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule) detections, those not inside a stronger one.

    Order of strength: priority, then length, then start, then label.
    """
    kept: list[tuple[int, int, int]] = []
    swallowing: list[tuple[int, int]] = []  # by start
    longest = 0
    for start, end, k in sorted(found, key=lambda f: (-rules[f[2]].priority, f[0] - f[1], f[0], rules[f[2]].label)):
        if not rules[k].always:
            near = swallowing[bisect_left(swallowing, (end - longest, 0)) : bisect_right(swallowing, (start, 1 << 62))]
            if any(end <= b for _, b in near):
                continue
            insort(swallowing, (start, end))
            longest = max(longest, end - start)
        kept.append((start, end, k))
    return sorted(kept)


class Scanner:
    """Keyword automaton and compiled rules; built once in each task."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = rules
        gated: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            for word in rule.keywords:
                gated.setdefault(word, []).append(i)
        self.keywords = ahocorasick.Automaton()
        for word, numbers in gated.items():
            self.keywords.add_word(word, numbers)
        self.keywords.make_automaton()
        self.compiled: dict[int, re.Pattern] = {}

    def __call__(self, text: bytes) -> list[tuple[int, int, int]]:
        """Settled detections of one lower-cased text: byte start, byte end, rule number."""
        tried: set[int] = set()
        for _, numbers in self.keywords.iter(text.decode("utf-8", "replace")):
            tried.update(numbers)
        found = []
        for k in tried:
            pattern = self.compiled.get(k)
            if pattern is None:
                pattern = self.compiled[k] = re.compile(self.rules[k].pattern)
            found += [(*m.span(m.lastindex or 0), k) for m in pattern.finditer(text)]
        return settle(found, self.rules) if found else []


DETECTIONS = "detections array<struct<label:string,word:bigint,start:bigint,end:bigint,score:double,base:boolean>>"


def scan_licenses(df: DataFrame, keep: list[str], text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of `df`: `keep`, n_words, and the settled detections in text order.

    `word` counts from 0 over words of letters, digits and non-ASCII characters; `start` and `end`
    are code points. Null and empty texts have no words and no detections; repeated rows repeat.
    """
    rules = rules or signature_rules()

    def kernel():
        scanner = None

        def run(batch: pa.RecordBatch) -> dict:
            nonlocal scanner
            scanner = scanner or Scanner(rules)
            data, offsets = text_buffer(batch)
            words = split(data, offsets, LETTER_OR_DIGIT)
            out = []
            for i, value in enumerate(batch.column(TEXT).to_pylist()):
                hits = scanner((value or b"").lower())
                starts = words.start[words.first[i] : words.first[i + 1]] - offsets[i]
                out.append(_described(hits, rules, value, starts) if hits else [])
            return {"n_words": words.counts(), "detections": out}

        return run

    return scan_text(df, keep, text, kernel(), f"n_words bigint, {DETECTIONS}")


def _described(hits: list[tuple[int, int, int]], rules: list[Rule], text: bytes, word_starts: np.ndarray) -> list[dict]:
    points = code_points(np.frombuffer(text, np.uint8))
    return [
        {
            "label": rules[k].label,
            "word": int(np.searchsorted(word_starts, start)),
            "start": int(points[start]),
            "end": int(points[end]),
            "score": rules[k].score,
            "base": rules[k].always,
        }
        for start, end, k in hits
    ]
