import random
import re
import re._constants as c
import re._parser as parser
import time

import pytest
from hypothesis import given, settings, strategies as st

from brightshelf.llm import licenses
from brightshelf.llm.licenses import Scanner, scan_licenses, settle, signature_rules

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p)
    return len(words), places


def base_of(row):
    return row["n_words"], sorted((d["word"], d["label"]) for d in row["detections"] if d["base"])


TEXTS = [
    None,
    "",
    "All rights reserved.",
    "ALL\nrights -- reserved cc/by CC BY-NC 4.0 xcc by cc byé",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: Apache-2.0\nMIT License",
    "kommt mit der Lizenz",
    "wort " * 30000 + "General Public Licénse general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def test_base_places_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words int, detections string")
    rows = scan_licenses(df, ["doc_id"]).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert base_of(r) == brute(TEXTS[r["doc_id"]])
    labels = {r["doc_id"]: sorted({d["label"] for d in r["detections"]}) for r in rows}
    assert labels[4] == ["gpl", "gpl-3.0", "reserved"]
    assert labels[5] == ["cc-by", "cc-by-nc-4.0"]
    assert labels[6] == ["apache-2.0", "mit"]
    assert labels[7] == [] and labels[9] == ["mit"]
    spans = {d["label"]: TEXTS[4][d["start"] : d["end"]] for r in rows if r["doc_id"] == 4 for d in r["detections"]}
    assert spans["gpl"] == "General Public License" and spans["gpl-3.0"].startswith("licensed under")


def test_null_id_empty_table_and_clash(spark):
    df = spark.createDataFrame([(None, "cc by")], "doc_id long, text string")
    assert scan_licenses(df, ["doc_id"]).first()["n_words"] == 2
    assert scan_licenses(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(df.withColumnRenamed("doc_id", "n_words"), ["n_words"])


def test_several_hundred_ordered_rules():
    rules = signature_rules()
    assert len(rules) > 300
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    for r in rules:
        re.compile(r.pattern)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12), st.integers(0, 60)), max_size=25))
def test_settle_against_definition(raw):
    rules = signature_rules()
    found = [(a, a + n, k * 5 % len(rules)) for a, n, k in raw]
    order = sorted(found, key=lambda f: (-rules[f[2]].priority, f[0] - f[1], f[0], rules[f[2]].label))
    want = []
    for a, b, k in order:
        if rules[k].always or not any(x <= a and b <= y for x, y, j in want if not rules[j].always):
            want.append((a, b, k))
    assert settle(found, rules) == sorted(want)


def test_keyword_filter_loses_no_rule():
    rules = [r for r in signature_rules()]
    scan, text = Scanner(rules), b"released under the terms of the mozilla public license, version 2.0 and copyright 2020"
    everything = [(*m.span(), k) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text)]
    assert scan(text) == settle(everything, rules)
    assert {rules[k].label for *_, k in scan(text)} == {"mpl-2.0", "copyright"}
    assert licenses.BASE[0].always


def sample(items, rng):
    """A random text matched by parsed regex items."""
    out = b""
    for op, arg in items:
        if op is c.LITERAL:
            out += bytes([arg])
        elif op is c.NOT_LITERAL:
            out += b"~"
        elif op is c.IN:
            kind, value = rng.choice(arg)
            if arg[0][0] is c.NEGATE:
                out += b" "
            elif kind is c.RANGE:
                out += bytes([rng.randint(*value)])
            elif kind is c.CATEGORY:
                out += rng.choice([b" ", b"\n"]) if value is c.CATEGORY_SPACE else b"~"
            else:
                out += bytes([value])
        elif op is c.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op is c.ASSERT:
            out += sample(arg[1], rng)
        elif op is c.SUBPATTERN:
            out += sample(arg[-1], rng)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            out += b"".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
    return out


def test_gate_passes_what_each_rule_matches():
    rules, rng = signature_rules(), random.Random(5)
    for rule in rules:
        matched, parsed = 0, parser.parse(rule.pattern)
        for _ in range(60):
            text = sample(parsed, rng)
            if re.search(rule.pattern, text):
                matched += 1
                assert any(w in text.decode("utf-8", "replace") for w in rule.keywords), (rule.label, rule.priority, text)
        assert matched, rule


@pytest.mark.parametrize("label,ident", [("mpl-2.0", "MPL-2.0"), ("epl-2.0", "EPL-2.0"), ("ofl-1.1", "OFL-1.1"), ("python-2.0", "PSF-2.0"), ("mit-0", "MIT-0"), ("gpl-3.0", "GPL-3.0-or-later"), ("ms-pl", "MS-PL"), ("wtfpl", "WTFPL")])
def test_short_identifiers_pass_the_gate(label, ident):
    rules = signature_rules()
    for text in (f"Licensed under {ident}", f"License: {ident}", f"released under the {ident}"):
        assert {rules[k].label for *_, k in Scanner(rules)(text.lower().encode())} == {label}


WRAPPED = [
    ("gpl", " * This program is free software; you can redistribute it and/or modify\n * it under the terms of"),
    ("gpl", "This program is free software: you can redistribute it\nand/or modify it under"),
    ("bsd", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted"),
    ("isc", ";; Permission to use, copy, modify, and/or distribute this software for any\n;; purpose with or without fee"),
    ("mit", "// Permission is hereby\r\n//\r\n// granted, free of charge, to any person obtaining a\r\n// copy"),
    ("mit", "/* Permission is hereby granted, free of charge, to any     *\n * person obtaining a copy"),
    ("mit", '.\\" Permission is hereby granted, free of charge, to any\n.\\" person obtaining a copy'),
    ("unlicense", "This is free and unencumbered software released into the public\ndomain"),
    ("gpl-3.0", "-- licensed under the GNU General\n-- Public License, version\n-- 3"),
    ("lgpl-2.1", "GNU Lesser General\nPublic License, version 2.1"),
    ("mpl-2.0", "the terms of the Mozilla Public\n# License, v. 2.0"),
    ("bsd-3-clause", "licensed under the BSD 3-\nClause License"),
    ("cc-by-sa-4.0", "licensed under CC\nBY-SA\n4.0"),
    ("proprietary", "Unauthorized copying of this file, via any\n * medium, is strictly\n * prohibited"),
    ("copyright", "Copyright (c)\n2020"),
    ("mit", "License:\n    MIT"),
    ("apache-2.0", "SPDX-License-Identifier: (MIT OR\n#   Apache-2.0)"),
]


@pytest.mark.parametrize("label,text", WRAPPED)
def test_wrapped_wordings(label, text):
    rules = signature_rules()
    assert label in {rules[k].label for *_, k in Scanner(rules)(text.lower().encode())}


def test_spdx_tag_ends_with_its_line():
    rules = signature_rules()
    got = {rules[k].label for *_, k in Scanner(rules)(b"spdx-license-identifier: mit or isc\n\nsome words and zlib")}
    assert "isc" in got and "zlib" not in got


def test_blank_runs_cost_little():
    rules = signature_rules()
    began = time.perf_counter()
    Scanner(rules)(b"copyright" + b" \n*" * 100_000 + b"license: " * 20_000 + b"general public license " * 5_000)
    assert time.perf_counter() - began < 20


LISTS = [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
    ("SPDX-License-Identifier: Apache-2.0 AND BSD-3-Clause AND MPL-2.0", {"apache-2.0", "bsd-3-clause", "mpl-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT\nApache-2.0", {"gpl-2.0", "mit"}),
    ("SPDX-License-Identifier: (MIT AND (ISC OR\n# Zlib))", {"mit", "isc", "zlib"}),
    ("SPDX-License-Identifier: (" + "MIT AND " * 200 + "ISC)", {"mit", "isc"}),
    ("Licensed under MIT and Apache-2.0.", {"mit", "apache-2.0"}),
    ("released under the MIT License, the ISC License and the Apache License, Version 2.0", {"mit", "isc", "apache-2.0"}),
    ("Licensed under MIT. Cats and Apache-2.0", {"mit"}),
    ("Unauthorized copying of " + "this file or any part of it " * 20 + "is strictly prohibited", {"proprietary"}),
]


@pytest.mark.parametrize("text,labels", LISTS)
def test_every_licence_of_an_expression(text, labels):
    rules = signature_rules()
    assert {rules[k].label for *_, k in Scanner(rules)(text.lower().encode())} == labels
