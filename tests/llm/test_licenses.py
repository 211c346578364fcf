import re

from tests.llm.util import AWKWARD, clashing, docs
from wrenchflow.llm import licenses as L
from wrenchflow.llm.common import ASCII_LOWER, WORD_PATTERN

TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: MIT OR Apache-2.0", "MIT License MIT license; mit-license X",
    "é😀 MIT License\nCopyright all rights reserved. GPL-3.0-or-later license Permission is hereby granted, free of charge, "
    "to any person obtaining a copy of Apache License 2.0 license",
    "general public license" * 3, "licence: bsd-3-clause. the gnu general public license, version 2 license gpl v2+ license",
    "summit license submit licensees mit licenses", "license", "https://www.gnu.org/licenses/gpl-3.0.html \x01 all rights reserved \x02",
    "mit license " * 300, "Apache\nLicense general  public\tlicense GENERAL PUBLIC LICENSE"]


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def kept_by_hand(text):
    text = lower(text).replace("\x01", " ").replace("\x02", " ")
    hits = [(m.start(), m.end(), p, i, label) for i, (k, r, label, p, _) in enumerate(L.rules()) if k in text
            for m in re.finditer(r, text)]
    return sorted((a, b, label) for a, b, p, i, label in hits if not any(
        c <= a and d >= b and (q < p or q == p and (d - c > b - a or d - c == b - a and j < i)) for c, d, q, j, _ in hits))


def base_by_hand(text):
    w = re.findall(WORD_PATTERN, lower(text))
    return len(w), sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(w))
                          if w[i:i + len(phrase.split())] == phrase.split())


def test_scan_equals_plain_python(spark):
    rows = list(enumerate(TEXTS, 100)) + AWKWARD
    got = L.license_scan(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        hits = sorted((d.start, d.end, d.label) for d in r.detections)
        assert hits == kept_by_hand(t), t
        n, base = base_by_hand(t)
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert r.labels == ",".join(sorted({x for _, x in base} | {x for _, _, x in hits}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_gate_and_keywords_lose_no_match():
    for keyword, regex, label, *_ in L.rules():
        for text in TEXTS:
            t = lower(text)
            if re.search(regex, t):
                assert keyword in t and any(g in t for g in L.GATE), (regex, text)
    for keyword, regex, *_ in L.rules():
        assert any(g in keyword or g in regex or g[:5] in regex.replace("[sc]", "c") for g in L.GATE), regex


def plain(regex):
    """The shortest texts of a pattern: one for each choice of its alternatives, without what is optional."""
    def of(node):
        out = [""]
        for op, arg in node:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "IN":
                kind, first = next((str(k), v) for k, v in arg)
                space = kind == "CATEGORY" and "SPACE" in str(first)
                more = [" " if space else "a" if kind == "CATEGORY" else chr(first if kind == "LITERAL" else first[0])]
            elif name == "BRANCH":
                more = [t for part in arg[1] for t in of(part)]
            elif name == "SUBPATTERN":
                more = of(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                more = [t * arg[0] for t in of(arg[2])] if arg[0] else [""]
            elif name == "NOT_LITERAL" or name == "ANY":
                more = ["a"]
            else:
                assert name.startswith("ASSERT"), name
                more = [""]
            out = [a + b for a in out for b in more]
        return sorted(set(out))
    return of(re._parser.parse(regex))


def test_every_form_of_every_name_is_found(spark):
    made = [(keyword, regex, label, t) for keyword, regex, label, *_ in L.rules() for t in plain(regex)]
    assert len(made) > len(L.rules())
    for keyword, regex, _, t in made:
        assert re.search(regex, t) and keyword in t and any(g in t for g in L.GATE), (regex, t)
    rows = [t for *_, t in made]
    got = L.license_scan(docs(spark, list(enumerate(rows)))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert sorted((d.start, d.end, d.label) for d in r.detections) == kept_by_hand(rows[r.doc_id]), rows[r.doc_id]
        assert r.labels and r.score > 0, rows[r.doc_id]


def test_names_without_the_word_license(spark):
    rows = [(1, "This package is distributed under GPL-3.0-or-later."), (2, "Released under MIT."),
            (3, "Available under CC BY-SA 4.0"), (4, "Provided under the terms of the Apache 2.0"), (5, "Published under MIT")]
    got = {r.doc_id: r.labels for r in L.license_scan(docs(spark, rows)).collect()}
    assert got == {1: "gpl-3.0-or-later", 2: "mit", 3: "cc-by-sa-4.0", 4: "apache-2.0", 5: "mit"}


def test_rules_are_distinct_and_never_match_nothing():
    rules = L.rules()
    assert len(rules) > 200 and len({(r, label) for _, r, label, *_ in rules}) == len(rules)
    assert not any(re.search(r, "") for _, r, *_ in rules)


def test_empty_table(spark):
    assert L.license_scan(docs(spark, AWKWARD).limit(0)).count() == 0
