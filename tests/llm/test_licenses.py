import math
import random
import re

from codewhiff.llm import licenses as L
from helpers import prose, rows_of, table


def terms(text):
    return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if w]


def brute(rows, coverage=0.8):
    """Every alignment of every template."""
    out = {}
    for i, text in {(i, t) for i, t in rows if i is not None and t}:
        t = terms(text)
        for tpl in L.TEMPLATES:
            ws = terms(tpl.text)
            for place in range(-len(ws), len(t)):
                fit = [k for k in range(len(ws)) if 0 <= place + k < len(t) and t[place + k] == ws[k]]
                if len(fit) < math.ceil(coverage * len(ws) - 1e-9):
                    continue
                if all(any(ws[a : a + len(p)] == p and all(a + j in fit for j in range(len(p))) for a in range(len(ws))) for p in map(terms, tpl.phrases)):
                    key = (i, tpl.license, place)
                    out[key] = max(out.get(key, (0, 0)), (len(fit), -len(ws)))
    return sorted((*k, m, -n) for k, (m, n) in out.items())


def changed(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = "other"
    return " ".join(words)


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(120):
        tpl = r.choice(L.TEMPLATES).text
        rows.append((i, f"{prose(r, r.randrange(0, 12))} {r.choice([tpl, tpl.upper(), changed(r, tpl, 1), changed(r, tpl, 2), changed(r, tpl, 5), ''])}\n{prose(r, 4)} {r.choice([tpl, 'the license mit is', ''])}"))
    assert rows_of(L.scan_licenses(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    mit = L.TEMPLATES[0].text
    rows = [(1, None), (None, mit), (2, ""), (3, mit), (3, mit), (4, mit + " " + mit), (5, "word " * 50_000 + mit), (6, "license " * 2000), (7, mit.replace(" ", "-\t")), (8, "Released under the MIT")]
    assert rows_of(L.scan_licenses(table(spark, rows, clash=True))) == brute(rows)
    assert rows_of(L.scan_licenses(table(spark, []))) == []


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials provided with the distribution. "
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
NAME = "Neither the name of the copyright holder nor the names of its contributors may be used. "
STANDARD = [
    (GNU.format("General", "3"), {"GPL-3.0"}), (GNU.format("General", "2"), {"GPL-2.0"}), (GNU.format("Lesser General", "3"), {"LGPL-3.0"}), (GNU.format("Lesser General", "2.1"), {"LGPL-2.1"}),
    (GNU.format("Library General", "2"), {"LGPL-2.0"}), (GNU.format("Affero General", "3"), {"AGPL-3.0"}), ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", {"GPL-3.0"}),
    (GNU.format("General", "4"), set()), ("under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", {"GPL-2.0"}),
    (BSD + AS_IS, {"BSD", "BSD-2-Clause"}), (BSD + "3. " + NAME + AS_IS, {"BSD", "BSD-3-Clause"}), (BSD + "* " + NAME + AS_IS, {"BSD", "BSD-3-Clause"}),
    (BSD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: 4. " + NAME + AS_IS, {"BSD", "BSD-4-Clause"}),
    (USE + ", provided that the above copyright notice and this permission notice appear in all copies.", {"ISC"}), (USE + '. THE SOFTWARE IS PROVIDED "AS IS"', {"0BSD"}),
    ("This is free and unencumbered software released into the public domain.", {"Unlicense"}), ("are made available under the terms of the Eclipse Public License 2.0 which is available at", {"EPL-2.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"CC-BY-NC-SA-4.0"}), ("// SPDX-License-Identifier: BSD-3-Clause", {"BSD-3-Clause"}),
]


def names(spark, texts):
    out = [set() for _ in texts]
    for i, license, *_ in rows_of(L.scan_licenses(table(spark, list(enumerate(texts))))):
        out[i].add(license)
    return out


def test_standard_headers_and_texts(spark):
    assert names(spark, [t for t, _ in STANDARD]) == [want for _, want in STANDARD]


def test_inserted_and_missing_words(spark):
    """A place is fixed, so a word more or less costs the shorter side of the notice: found within a fifth of an end only."""
    words = GNU.format("General", "3").split()
    more = lambda k: " ".join(words[:k] + ["indeed"] + words[k:])
    less = lambda k: " ".join(words[:k] + words[k + 1 :])
    texts = [more(len(words) - 3), less(len(words) - 3), more(13), less(13), more(words.index("Foundation,") - 1), less(words.index("published"))]
    rows = list(enumerate(texts))
    assert rows_of(L.scan_licenses(table(spark, rows))) == brute(rows)
    assert names(spark, texts) == [{"GPL-3.0"}] * 4 + [set()] * 2
