"""License scans with a positional index of rare words (operator 6)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RESULT = "doc_id long, license string, start_term int, matched int, n_terms int"


@dataclass(frozen=True)
class Template:
    """A licence notice; ``phrases`` must each occur in full where the notice matches."""

    license: str
    text: str
    phrases: tuple[str, ...]


def _gnu(license: str, name: str, version: str, title: str) -> tuple[Template, ...]:
    """Notices of a GNU licence: its header for programs, in its usual wordings, and the title of its text."""
    phrase = f"gnu {name} public license".lower()
    number = f"version {version.replace('.', ' ')}"
    return (
        Template(license, f"under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version", (phrase, f"either {number} of the license")),
        Template(license, f"under the terms of the GNU {name} Public License as published by the Free Software Foundation; version {version} of the License", (phrase, f"foundation {number} of the license")),
        Template(license, f"under the terms of the GNU {name} Public License, version {version}, as published by the Free Software Foundation", (f"{phrase} {number} as",)),
        Template(license, f"under the terms of the GNU {name} Public License version {version} or later", (f"{phrase} {number} or",)),
        Template(license, f"GNU {name} PUBLIC LICENSE Version {version}, {title}", (f"{phrase} {number}",)),
    )


def _creative_commons(license: str, kind: str) -> Template:
    return Template(license, f"licensed under a Creative Commons {kind} 4.0 International", (f"creative commons {kind} 4 0".lower().replace("-", " "),))


def _spdx(license: str) -> Template:
    words = f"SPDX-License-Identifier: {license}"
    return Template(license, words, (words.lower().replace("-", " ").replace(".", " ").replace(":", ""),))


TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit license",)),
    Template("MIT", "Licensed under the MIT License.", ("mit license",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge", "permission is hereby granted")),
    Template("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("shall be included in all copies or substantial portions",)),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template("Apache-2.0", "you may not use this file except in compliance with the License", ("except in compliance with the license",)),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache license version 2 0 january 2004",)),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ("gnu general public license version 2",)),
    Template("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",)),
    Template("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license version 3",)),
    *_gnu("GPL-3.0", "General", "3", "29 June 2007"),
    *_gnu("GPL-2.0", "General", "2", "June 1991"),
    *_gnu("LGPL-3.0", "Lesser General", "3", "29 June 2007"),
    *_gnu("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
    *_gnu("LGPL-2.0", "Library General", "2", "June 1991"),
    *_gnu("AGPL-3.0", "Affero General", "3", "19 November 2007"),
    # BSD texts begin alike; what follows the second condition tells them apart
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms",)),
    *[Template("BSD-2-Clause", f"and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE {who} AS IS", ("provided with the distribution this software is provided by",)) for who in ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR", "AUTHOR AND CONTRIBUTORS")],
    *[Template("BSD-3-Clause", f"in the documentation and/or other materials provided with the distribution. {mark}Neither the name of", (f"provided with the distribution {mark}neither the name of".replace(".", ""),)) for mark in ("", "3. ")],
    Template("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement", ("all advertising materials mentioning features",)),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", ("with or without fee is hereby granted provided that",)),
    Template("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", ("with or without fee is hereby granted provided that",)),
    Template("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS", ("with or without fee is hereby granted the software",)),
    Template("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("and to alter it and redistribute it freely",)),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    Template("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", ("boost software license version 1 0 august",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license 2 0",)),
    Template("EPL-2.0", "made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", ("eclipse public license v2 0",)),
    Template("EPL-2.0", "Eclipse Public License - v 2.0", ("eclipse public license v 2 0",)),
    Template("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", ("eclipse public license v1 0",)),
    Template("EPL-1.0", "Eclipse Public License - v 1.0", ("eclipse public license v 1 0",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    Template("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", ("if a copy of the mpl was not distributed",)),
    Template("MPL-2.0", "Mozilla Public License Version 2.0", ("mozilla public license version 2 0",)),
    Template("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1", ("mozilla public license version 1 1",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("cc by nd 4 0",)),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc by nc sa 4 0",)),
    Template("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", ("cc by nc nd 4 0",)),
    _creative_commons("CC-BY-4.0", "Attribution"),
    _creative_commons("CC-BY-SA-4.0", "Attribution-ShareAlike"),
    _creative_commons("CC-BY-NC-4.0", "Attribution-NonCommercial"),
    _creative_commons("CC-BY-ND-4.0", "Attribution-NoDerivatives"),
    _creative_commons("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"),
    _creative_commons("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"),
    Template("CC0-1.0", "Released under CC0 1.0 Universal.", ("cc0 1 0",)),
    Template("CC0-1.0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    *map(_spdx, ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "LGPL-2.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "EPL-2.0", "EPL-1.0", "MPL-2.0", "MPL-1.1", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0")),
)


def terms_of(text: str) -> list[int]:
    return C.tokens(pa.array([text]), terms=True)[0].tolist()


class Index:
    """Template words with their positions, and phrases as term sequences."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [terms_of(t.text) for t in templates]
        self.phrases = [[terms_of(p) for p in t.phrases] for t in templates]
        self.vocabulary = np.unique(np.array([w for ws in self.words for w in ws], dtype=np.uint64))
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for n, ws in enumerate(self.words):
            for at, w in enumerate(ws):
                self.postings.setdefault(w, []).append((n, at))

    def needed(self, coverage: float) -> list[int]:
        return [math.ceil(coverage * len(w) - 1e-9) for w in self.words]

    def match(self, terms: dict[int, int], rare: set[int], coverage: float) -> list[tuple[int, int, int]]:
        """(template, start, matched) for the licence terms of one file by position.

        A rare word gives the places that its postings allow: position in the file less position in the template. At each such place
        the template's other words are counted, and the phrases must stand at it in full.
        """
        places = {(n, pos - at) for pos, w in terms.items() if w in rare for n, at in self.postings[w]}
        need, out = self.needed(coverage), []
        for n, place in sorted(places):
            matched = sum(terms.get(place + at) == w for at, w in enumerate(self.words[n]))
            if matched >= need[n] and all(self._phrase(terms, n, place, p) for p in self.phrases[n]):
                out.append((n, place, matched))
        return out

    def _phrase(self, terms: dict[int, int], n: int, place: int, phrase: list[int]) -> bool:
        ws = self.words[n]
        return any(ws[a : a + len(phrase)] == phrase and all(terms.get(place + a + i) == w for i, w in enumerate(phrase)) for a in range(len(ws) - len(phrase) + 1))


def scan_licenses(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, start_term, matched, n_terms)``: the licence notices in each text, one row for a place and licence.

    Terms are runs of letters, digits and non-ASCII characters in lower case. The document frequency of each template word is counted
    over all documents. A notice matches where at least ``coverage`` of its terms stand at their relative positions and a mandatory
    phrase is complete; any match has one of the template's rarest words, as many as could be missing and one more, and only these
    are looked up. Where several templates of a licence match at the same place, the one with most matched terms counts.

    Null ids and null or empty texts give nothing; repeated rows give one result. Other columns are ignored.
    """
    C.ship(df.sparkSession)
    index = Index(templates)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")

    def words(batches):
        """Licence words with their positions, one row a document, whatever it holds."""
        for batch in batches:
            for at, piece in C.slices(batch.column(1)):
                h, first, _, _ = C.tokens(piece, terms=True)
                code = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
                hit = np.flatnonzero(index.vocabulary[code] == h)
                doc = np.searchsorted(first, hit, side="right") - 1
                cut = np.searchsorted(doc, np.arange(len(piece) + 1))
                pos = (hit - first[doc]).astype(np.int32)
                offs = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), pa.ListArray.from_arrays(offs, pa.array(code[hit].astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(pos))], names=["doc_id", "code", "pos"])

    found = C.written(docs.mapInArrow(words, "doc_id long, code array<int>, pos array<int>").where("size(code) > 0"), "licence-words")
    counts = {r.code: r.n for r in found.select(F.explode(F.array_distinct("code")).alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
    freq = np.array([counts.get(i, 0) for i in range(len(index.vocabulary))])
    need = index.needed(coverage)
    code_of = {int(w): i for i, w in enumerate(index.vocabulary)}
    rare: set[int] = set()
    for ws, k in zip(index.words, need):  # the words of highest IDF: at most len - k terms may be missing
        order = sorted(range(len(ws)), key=lambda i: (freq[code_of[ws[i]]], ws[i]))
        rare |= {ws[i] for i in order[: len(ws) - k + 1]}
    codes = sorted(code_of[w] for w in rare)
    vocabulary = index.vocabulary

    def match(batches):
        for batch in batches:
            rows = []
            for doc, code, pos in zip(*(batch.column(i).to_pylist() for i in range(3))):
                terms = dict(zip(pos, vocabulary[code].tolist()))
                for n, place, matched in index.match(terms, rare, coverage):
                    rows.append((doc, templates[n].license, place, matched, len(index.words[n])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "license", "start_term", "matched", "n_terms"])

    hits = found.where(F.arrays_overlap("code", F.array(*map(F.lit, codes)).cast("array<int>"))).mapInArrow(match, RESULT)
    best = F.max(F.struct("matched", (-F.col("n_terms")).alias("m"))).alias("b")
    return hits.groupBy("doc_id", "license", "start_term").agg(best).select("doc_id", "license", "start_term", F.col("b.matched").alias("matched"), (-F.col("b.m")).cast("int").alias("n_terms"))


def sql(templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.8) -> str:
    """DuckDB SQL for the same rows: every alignment of every template is counted."""

    def parts(x: str) -> list[str]:
        import re

        return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", x.lower()) if w]

    rows, phrases, n_phrases = [], [], []
    for n, t in enumerate(templates):
        ws = parts(t.text)
        need = math.ceil(coverage * len(ws) - 1e-9)
        rows += [f"({n}, '{t.license}', {i}, '{w}', {len(ws)}, {need})" for i, w in enumerate(ws)]
        n_phrases.append(f"({n}, {len(t.phrases)})")
        for k, p in enumerate(t.phrases):
            ps = parts(p)
            for a in range(len(ws) - len(ps) + 1):
                if ws[a : a + len(ps)] == ps:
                    phrases += [f"({n}, {k}, {a}, {a + i}, {len(ps)})" for i in range(len(ps))]
    return rf"""
    WITH template(n, license, spot, w, n_terms, need) AS (VALUES {", ".join(rows)}),
    phrase(n, k, a, spot, size) AS (VALUES {", ".join(phrases)}),
    wanted(n, phrases) AS (VALUES {", ".join(n_phrases)}),
    texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{{-\x7f]+'), lambda x: x <> '') AS t FROM texts),
    terms AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS pos FROM split),
    hits AS (SELECT doc_id, n, license, pos - spot AS place, spot, n_terms, need FROM terms JOIN template USING (w)),
    aligned AS (SELECT doc_id, n, license, place, count(*) AS matched, n_terms FROM hits GROUP BY ALL HAVING count(*) >= any_value(need)),
    complete AS (SELECT doc_id, n, place, k FROM (
        SELECT h.doc_id, h.n, h.place, p.k, p.a FROM hits h JOIN phrase p ON h.n = p.n AND h.spot = p.spot
        GROUP BY h.doc_id, h.n, h.place, p.k, p.a, p.size HAVING count(*) = p.size) GROUP BY ALL),
    good AS (SELECT a.* FROM aligned a JOIN wanted USING (n) WHERE wanted.phrases = (
        SELECT count(*) FROM complete c WHERE c.doc_id = a.doc_id AND c.n = a.n AND c.place = a.place))
    SELECT doc_id, license, place::INT AS start_term, max(matched)::INT AS matched,
      arg_min(n_terms, (-matched) * 1000 + n_terms)::INT AS n_terms
    FROM good GROUP BY doc_id, license, place"""
