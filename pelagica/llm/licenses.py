"""License scan by conditional compression: each template as a zstandard dictionary."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings that name or grant a license, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and"
        " this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
        " applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
        " and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name"
        " of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
        " and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Words that tell licenses apart: a difference in one of them is another license.
TELLING = frozenset("mit apache bsd gnu lesser affero mozilla gpl lgpl agpl nc nd sa by cc cc0 noncommercial noderivatives sharealike attribution".split())
CUE = re.compile(r"licen[cs]e|copyright|permission|public\s+domain|creative\s+commons|\bcc[\s-]?(?:by|0)|redistribut|free\s+software|spdx", re.I)
# A sentence; the point after a single letter ("v. 2") doesn't end it.
UNIT = re.compile(r"[^\n]*?(?:(?<![\s(]\w)[.!?;:](?=\s)|\n|$)")
WORD = re.compile(r"\w+(?:\.\d+)*")
# Ends of a sentence or paragraph, which single line ends are not.
BREAK = re.compile(r"(?:(?<![\s(]\w)(?<!\b\d)[.!?](?=\s)|\n[^\S\n]*\n)")
# Words before a digit that make it a version, and not the number of a clause.
VERSION = frozenset("version versions v ver license licence public international clause".split())
LEVEL = 3
# Least part of its own compressed size that a template must save, and wording that must be met.
SAVING = 0.15
WORDING = 0.75
# Length of a window over a long block, in lengths of the longest template; over 2.
WINDOW = 4


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    words: tuple[str, ...]
    plain: int
    dictionary: zstandard.ZstdCompressionDict


def _normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def _size(data: bytes, dictionary: zstandard.ZstdCompressionDict | None = None) -> int:
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(squeeze.compress(data))


@cache
def templates() -> list[Template]:
    """The wordings with their dictionaries."""
    return [
        Template(
            name, text, tuple(WORD.findall(text.lower())), _size(_normal(text)),
            zstandard.ZstdCompressionDict(_normal(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        )
        for name, texts in TEMPLATES.items()
        for text in texts
    ]


def blocks(text: str) -> list[tuple[int, int]]:
    """Lines and sentences with a license cue, with the rest of their sentences: start and end.

    Distances are in words, so that line ends don't matter: cues at most the longest template apart are one block, and
    a block goes on to both ends of its sentences, at most that far.
    """
    if not CUE.search(text):
        return []
    most = max(len(t.words) for t in templates())
    starts = [m.start() for m in WORD.finditer(text)]
    found: list[list[int]] = []
    for m in UNIT.finditer(text):
        if m.end() > m.start() and CUE.search(m[0]):
            if found and bisect_left(starts, m.start()) - bisect_left(starts, found[-1][1]) <= most:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
    out: list[tuple[int, int]] = []
    for a, b in found:
        first, last = bisect_left(starts, a), bisect_left(starts, b)
        low = max(starts[max(0, first - most)] if starts else a, out[-1][1] if out else 0)
        low = max((m.end() for m in BREAK.finditer(text, min(low, a), a)), default=min(low, a))
        high = starts[last + most] if last + most < len(starts) else len(text)
        stop = BREAK.search(text, max(a, b - 1), high)
        # a block that ends with its sentence needs no more
        done = BREAK.search(text, max(a, b - 2), min(len(text), b + 1))
        out.append((low, b if done else max(b, stop.end() if stop else high)))
    return out


def rank(block: str) -> list[tuple[float, Template]]:
    """Templates by the bytes they save on a block, largest share of their own size first."""
    data = _normal(block)
    plain = _size(data)
    rated = [((plain - _size(data, t.dictionary)) / t.plain, t) for t in templates()]
    return sorted((x for x in rated if x[0] >= SAVING), key=lambda x: (-x[0], -len(x[1].words)))


def wording(block: list[str], template: tuple[str, ...]) -> tuple[float, int, int, list[str], list[str], list[str]]:
    """Share of a template's words met in order, first and last block word, words missing and added between, and the words
    before the added ones."""
    match = SequenceMatcher(None, template, block, autojunk=False)
    pieces = [m for m in match.get_matching_blocks() if m.size]
    if not pieces:
        return 0.0, 0, 0, list(template), [], []
    longest = max(pieces, key=lambda m: m.size)
    # words far from the longest match belong to something else
    near = [m for m in pieces if abs((m.b - m.a) - (longest.b - longest.a)) <= max(3, len(template) // 4)]
    first, last = near[0].b, near[-1].b + near[-1].size
    met = {i for m in near for i in range(m.a, m.a + m.size)}
    have = {i for m in near for i in range(m.b, m.b + m.size)}
    missing = [w for i, w in enumerate(template) if i not in met]
    more = [i for i in range(first, last) if i not in have]
    return len(met) / len(template), first, last, missing, [block[i] for i in more], [block[i - 1] if i else "" for i in more]


def _telling(words: list[str]) -> bool:
    return any(w in TELLING or w[0].isdigit() for w in words)


def _telling_added(added: list[str], before: list[str]) -> bool:
    """The same of added words, where a digit tells only in a version: clauses may be numbered."""
    return any(w in TELLING or w[0].isdigit() and ("." in w or p in TELLING or p in VERSION) for w, p in zip(added, before))


def _confirmed(text: str, start: int, end: int) -> list[tuple]:
    """Licenses between two places, best first, each out of what the ones before it left.

    The part is ranked against all templates; of all that save enough, and differ in no word that tells licenses apart, the
    one with most words met, less those missing and added, wins.  What it covers is taken out and the rest looked at again.
    """
    todo = [(start, end)]
    found = []
    while todo:
        start, end = todo.pop()
        block = text[start:end]
        words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(block)]
        best = None
        for saving, template in rank(block):
            share, first, last, missing, added, before = wording([w for w, _, _ in words], template.words)
            if share >= WORDING and not _telling(missing) and not _telling_added(added, before):
                key = (len(template.words) - 2 * len(missing) - len(added), saving)
                if best is None or key > best[0]:
                    best = (key, saving, template, share, first, last, missing, added)
        if best is None:
            continue
        _, saving, template, share, first, last, missing, added = best
        a, b = start + words[first][1], start + words[last - 1][2]
        found.append((a, b, template.license, template.text, saving, share, " ".join(missing), " ".join(added)))
        todo += [part for part in ((start, a), (b, end)) if CUE.search(text, *part)]
    return sorted(found)


def scan(text: str | None) -> list[tuple]:
    """Confirmed licenses: ``start, end, license, template, saving, wording, missing, added`` in page order.

    A block longer than a window of ``WINDOW`` times the longest template is looked at window by window.  What starts in the
    last two template lengths of a window is left to the next one, which starts there: no license is that long with
    the words it may have added, so none is cut, and work grows with the text and not with its square.
    """
    text = text or ""
    most = max(len(t.words) for t in templates())
    found: list[tuple] = []
    for start, end in blocks(text):
        starts = [m.start() for m in WORD.finditer(text, start, end)]
        while True:
            first = bisect_left(starts, start)
            if len(starts) - first <= WINDOW * most:
                found += _confirmed(text, start, end)
                break
            cut = starts[first + (WINDOW - 2) * most]
            kept = [x for x in _confirmed(text, start, starts[first + WINDOW * most]) if x[0] < cut]
            found += kept
            start = max([cut, *(x[1] for x in kept)])
    return found


SCHEMA = (
    "doc_id long, start long, end long, license string, template string, saving double, wording double,"
    " missing string, added string, exact boolean"
)


def find_licenses(docs: DataFrame) -> DataFrame:
    """A row for every license wording in every whole text, with its exact differences from the template.

    ``start`` and ``end`` (exclusive) are code points; ``exact`` says that no word is missing or added.  Null
    and empty texts have none, a row without an id keeps its null; repeated rows give repeated results; an empty table gives
    an empty one.  Of templates as well met the one that saves more wins, then the one ranked
    first.  Long texts are looked at whole, window by window.  Columns besides ``doc_id`` and
    ``text`` are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, *found, not found[6] and not found[7])
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for found in scan(text.as_py())
            ]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds)], schema=kinds)

    kinds = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("template", pa.string()),
         ("saving", pa.float64()), ("wording", pa.float64()), ("missing", pa.string()), ("added", pa.string()), ("exact", pa.bool_())]
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
