"""License scans by conditional compression.

Candidate blocks are the stretches of a text that can hold a clause: as many words as the clause and ``ROOM``
more, of which so many are words of it (common ones left out) that its share of words may be ``least``. That is a
bound, so no place at or over ``least`` is passed by, wherever lines, paragraphs or texts are long. It is
counted in numpy for all texts of a slice and all clauses at once.

Each block is compressed alone and with every template as a zstandard raw dictionary; templates are ranked by
how much of the block's size the dictionary takes away. The ranked winners' clauses are confirmed by exact
wording, at each place where they stand: the words of the clause that are missing, and the words put in, found by
a longest-matching-blocks difference. Where confirmed clauses share words, the best one counts.

Every whole text is looked at. Null and empty texts have no blocks. Repeated rows are rows of their own.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches
from folioflow.llm.textkit import Words, buffers, slices, word_hash

#: fixed values: public license notices, a name and its clauses; <...> stands for any words
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: words that clauses share with any prose
COMMON = frozenset("a all and any are as at be but by can for from has have in is it its may must not of on or shall that the this to under use will with without you".split())
#: words that may be put into a clause
ROOM = 10
_WORD = re.compile(r"[0-9a-z]+(?:[.\-][0-9a-z]+)*")
_PART = re.compile(r"[0-9a-z]+")
_SPLIT = np.ones(256, bool)
_SPLIT[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False


@lru_cache(maxsize=4)
def _tests(least: float) -> tuple[np.ndarray, list[tuple[np.ndarray, int, int]]]:
    """Sorted hashes of all clauses' uncommon parts; per clause which of them are its own, how many must be
    there, and among how many parts."""
    every = sorted({p for _, c, _ in _clauses() for p in _PART.findall(c.lower()) if p not in COMMON})
    hashes = word_hash([p.encode() for p in every])
    order = np.argsort(hashes)
    number = {every[k]: i for i, k in enumerate(order.tolist())}
    out = []
    for _, clause, want in _clauses():
        parts = _PART.findall(clause.lower())
        own = [p for p in parts if p not in COMMON]
        lost = int((1 - least) * len(want) + 1e-9) * max(len(_PART.findall(w)) for w in want)
        mine = np.zeros(len(every), bool)
        mine[[number[p] for p in own]] = True
        out.append((mine, max(1, len(own) - lost), len(parts) + 4 * ROOM))
    return hashes[order], out


def stretches(texts: pa.Array, least: float = 0.9) -> list[list[tuple[int, int]]]:
    """Per text the byte spans that can hold a clause; those that touch are one."""
    data, offsets = buffers(texts)
    words = Words(data, offsets, _SPLIT, True)
    known, tests = _tests(least)
    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    place = np.flatnonzero(known[at] == words.hash)  # only words of some clause can count
    code, doc = at[place], words.doc[place]
    cover = np.zeros(len(words.hash) + 1, np.int32)
    for mine, need, wide in tests:
        own = place[mine[code]]
        first, last = own[: len(own) - need + 1], own[need - 1 :]
        if len(own) < need:
            continue
        d = doc[mine[code]]
        fits = (last - first < wide) & (d[: len(first)] == d[need - 1 :])
        # a window that holds the need begins no later than first and ends no sooner than last
        lo, hi = np.maximum(last[fits] - wide + 1, words.first[d[: len(first)][fits]]), np.minimum(first[fits] + wide, words.first[d[: len(first)][fits] + 1])
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi, -1)
    inside = np.cumsum(cover[:-1]) > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | (words.doc[1:] != words.doc[:-1])
    ends[:-1] &= ~inside[1:] | (words.doc[1:] != words.doc[:-1])
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    for x, z in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist()):
        k = int(words.doc[x])
        out[k].append((int(words.start[x] - offsets[k]), int(words.end[z] - offsets[k])))
    return out


@lru_cache(maxsize=1)
def _compressors(level: int = 3):
    import zstandard

    plain = zstandard.ZstdCompressor(level=level)
    own = {n: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict("\n".join(c).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, c in TEMPLATES.items()}
    return plain, own


def ranking(passage: str) -> list[tuple[str, float]]:
    """Templates by the share of the compressed size that they save, best first."""
    plain, own = _compressors()
    raw = passage.encode()
    alone = len(plain.compress(raw))
    return sorted(((n, (alone - len(c.compress(raw))) / alone) for n, c in own.items()), key=lambda x: (-x[1], x[0]))


@lru_cache(maxsize=1)
def _clauses() -> list[tuple[str, str, list[str]]]:
    return [(n, c, _WORD.findall(c.lower())) for n, cs in TEMPLATES.items() for c in cs]


def _regions(want: list[str], words: list[str], need: float, room: int) -> list[tuple[int, int]]:
    """Stretches of words outside which no ``len(want) + room`` words hold ``need`` words of the clause,
    each as often as the clause has it; long ones in overlapping parts, so that repeats cost no more than their
    length."""
    asked, have, common, wide = Counter(want), Counter(), 0, len(want) + room
    out: list[list[int]] = []
    for hi, w in enumerate(words):
        if w in asked:
            have[w] += 1
            common += have[w] <= asked[w]
        if hi >= wide and (x := words[hi - wide]) in asked:
            common -= have[x] <= asked[x]
            have[x] -= 1
        if common >= need:
            lo = max(0, hi - wide + 1)
            if out and lo <= out[-1][1]:
                out[-1][1] = hi + 1
            else:
                out.append([lo, hi + 1])
    return [(x, min(x + 4 * wide, hi)) for lo, hi in out for x in range(lo, max(lo + 1, hi - wide), 3 * wide)]


def places(want: list[str], words: list[str], least: float, room: int = ROOM) -> list[tuple[float, int, int, list[str], list[str]]]:
    """(share of the clause's words found in order, first word, end, missing, put in) of every disjoint
    place at or over ``least``."""
    need, out = least * len(want), []
    todo, seen = _regions(want, words, need, room), set()
    while todo:
        lo, hi = todo.pop()
        if hi - lo < need or (lo, hi) in seen:
            continue
        seen.add((lo, hi))
        core = difflib.SequenceMatcher(None, want, words[lo:hi], autojunk=False).find_longest_match()
        if not core.size:
            continue
        at = max(lo, lo + core.b - core.a - room // 2)
        near = words[at : min(hi, lo + core.b + len(want) - core.a + room // 2)]
        ops = difflib.SequenceMatcher(None, want, near, autojunk=False).get_opcodes()
        same = [op for op in ops if op[0] == "equal"]
        cover = sum(op[2] - op[1] for op in same) / len(want)
        a, z = lo + core.b, lo + core.b + core.size
        if cover >= least:
            a, z = at + same[0][3], at + same[-1][4]
            missing = [w for tag, i1, i2, _, _ in ops if tag in ("delete", "replace") for w in want[i1:i2]]
            added = [w for k, (tag, _, _, j1, j2) in enumerate(ops) if tag in ("insert", "replace") and 0 < k < len(ops) - 1 for w in near[j1:j2]]
            out.append((cover, a, z, missing, added))
            todo += [(lo, a), (z, hi)]
        else:  # the core belongs to no place; one of its ends may
            todo += [(lo, z - 1), (a + 1, hi)]
    return out


def confirm(passage: str, saved: dict[str, float], least: float) -> list[tuple[int, float, str, str, list[str], list[str]]]:
    """(offset, coverage, license, clause, missing, put in) of the confirmed clauses by place; where
    some share words, the best of them."""
    found = list(_WORD.finditer(passage.lower()))
    words = [m.group() for m in found]
    every = [(p, n, c, len(want)) for n, c, want in _clauses() if n in saved for p in places(want, words, least)]
    every.sort(key=lambda x: (x[0][0] - 0.01 * len(x[0][4]), saved[x[1]], x[3]), reverse=True)
    taken, out = bytearray(len(words)), []
    for (cover, a, z, missing, added), name, clause, _ in every:
        if not any(taken[a:z]):
            taken[a:z] = b"\1" * (z - a)
            out.append((found[a].start(), cover, name, clause, missing, added))
    return sorted(out)


def scan_all(texts: pa.Array, least: float = 0.9) -> list[list[tuple[str, int, float, float, str, list[str], list[str]]]]:
    """Per text (license, line, saved, coverage, clause, missing, put in) of every confirmed notice."""
    out = []
    for text, spans in zip(texts, stretches(texts, least)):
        found = []
        if spans:
            raw = text.as_buffer().to_pybytes()
            for a, z in spans:
                passage = raw[a:z].decode("utf-8", "ignore")  # a stretch is words whole, so its bytes are letters whole
                saved = {n: x for n, x in ranking(passage) if x > 0}
                line = raw[:a].count(b"\n")
                for offset, cover, name, clause, missing, added in confirm(passage, saved, least):
                    found.append((name, line + passage[:offset].count("\n"), saved[name], cover, clause, missing, added))
        out.append(found)
    return out


def scan(text: str | None, least: float = 0.9) -> list[tuple[str, int, float, float, str, list[str], list[str]]]:
    return scan_all(pa.array([text], pa.string()), least)[0]


FOUND = "array<struct<license:string,line:bigint,saved:double,coverage:double,clause:string,missing:array<string>,added:array<string>>>"
_NAMES = ("license", "line", "saved", "coverage", "clause", "missing", "added")


def _scan(batches, least: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int64()), ("saved", pa.float64()), ("coverage", pa.float64()), ("clause", pa.string()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))
    for b in slices(batches):
        found = [[dict(zip(_NAMES, x)) for x in per] for per in scan_all(b.column("text"), least)]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, kind)], names=["row", "found"])


def scan_licenses(df: DataFrame, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """(row, found) per row of df."""
    bounded_batches(df.sparkSession)
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(partial(_scan, least=least), f"row {kind}, found {FOUND}")
