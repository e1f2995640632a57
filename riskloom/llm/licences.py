"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is lower-cased and cut into words of letters and digits. A window as long as the template slides over the text from
bigram to bigram that the template has; its Dice coefficient is ``2 * common / (bigrams of both)``, repeated bigrams
counted as often as both have them. A text shorter than the template is one window. Since common bigrams are at most
those of the shorter side, ``t / (2 - t)`` of a template's bigrams is the least a text can have to reach ``t``: smaller
texts prune the template, and so do texts with fewer hits than that. Of overlapping finds the one with the most common
bigrams, less the bigrams that only one side has, stays: a whole text beats a sentence in it, the right version the next.

Texts are read whole, each in its own row. Null and empty texts hold no licence; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from importlib.resources import files

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Customary notices and the texts of short licences.
_NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}
_GNU = {
    "GPL": ("GNU General Public License", ("1", "2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_PORTS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_REST = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means."
)
_CC0 = (
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
    "software to the public domain worldwide. This software is distributed without any warranty."
)


def _templates() -> dict[str, tuple[str, ...]]:
    made = {name: list(texts) for name, texts in _NOTICES.items()}

    def add(name: str, *texts: str) -> None:
        made.setdefault(name, []).extend(texts)

    for family, (title, versions) in _GNU.items():
        for v in versions:
            name = f"{family}-{v}" if "." in v else f"{family}-{v}.0"
            terms = "you can redistribute it and/or modify it under the terms of the " + title
            add(name, f"This work is licensed under the {title}, version {v}", f"Licensed under the {title} v{v}")
            later = f"either version {v} of the License, or (at your option) any later version."
            add(name, f"This program is free software: {terms} as published by the Free Software Foundation, {later}")
            add(name, f"This program is free software; {terms} version {v} as published by the Free Software Foundation.")
    for short, long in _CC.items():
        for v, port in _PORTS.items():
            add(f"CC-{short}-{v}", f"Licensed under CC {short} {v}", f"This work is licensed under a Creative Commons {long} {v} {port} License")
    add("MIT", made["MIT"][-1] + " " + _MIT_REST)
    add("BSD", _BSD_HEAD)
    add("BSD-2-Clause", "Licensed under the BSD 2-Clause License", _BSD_HEAD + _BSD_TWO, _BSD_HEAD + _BSD_TWO + _BSD_REST)
    add("BSD-3-Clause", "Licensed under the BSD 3-Clause License", _BSD_HEAD + _BSD_TWO + _BSD_THIRD)
    add("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_REST)
    add("ISC", "Licensed under the ISC License", _ISC)
    add("Unlicense", _UNLICENSE)
    add("CC0-1.0", "Licensed under CC0 1.0 Universal", _CC0)
    for file in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        add(file.name.removesuffix(".txt"), text)
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:  # the terms without the appendix on how to apply them
            add(file.name.removesuffix(".txt"), terms + end)
    return {name: tuple(dict.fromkeys(texts)) for name, texts in made.items()}


_WORD = re.compile(r"[^\W_]+")
Bigram = tuple[str, str]


#: Notices and whole texts by licence.
TEMPLATES = _templates()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def dice(a: Sequence[Bigram], b: Sequence[Bigram]) -> float:
    """Dice coefficient of two lists of bigrams, repeats included."""
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a or b else 0.0


def index_templates(templates: dict[str, tuple[str, ...]]) -> tuple[list[tuple[str, Counter, int]], dict[Bigram, list[int]]]:
    """Templates as bigram counts, and the templates of each bigram."""
    made, where = [], {}
    for name, texts in templates.items():
        for text in texts:
            ws = words_of(text)
            counts = Counter(zip(ws, ws[1:]))
            for pair in counts:
                where.setdefault(pair, []).append(len(made))
            made.append((name, counts, max(len(ws) - 1, 0)))
    return made, where


def find(text: str, made: list, where: dict, threshold: float) -> list[tuple[str, float, int, int]]:
    """Licences as (name, dice, first word, end word), best first where they overlap, in order of place."""
    ws = words_of(text)
    pairs = list(zip(ws, ws[1:]))
    hits: dict[int, list[int]] = {}
    fits = [len(pairs) >= threshold / (2 - threshold) * size for _, _, size in made]
    for at, pair in enumerate(pairs):
        for k in where.get(pair, ()):
            if fits[k]:
                hits.setdefault(k, []).append(at)
    found = []
    for k, places in hits.items():
        name, counts, size = made[k]
        least = threshold / (2 - threshold) * size
        if len(places) < least:
            continue
        width = min(size, len(pairs))
        held: Counter = Counter()
        common, back = 0, 0
        for at in places:  # a window ends with each hit; the best one of a find starts or ends with one
            pair = pairs[at]
            held[pair] += 1
            common += held[pair] <= counts[pair]
            while places[back] <= at - width:
                old = pairs[places[back]]
                common -= held[old] <= counts[old]
                held[old] -= 1
                back += 1
            score = 2 * common / (size + width)
            if score >= threshold:
                start = places[back]
                found.append((size + width - 3 * common, -score, -size, start, name, min(start + width, len(pairs)) + 1))
    taken: list[tuple[str, float, int, int]] = []
    for _, score, _, start, name, end in sorted(found):
        if all(end <= s or e <= start for _, _, s, e in taken):
            taken.append((name, -score, start, end))
    return sorted(taken, key=lambda x: x[2])


def scan(
    docs: DataFrame,
    text: str = "text",
    into: str = "licences",
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """``docs`` with an array ``into`` of structs ``licence``, ``dice``, ``start`` and ``end`` (words, end exclusive)."""
    made, where = index_templates(templates)

    @F.pandas_udf("array<struct<licence:string,dice:double,start:int,end:int>>")
    def of(texts: pd.Series) -> pd.Series:
        keys = ("licence", "dice", "start", "end")
        return texts.map(lambda t: [dict(zip(keys, x)) for x in find(t, made, where, threshold)])

    return docs.withColumn(into, of(F.coalesce(F.col(text).cast("string"), F.lit(""))))
