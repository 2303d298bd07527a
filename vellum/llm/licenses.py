"""License scans by conditional compression.

A place of a text where enough words of a template follow, whatever their order, is the
start of a candidate block, about as long as the template. Each block is compressed with zstandard
once plainly and once with each template that may stand there as raw dictionary, with the same
parameters. The size reductions rank all pairs of block and template; from the largest down, a pair
is confirmed by its exact differences in wording and takes its words, so a short notice
inside a longer license isn't reported. The ranking only orders: no pair is left out for its size.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import map_rows, table

# The usual wording of notices and licenses, without names and years.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}
WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: Share of a template's words that may be missing, and of further words in between.
MISSING, EXTRA = 0.10, 0.20
#: Tables of both compressors; without these, zstandard takes other ones where there is a dictionary.
PARAMETERS = zstandard.ZstdCompressionParameters.from_level(3, source_size=1 << 16)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: [w.lower() for w in WORD.findall(text)] for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.masks = {name: ({w: sum(1 << i for i, x in enumerate(words) if x == w) for w in words}, (1 << len(words)) - 1) for name, words in self.words.items()}
        self.rarest = {name: sorted(c, key=lambda w: (-len(w), w)) for name, c in self.counts.items()}
        self.plain = zstandard.ZstdCompressor(compression_params=PARAMETERS)
        self.given = {name: zstandard.ZstdCompressor(compression_params=PARAMETERS, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in templates.items()}

    def candidates(self, text: str) -> list[str]:
        """Templates that may stand in the text: no more of their different words are absent than may be missing."""
        low, there, out = text.lower(), {}, []
        for name, words in self.rarest.items():
            left = int(MISSING * len(self.words[name]))
            for w in words:
                if w not in there:
                    there[w] = w in low
                left -= not there[w]
                if left < 0:
                    break
            else:
                out.append(name)
        return out

    def length(self, name: str) -> int:
        """Most words from the start of a wording to its end."""
        return len(self.words[name]) + int(EXTRA * len(self.words[name]))

    def places(self, name: str, where: dict[str, np.ndarray]) -> np.ndarray:
        """Words at which a block may start: one of the template's first, with enough of its words in reach."""
        wanted = self.words[name]
        leads = [where[w] for w in set(wanted[: int(MISSING * len(wanted)) + 1]) if w in where]
        if not leads:
            return np.zeros(0, np.int64)
        at = np.sort(np.concatenate(leads))
        found = np.zeros(len(at), np.int64)
        for w, n in self.counts[name].items():
            if w in where:
                found += np.minimum(np.searchsorted(where[w], at + self.length(name)) - np.searchsorted(where[w], at), n)
        return at[len(wanted) - found <= MISSING * len(wanted)]

    def hopeless(self, name: str, words: list[str], at: int) -> bool:
        """Whether no wording that starts at or after ``at`` within a block's length can be confirmed.

        The longest common subsequence with all words in reach bounds what can match. It is found with the
        template's words as bits of one number, a few operations a word.
        """
        masks, all_ = self.masks[name]
        open_ = all_
        for w in words[at : at + 2 * self.length(name)]:
            if hit := masks.get(w):
                both = open_ & hit
                open_ = (open_ + both | open_ - both) & all_
        return open_.bit_count() > MISSING * len(self.words[name])

    def differences(self, name: str, words: list[str], free: list[bool], at: int) -> tuple[int, int, int, int] | None:
        """(first word, end, missing, extra) of the wording that starts at or after ``at``, among free words, if it is confirmed."""
        wanted = self.words[name]

        def place(a: int) -> tuple[int, int, int, int]:
            z = min(len(words), a + self.length(name))
            while not all(free[a:z]):
                z = a + free[a:z].index(False)
            same = [m for m in SequenceMatcher(None, wanted, words[a:z], autojunk=False).get_matching_blocks() if m.size]
            if not same:
                return a, a, len(wanted), 0
            matched, start, end = sum(m.size for m in same), same[0].b, same[-1].b + same[-1].size
            return a + start, a + end, len(wanted) - matched, end - start - matched

        best = place(at)
        if best[0] > at:  # words before the wording aren't part of it
            best = min(best, place(best[0]), key=lambda p: p[2] + p[3])
        _, _, missing, extra = best
        return best if missing <= MISSING * len(wanted) and extra <= int(EXTRA * len(wanted)) else None

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, int]]:
        """Findings (license, start, stop, saved, missing, extra), by place."""
        names = self.candidates(text)
        if not names:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[x:y].lower() for x, y in spans]
        known = set().union(*(self.counts[n] for n in names))
        occurs: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in known:
                occurs.setdefault(w, []).append(i)
        where = {w: np.array(v) for w, v in occurs.items()}
        starts = {n: self.places(n, where) for n in names}
        rivals: dict[int, list[str]] = {}
        for n in names:
            for at in starts[n].tolist():
                rivals.setdefault(at, []).append(n)
        ranked = []
        for at, of in rivals.items():
            end = min(len(words), at + max(map(self.length, of)))
            data = text[spans[at][0] : spans[end - 1][1]].encode("utf-8", "surrogatepass")
            plain = len(self.plain.compress(data))
            ranked += [(len(self.given[n].compress(data)) - plain, -len(self.words[n]), at, n) for n in of]
        free, out, judged = [True] * len(words), [], {}

        def may_start(name: str, at: int) -> bool:
            if (name, at) not in judged:
                judged[name, at] = not self.hopeless(name, words, at)
            return judged[name, at]

        for less, _, at, name in sorted(ranked):
            if not free[at]:
                continue
            a, z = np.searchsorted(starts[name], [at - self.length(name), at + 1])
            # blocks of one wording overlap and save about as much; the least differences tell where it starts
            found = [f for x in starts[name][a:z].tolist() if free[x] and may_start(name, x) and (f := self.differences(name, words, free, x)) and f[1] > at]
            if found:
                i, j, missing, extra = min(found, key=lambda f: (f[2] + f[3], f[0]))
                free[i:j] = [False] * (j - i)
                out.append((name, spans[i][0], spans[j - 1][1], -less, missing, extra))
        return sorted(out, key=lambda f: (f[1], f[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License wordings in whole texts.

    Returns a row for each finding: id, license, start and stop (character offsets), saved_bytes
    (compressed size of the block without the template minus with it), missing_words and
    extra_words (0 and 0: the exact wording). Null and empty texts give no rows; repeated rows
    give repeated findings; equal savings are ranked by length, place and name; an empty table gives an empty
    one; other columns are never read.
    """
    templates = templates or TEMPLATES

    def work(batch: pa.RecordBatch, scanner: Scanner):
        ids = batch.column(0).to_pylist()
        for at in range(0, batch.num_rows, 256):
            rows = [(i, *f) for i, t in zip(ids[at : at + 256], batch.column(1).slice(at, 256).to_pylist()) if t for f in scanner.scan(t)]
            if rows:
                yield dict(zip((id_col, "license", "start", "stop", "saved_bytes", "missing_words", "extra_words"), zip(*rows)))

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return map_rows(docs, [id_col, text_col], work, f"{id_col} {kind}, license string, start long, stop long, saved_bytes long, missing_words int, extra_words int", lambda: Scanner(templates))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license wordings in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
