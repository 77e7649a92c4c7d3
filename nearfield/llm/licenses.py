"""License scan with a generalised suffix automaton over license words.

The automaton holds every template and every short phrase that names a license.
A file is streamed through it word by word, which gives the matching statistics:
at each word the longest string that ends there and occurs in some template.
Maximal matches of `min_match` words or more are chained, template by template,
into covered spans; a template whose covered share reaches `min_cover` gives its
label. Phrases are found in the same pass: a state knows which phrases are
suffixes of its strings.

Words that no template has lead back to the start, so only runs of known words
are streamed; those before, between and after are skipped in bulk.

Defined results: a null or empty text has no words, no labels and score 0; a
very long text is scanned whole, in memory of a few times its size; repeated
rows each give a row; overlapping phrase places all count; of equal shares the
score is the same, and spans come in order; without documents there are no
rows. Kept columns give way to a computed one of the same name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, types as T

from .batches import map_texts
from .words import alnum_words

#: Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license texts as words. MIT, BSD (three clauses) and ISC are whole; Apache, GPL and MPL are the
#: notices that files carry, their bodies being many pages. More can be given as a parameter.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
        "in connection with the software or the use or other dealings in the software"
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
        "or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
        "general public license along with this program"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
        "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including "
        "but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
        "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
        "of the use of this software even if advised of the possibility of such damage"
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at http mozilla org mpl 2 0"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims "
        "all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data "
        "or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software"
    ),
}

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField(
        "spans",
        T.ArrayType(
            T.StructType(
                [
                    T.StructField("label", T.StringType()),
                    T.StructField("start", T.LongType()),
                    T.StructField("end", T.LongType()),
                    T.StructField("covered", T.LongType()),
                ]
            )
        ),
    ),
]


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.templates = sorted(templates)
        self.size = {t: len(templates[t].split()) for t in self.templates}
        self.phrases = sorted(phrases.items())
        texts = [self.ids(templates[t]) for t in self.templates]
        named = [self.ids(p) for p, _ in self.phrases]
        for x in [*texts, *named]:
            last = 0
            for c in x:
                last = self._add(last, c)
        self.least = min(map(len, named), default=2)
        n = len(self.link)
        #: for each state: phrases that end its strings; (template, place its longest string ends), for every occurrence
        self.ends_phrase: list[list[int]] = [[] for _ in range(n)]
        self.ends_at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        own: list[list[int]] = [[] for _ in range(n)]
        for i, x in enumerate(named):
            own[self._walk(x)].append(i)
        for k, x in enumerate(texts):
            s = 0
            for i, c in enumerate(x):
                s = self.next[s][c]
                self.ends_at[s].append((k, i + 1))
        for s in sorted(range(1, n), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends_at[self.link[s]] += self.ends_at[s]
        for s in sorted(range(1, n), key=self.len.__getitem__):
            self.ends_phrase[s] = own[s] + (self.ends_phrase[self.link[s]] if self.link[s] > 0 else [])
        self.phrase_len = [len(x) for x in named]

    def ids(self, text: str) -> list[int]:
        return [self.vocab.setdefault(w, len(self.vocab) + 1) for w in alnum_words(text.encode())]

    def _walk(self, x: list[int]) -> int:
        s = 0
        for c in x:
            s = self.next[s][c]
        return s

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return new

    def stream(self, run: list[int]) -> list[tuple[int, int]]:
        """Matching statistics: (state, length) after each word of a run of known words."""
        s, n, out = 0, 0, []
        nexts, link, length = self.next, self.link, self.len
        for c in run:
            while s and c not in nexts[s]:
                s = link[s]
                n = length[s]
            t = nexts[s].get(c)
            if t is not None:
                s, n = t, n + 1
            out.append((s, n))
        return out


def chain(matches: list[tuple[int, int, int]], gap: int) -> list[list[int]]:
    """Chains of (start in text, start in template, words) of one template: [start, end, covered words].

    A match joins the chain that ends nearest before it, if it goes on in text
    and template alike and skips at most gap words in either.
    """
    closed: list[list[int]] = []
    live: list[list[int]] = []  # start, end, covered, end in template
    for s, t, n in sorted(matches):
        closed += [c for c in live if c[1] + gap < s]
        live = [c for c in live if c[1] + gap >= s]
        best = None
        for c in live:
            over = max(0, c[1] - s, c[3] - t)
            if over < n and s + over - c[1] <= gap and t + over - c[3] <= gap and (best is None or c[1] > best[1]):
                best = c
        if best is None:
            live.append([s, s + n, n, t + n])
        else:
            over = max(0, best[1] - s, best[3] - t)
            best[1], best[2], best[3] = s + n, best[2] + n - over, t + n
    return [c[:3] for c in closed + live]


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int, min_cover: float, gap: int):
        self.a = Automaton(templates, phrases)
        self.min_match, self.min_cover, self.gap = min_match, min_cover, gap

    def scan(self, text: bytes | None) -> tuple:
        a = self.a
        words = alnum_words(text)
        known = np.fromiter(map(a.vocab.get, words, repeat(0)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known > 0, [False])).view(np.int8)))
        begins, ends = edge[::2], edge[1::2]
        long = ends - begins >= min(a.least, self.min_match)
        places: list[int] = []
        base: set[str] = set()
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for s, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            stats = a.stream(known[s:e].tolist())
            for i, (state, n) in enumerate(stats):
                for p in a.ends_phrase[state]:
                    places.append(s + i + 1 - a.phrase_len[p])
                    base.add(a.phrases[p][1])
                # maximal: the next word doesn't make the match longer
                if n >= self.min_match and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                    for k, end in a.ends_at[state]:
                        matches.setdefault(k, []).append((s + i + 1 - n, end - n, n))
        spans, best, found = [], 0.0, set(base)
        for k, m in sorted(matches.items()):
            label = a.templates[k]
            for start, end, covered in chain(m, self.gap):
                share = min(1.0, covered / a.size[label])
                best = max(best, share)
                if share >= self.min_cover:
                    spans.append((label, start, end, covered))
                    found.add(label)
        score = 1.0 if base else best
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), score, [dict(zip(("label", "start", "end", "covered"), x, strict=True)) for x in sorted(spans)]


def scan_licenses(
    docs: DataFrame,
    *,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 6,
    min_cover: float = 0.3,
    gap: int = 8,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """FIELDS for each document. score is 1 where a phrase stands, else the best covered share of a template."""

    def make():
        s = Scanner(templates or TEMPLATES, PHRASES if phrases is None else phrases, min_match, min_cover, gap)
        return lambda texts: [list(c) for c in zip(*map(s.scan, texts), strict=True)] if texts else [[] for _ in FIELDS]

    return map_texts(docs, FIELDS, make, text_col, keep)
