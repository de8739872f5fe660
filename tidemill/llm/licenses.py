"""Operator 7: licence scan by the Dice coefficient over word bigrams.

Each line, each paragraph and the whole text is a passage; besides, each template is looked for
in windows of words anywhere in the text, across lines and paragraphs. A passage or window of a bigrams reaches
similarity t with a template of b only if 2 min(a, b) / (a + b) >= t, which prunes templates by
size alone; among the rest only templates that share a bigram are compared.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import ceil

from pyspark.sql import DataFrame

from .common import Memo, once, per_batch, pick, table

LEAST = 0.8

#: Texts of public licences and notices.
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. " + _BSD_DISCLAIMER
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
        "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
        'law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING "
        "THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
}
_word = re.compile(r"[^\W_]+")
_gap = re.compile(r"\n[ \t\r]*\n")


def words(text: str) -> list[str]:
    """Normalised words: lower case, letters and digits, British spelling of licence as licence's other form."""
    return ["license" if w == "licence" else w for w in _word.findall(text.lower())]


def bigrams(found: list[str]) -> Counter:
    """Bigrams with repeats; a single word is a bigram with an empty end."""
    return Counter(zip(found, found[1:])) if len(found) > 1 else Counter((w, "") for w in found)


class Spans:
    """Windows by where they begin, so that only those near one another are compared; none is longer than `longest` words."""

    def __init__(self, longest: float):
        self.step, self.at = ceil(longest), defaultdict(list)

    def add(self, window: tuple) -> None:
        self.at[window[2] // self.step].append(window)

    def near(self, window: tuple) -> list[tuple]:
        k = window[2] // self.step
        return [w for i in (k - 1, k, k + 1) for w in self.at.get(i, ())]

    def all(self) -> list[tuple]:
        return [w for i in sorted(self.at) for w in self.at[i]]


class Templates:
    def __init__(self, texts: dict[str, str], least: float):
        self.least = least
        self.grams = {name: bigrams(words(t)) for name, t in sorted(texts.items())}
        self.size = {name: sum(g.values()) for name, g in self.grams.items()}
        self.by_gram: dict[tuple, list[str]] = defaultdict(list)
        for name, grams in self.grams.items():
            for g in grams:
                self.by_gram[g].append(name)
        self.most_words = max((n * (2 - least) / least for n in self.size.values()), default=0) + 1
        self.least_words = min((n * least / (2 - least) for n in self.size.values()), default=0)

    def best(self, passage: str) -> tuple[float, str] | None:
        """The most similar template of at least `least`; ties to the name that comes first."""
        found = words(passage)
        grams = bigrams(found)
        a = sum(grams.values())
        if not self.least_words <= a <= self.most_words:
            return None
        shared: Counter = Counter()
        for g, n in grams.items():
            for name in self.by_gram.get(g, ()):
                b = self.size[name]
                if 2 * min(a, b) >= self.least * (a + b):
                    shared[name] += min(n, self.grams[name][g])
        scored = [(2 * n / (a + self.size[name]), name) for name, n in shared.items()]
        scored = [s for s in scored if s[0] >= self.least]
        return min(scored, key=lambda s: (-s[0], s[1])) if scored else None


    def windows(self, found: list[str]) -> list[tuple[float, str, int, int]]:
        """(dice, template, first word, end) of windows of at least `least`.

        Of one template's windows that overlap, the most similar stays; so it does of windows that
        share half of the shorter one and whose templates' sizes are within the size bound (ties
        to the larger template). What then lies inside a larger template's window is part of that.
        A best window begins and ends with a bigram of the template, so only those are tried.
        """
        at: dict[str, list[tuple[int, tuple]]] = defaultdict(list)
        for i, g in enumerate(zip(found, found[1:])):
            for name in self.by_gram.get(g, ()):
                at[name].append((i, g))
        if self.least_words <= 1:  # templates of one word
            for i, w in enumerate(found):
                for name in self.by_gram.get((w, ""), ()):
                    at[name].append((i, (w, "")))
        every: list[tuple[float, str, int, int]] = []
        for name in at:
            b, places, limits, seen = self.size[name], at[name], self.grams[name], []
            longest, fewest = b * (2 - self.least) / self.least, b * self.least / (2 - self.least)
            need = max(1, ceil(fewest - 1e-9))  # a window has as many bigrams of the template
            for s in range(len(places) - need + 1):
                start, shared, counts, top = places[s][0], 0, Counter(), None
                if places[s + need - 1][0] - start + 1 > longest + 1e-9:
                    continue
                for i, g in places[s:]:
                    a = i - start + 1
                    if a > longest + 1e-9:
                        break
                    counts[g] += 1
                    if counts[g] <= limits[g]:
                        shared += 1
                        dice = 2 * shared / (a + b)
                        if dice >= self.least and (top is None or dice > top[0]):
                            top = (dice, i)
                if top:
                    seen.append((top[0], name, start, top[1] + (1 if is_word(limits) else 2)))
            own = Spans(longest + 2)
            for w in sorted(seen, key=lambda w: (-w[0], w[2], w[3])):
                if not any(w[2] < o[3] and o[2] < w[3] for o in own.near(w)):
                    own.add(w)
                    every.append(w)
        kept = Spans(self.most_words + 2)
        for w in sorted(every, key=lambda w: (-w[0], -self.size[w[1]], w[1], w[2])):
            if not any(self.rivals(w, o) for o in kept.near(w)):
                kept.add(w)
        return [w for w in kept.all() if not any(self.size[o[1]] > self.size[w[1]] and o[2] <= w[2] and w[3] <= o[3] for o in kept.near(w))]

    def rivals(self, x: tuple, y: tuple) -> bool:
        """Whether two windows could be of the same passage: templates of like size, half of the shorter window shared."""
        a, b = self.size[x[1]], self.size[y[1]]
        shared = min(x[3], y[3]) - max(x[2], y[2])
        return 2 * min(a, b) >= self.least * (a + b) and 2 * shared >= min(x[3] - x[2], y[3] - y[2])


def is_word(grams: Counter) -> bool:
    """Whether a template is a single word."""
    return len(grams) == 1 and next(iter(grams))[1] == ""


def passages(text: str):
    """(first character, passage): lines, paragraphs of more than one line, and a text of more than one paragraph."""
    start = 0
    for line in text.split("\n"):
        yield start, line
        start += len(line) + 1
    start, parts = 0, 0
    for end, after in [m.span() for m in _gap.finditer(text)] + [(len(text), len(text))]:
        if "\n" in text[start:end]:
            yield start, text[start:end]
        start, parts = after, parts + 1
    if parts > 1:
        yield 0, text


def span(text: str, start: int, passage: str) -> tuple[int, int]:
    """First word and end of a passage among the words of its text."""
    first = len(words(text[:start]))
    return first, first + len(words(passage))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, n_matches, licenses array, license, dice): matched passages and windows, their licences, and the best with its similarity.

    A window counts where no matched passage of the same licence overlaps it. licenses are sorted and distinct; license and dice are null where nothing matches. A null
    text counts as empty; null ids and repeated rows stay as they are; all passages are looked at.
    """
    texts = templates or TEMPLATES

    def make():
        known = once(("licenses", tuple(sorted(texts.items())), least), lambda: Templates(texts, least))
        vocabulary = {g[0] for g in known.by_gram}
        longest = known.most_words * 64  # characters beyond which words are counted before any comparison

        def best(passage: str):
            if len(passage) > longest and len(_word.findall(passage)) > known.most_words:
                return None
            return known.best(passage) if any(w in vocabulary for w in words(passage)) else None

        memo = Memo(best, most=100_000, longest=200)

        def run(batch):
            out = {k: [] for k in ("doc_id", "n_matches", "licenses", "license", "dice")}
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                found = [(h, i, p) for i, p in passages(text) if p and (h := memo[p])] if text else []
                hits = [h for h, _, _ in found]
                if text and (more := known.windows(words(text))):
                    spans = [(h[1], *span(text, i, p)) for h, i, p in found]
                    hits += [(d, n) for d, n, a, b in more if not any(n == m and a < y and x < b for m, x, y in spans)]
                top = min(hits, key=lambda s: (-s[0], s[1])) if hits else (None, None)
                for k, v in zip(out, (doc, len(hits), sorted({n for _, n in hits}), top[1], top[0])):
                    out[k].append(v)
            return out

        return run

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, n_matches long, licenses array<string>, license string, dice double", make)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
