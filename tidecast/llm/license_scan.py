"""License scans by template matching.

A template is license wording with markup: ``<<optional>> ... <</optional>>`` encloses
words that may be missing, ``<<var:min-max>>`` stands for replaceable words (names,
years). It is compiled to an automaton over words; a text has the license where the
automaton accepts a run of its words, that is, where all mandatory wording matches
exactly. A base phrase is a template without markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARKUP = re.compile(r"<<(optional|/optional|var:(\d+)-(\d+))>>")

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_COPYRIGHT = "<<optional>>copyright <<var:1-12>> <<optional>>all rights reserved<</optional>><</optional>>"
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = (
    "<<optional>>3<</optional>> neither the name of <<var:1-12>> nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission "
)
_BSD_DISCLAIMER = (
    "this software is provided by <<var:1-12>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:1-12>> be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage"
)

#: Wording of public licenses (whole texts of those that are copied into files, notices of those that are referred to), by label.
TEMPLATES = {
    "mit": (
        "<<optional>><<optional>>the<</optional>> mit license<</optional>> " + _COPYRIGHT + " permission is hereby granted free of charge "
        "to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "<<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall <<var:1-12>> be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 <<optional>>the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at <<optional>>http<</optional>> <<optional>>https<</optional>> www apache org licenses license 2 0 unless required "
        "by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
        "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license<</optional>>"
    ),
    "bsd-2": _COPYRIGHT + _BSD_TERMS + _BSD_DISCLAIMER,
    "bsd-3": _COPYRIGHT + _BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER,
    "isc": (
        "<<optional>>isc license<</optional>> " + _COPYRIGHT + " permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
        "is and <<var:1-12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall <<var:1-12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "gpl-3": "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 3",
    "gpl-2": "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 2",
    "mpl-2": (
        "subject to the terms of the mozilla public license v 2 0 <<optional>>if a copy of the mpl was not distributed with this file you can obtain one at "
        "<<optional>>http<</optional>> <<optional>>https<</optional>> mozilla org mpl 2 0<</optional>>"
    ),
    "cc-by": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution <<var:0-1>> license",
    "all-rights-reserved": "copyright <<optional>>c<</optional>> <<var:1-8>> all rights reserved",
}


class Automaton:
    """Nondeterministic automaton over words, with states 0..n and one accepting state n."""

    def __init__(self, template: str):
        self.on: list[dict[str | None, set[int]]] = [{}]  # None: any word
        self.skip: list[set[int]] = [set()]
        opened: list[int] = []
        at = 0
        self.mandatory: list[str] = []
        for piece in re.split(r"(<<[^>]*>>)", template):
            mark = MARKUP.fullmatch(piece)
            if mark is None:
                for word in WORDS.findall(piece.lower()):
                    at = self._step(at, word)
                    if not opened:
                        self.mandatory.append(word)
            elif mark[1] == "optional":
                opened.append(at)
            elif mark[1] == "/optional":
                if not opened:
                    raise ValueError("an optional region ends that did not begin")
                self.skip[opened.pop()].add(at)
            else:
                for k in range(int(mark[3])):
                    before, at = at, self._step(at, None)
                    if k >= int(mark[2]):
                        self.skip[before].add(at)
        if opened or not self.mandatory:
            raise ValueError("a template needs closed regions and a mandatory word")
        self.final = at
        self.closed = [self._closure(s) for s in range(len(self.on))]
        #: the word whose absence rules a text out; the longest is the rarest
        self.anchor = max(self.mandatory, key=len)
        first = set().union(*(self.on[s] for s in self.closed[0]))
        self.first = None if None in first else first

    def _step(self, at: int, word: str | None) -> int:
        self.on.append({})
        self.skip.append(set())
        self.on[at].setdefault(word, set()).add(len(self.on) - 1)
        return len(self.on) - 1

    def _closure(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.skip[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def match(self, words: list[str], at: int) -> int | None:
        """End of the longest accepted run that starts at ``at``."""
        states, end = set(self.closed[0]), None
        for i in range(at, len(words)):
            states = {c for s in states for w in (words[i], None) for t in self.on[s].get(w, ()) for c in self.closed[t]}
            if not states:
                break
            if self.final in states:
                end = i + 1
        return end

    def places(self, words: list[str]) -> list[tuple[int, int]]:
        """(start, end) of every place, overlapping ones too."""
        found = []
        for i, word in enumerate(words):
            if (self.first is None or word in self.first) and (end := self.match(words, i)):
                found.append((i, end))
        return found


def lower(text: str) -> str:
    """A-Z in lower case; all else as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan_text(text: str, base: list[tuple[Automaton, str]], more: list[tuple[Automaton, str]]) -> dict:
    text = lower(text)
    words = WORDS.findall(text)
    starts, base_labels, labels, covered = [], set(), set(), set()
    spans = []
    for automata, is_base in ((base, True), (more, False)):
        for automaton, label in automata:
            if automaton.anchor not in text:
                continue
            for start, end in automaton.places(words):
                covered.update(range(start, end))
                spans.append((start, end, label))
                labels.add(label)
                if is_base:
                    starts.append(start)
                    base_labels.add(label)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels)),
        "score": len(covered) / len(words) if words else 0.0,
        "spans": [f"{label}:{a}:{b}" for a, b, label in sorted(spans)],
    }


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.string()))]
)


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES
) -> DataFrame:
    """One row per document: its license labels and the word places they stand at.

    ``score`` is the share of the words that lie in some match. Null and empty
    texts have no words, no labels and score 0. Rows are handled one by one, so
    repeated rows and null ids give repeated rows and null ids; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(Automaton(p), label) for p, label in phrases.items()]
        more = [(Automaton(t), label) for label, t in templates.items()]
        for batch in batches:
            rows = [scan_text(t or "", base, more) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(OUT)[1:])], schema=OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    return rows.mapInArrow(run, schema)
