"""License scans by template-markup matching.

A template is license wording with markup: [words] is optional, {name:a-b} is replaced by a to b words of any
kind, all other words are mandatory. Templates are whole licenses or whole notices (MIT, BSD with two and three
clauses, ISC, Unlicense; Apache, GPL family by version, MPL) and phrases that name a license. Each template is compiled to a token automaton; a text matches where the
automaton accepts a run of its words, so the mandatory wording has to stand there exactly, whatever the
punctuation, layout and case (of A-Z). The base phrases are templates without markup.

A text is split into words (runs of letters and digits; characters beyond ASCII count as letters) only if a
rare word of some template occurs in it; automata start only where their first word stands.

Edge cases: null text is empty; a text without words has score 0, empty labels and null positions; repeated
rows are scanned each; a text is scanned whole, however long; of the runs that one automaton accepts from one word on
the longest counts; an empty table gives no rows; scan() replaces columns named n_words and matches, other columns pass
through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.staging import small_batches
from ruleloom.llm.text import bounds

#: Phrases and their labels, as the query's contract gives them.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The wording of public licenses and of the notices that they ask for, without punctuation, with markup.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {holder:1-12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THIRD = "[3] neither the name of {organization:1-16} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by {holder:1-12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {holder:1-12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"


def _gnu(kind: str, version: str) -> str:
    """The notice of the GNU licenses."""
    name = f"gnu {kind} general public license".replace("  ", " ")
    return f"is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation [either] version {version} of the license [or at your option any later version] {{program:1-6}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details"


TEMPLATES = (
    ("mit", "under the [terms of the] mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        f" subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software {_AS_IS}",
    ),
    ("apache-2", "under the [terms of the] apache [software] license [version] [v] 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use {work:1-8} except in compliance with the license you may obtain a copy of the license at {place:1-12}"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd-2", f"{_BSD} {_BSD_END}"),
    ("bsd-3", f"{_BSD} {_BSD_THIRD} {_BSD_END}"),
    (
        "isc",
        "permission to use copy modify [and] [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and {holder:1-8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall {holder:1-8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("gpl-2", _gnu("", "2")),
    ("gpl-3", _gnu("", "3")),
    ("lgpl-2.1", _gnu("lesser", "2 1")),
    ("lgpl-3", _gnu("lesser", "3")),
    ("agpl-3", _gnu("affero", "3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {place:1-10}"),
    ("cc-by-nc", "licensed under [a] [the] creative commons attribution noncommercial {terms:0-2} {version:1-2} {scope:0-2} license"),
    ("cc-by", "licensed under [a] [the] creative commons attribution {version:1-2} [international] [unported] license"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"
        " for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
        " we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity"
        f" of all present and future rights to this software under copyright law {_AS_IS.replace('{holder:1-12}', 'the authors')}",
    ),
)

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(range(0x00, 0x30)) + list(range(0x3A, 0x61)) + list(range(0x7B, 0x80))] = False
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass
class Automaton:
    """States are numbered; step[s] has the words that lead on from s, loose[s] the states that any word leads to."""

    label: str
    step: list[dict[bytes, list[int]]] = field(default_factory=list)
    loose: list[list[int]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    words: set[bytes] = field(default_factory=set)
    accept: int = 0

    def new(self) -> int:
        for x, kind in ((self.step, dict), (self.loose, list), (self.empty, list)):
            x.append(kind())
        return len(self.step) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def first_words(self) -> set[bytes]:
        return {w for s in self.closed({0}) for w in self.step[s]}

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest run from words[at] on that is accepted, or -1."""
        states, end = self.closed({0}), -1
        while states:
            if self.accept in states:
                end = at
            if at == len(words):
                break
            after: set[int] = set()
            for s in states:
                after.update(self.step[s].get(words[at], ()))
                after.update(self.loose[s])
            states, at = self.closed(after), at + 1
        return end


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template. A template has to begin with a mandatory word."""
    out, depth, opened = Automaton(label), 0, []
    now = out.new()
    for part in re.findall(r"\[|\]|\{\w+:\d+-\d+\}|[^\s\[\]{}]+", template.lower()):
        if part == "[":
            opened.append(now)
            depth += 1
        elif part == "]":
            out.empty[opened.pop()].append(now)
            depth -= 1
            after = out.new()
            out.empty[now].append(after)
            now = after
        elif part[0] == "{":
            least, most = map(int, re.findall(r"\d+", part.split(":")[1]))
            end, reached = out.new(), now
            for k in range(most + 1):
                if k >= least:
                    out.empty[reached].append(end)
                if k < most:
                    after = out.new()
                    out.loose[reached].append(after)
                    reached = after
            now = end
        else:
            word, after = part.encode(), out.new()
            out.step[now].setdefault(word, []).append(after)
            if not depth:
                out.words.add(word)
            now = after
    if depth or not out.step[0]:
        raise ValueError(f"template of {label}: brackets don't close, or it doesn't begin with a word")
    out.accept = now
    return out


class Scanner:
    """Compiled base phrases and templates; made once in each task."""

    def __init__(self, base: dict[str, str] = BASE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.automata = [(True, compiled(label, phrase)) for phrase, label in base.items()] + [(False, compiled(label, x)) for label, x in templates]
        self.rare = [(sorted(a.words, key=len, reverse=True), k) for k, (_, a) in enumerate(self.automata)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[bool, str, int, int]]]:
        """Number of words, and (of the base, label, start, end) in words for every place where an automaton accepts."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        open_ = [k for need, k in self.rare if all(w in data for w in need)]
        if not open_:
            return len(bounds(np.frombuffer(data, np.uint8), _IS_WORD)[0]) if data else 0, []
        words, found = _WORD.findall(data), []
        starts: dict[bytes, list[int]] = {}
        for k in open_:
            for first in self.automata[k][1].first_words():
                starts.setdefault(first, [])
        for i, w in enumerate(words):
            if w in starts:
                starts[w].append(i)
        for k in open_:
            base, automaton = self.automata[k]
            for at in sorted({i for first in automaton.first_words() for i in starts[first]}):
                if (end := automaton.longest(words, at)) >= 0:
                    found.append((base, automaton.label, at, end))
        return len(words), found


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """docs with n_words and matches: array of (of_base, label, start, end), places in words, by start."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_words:long,matches:array<struct<of_base:boolean,label:string,start:long,end:long>>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(base, templates)
        for batch in texts:
            rows = [scanner.scan(x) for x in batch]
            matches = [[{"of_base": b, "label": x, "start": s, "end": e} for b, x, s, e in sorted(m, key=lambda y: (y[2], y[3], y[1], y[0]))] for _, m in rows]
            yield pd.DataFrame({"n_words": [n for n, _ in rows], "matches": matches}, index=batch.index)

    return docs.withColumn("__found", found("text")).withColumns({"n_words": F.col("__found.n_words"), "matches": F.col("__found.matches")}).drop("__found")


def digests(docs: DataFrame) -> DataFrame:
    """What op7_licenses returns. score: the share of the text's words that lie in a match."""
    df = scan(docs.select("doc_id", "text")).drop("text")
    base = F.filter("matches", lambda m: m["of_base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    step = lambda a, m: F.struct((a["n"] + F.greatest(m["end"] - F.greatest(m["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], m["end"]).alias("end"))
    covered = F.aggregate("matches", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda a: a["n"])
    return df.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
