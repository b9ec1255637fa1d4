"""License scans: template markup compiled to token automata.

A template is lower-case words with two marks: `[[ ... ]]` may be left out, `{{n}}`
stands for up to n words of any kind. It compiles to a nondeterministic automaton
over word tokens that accepts a run of words if the mandatory wording is there
exactly. Runs may begin at any word; texts without a template's longest stretch of
mandatory words are passed over.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_clear, read, shared_dir, spare

#: (words, label): plain phrases whose places are all counted.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_MIT = """
permission is hereby granted free of charge to any person obtaining a copy of {{4}} and associated documentation files
[[the software]] to deal in the software without restriction including without limitation the rights to use copy modify
merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice
[[including the next paragraph]] shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software
"""
_BSD_CONDITIONS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions
and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution
"""
_BSD_NAMES = """
[[3]] neither the name of {{10}} nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission
"""
_BSD_DISCLAIMER = """
this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for
any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the
use of this software even if advised of the possibility of such damage
"""
_ISC = """
permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
and {{6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and
fitness in no event shall {{6}} be liable for any special direct indirect or consequential damages or any damages
whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
action arising out of or in connection with the use or performance of this software
"""

_APACHE_HEADER = """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express
or implied see the license for the specific language governing permissions and limitations under the license
"""
#: The header of the GNU licences, with the name and the version of one.
_GNU_HEADER = """
is free software you can redistribute it and or modify it under the terms of the gnu %s public license as published by the
free software foundation either version %s [[of the license]] or [[at your option]] any later version
"""
_MPL_HEADER = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
with this file you can obtain one at
"""
_UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
commercial and by any means
"""
_ZLIB = """
this software is provided as is without any express or implied warranty in no event will the {{3}} be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications and to alter it and redistribute it freely subject to the following restrictions
"""
_CC0 = """
to the extent possible under law {{12}} waived all copyright and related or neighboring rights to
"""

#: (label, template): notices that name a licence, and whole texts and headers of licences that are told by their wording.
TEMPLATES = [
    ("gpl-3", "licensed under the [[terms of the]] gnu general public license [[version]] 3"),
    ("gpl-3", "under the terms of the gnu general public license {{12}} version 3"),
    ("gpl-3", "licensed under [[the]] [[gnu]] gplv3"),
    ("gpl-3", _GNU_HEADER % ("general", "3")),
    ("gpl-2", "licensed under the [[terms of the]] gnu general public license [[version]] 2"),
    ("gpl-2", "under the terms of the gnu general public license {{12}} version 2"),
    ("gpl-2", "licensed under [[the]] [[gnu]] gplv2"),
    ("gpl-2", _GNU_HEADER % ("general", "2")),
    ("lgpl-3", "licensed under the [[terms of the]] gnu lesser general public license [[version]] 3"),
    ("lgpl-3", "under the terms of the gnu lesser general public license {{12}} version 3"),
    ("lgpl-3", _GNU_HEADER % ("lesser general", "3")),
    ("lgpl-2-1", "licensed under the [[terms of the]] gnu lesser general public license [[version]] 2 1"),
    ("lgpl-2-1", "under the terms of the gnu lesser general public license {{12}} version 2 1"),
    ("lgpl-2-1", _GNU_HEADER % ("lesser general", "2 1")),
    ("agpl-3", "under the [[terms of the]] gnu affero general public license {{12}} [[version]] 3"),
    ("agpl-3", _GNU_HEADER % ("affero general", "3")),
    ("cc-by-nc", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[{{2}} license]]"),
    ("cc-by-nc", "creative commons attribution {{1}} noncommercial [[{{2}} international]] [[public]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] [[creative commons]] cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike [[4 0]] [[3 0]] [[international]] [[unported]] [[public]] license"),
    ("cc-by", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0"),
    ("cc-by", "creative commons attribution [[4 0]] [[3 0]] [[international]] [[unported]] [[public]] license"),
    ("cc0", "licensed under [[the]] [[creative commons]] cc0"),
    ("cc0", "cc0 1 0 universal"),
    ("cc0", _CC0),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("apache-2", _APACHE_HEADER),
    ("mit", "released under the [[terms of the]] mit license"),
    ("mpl-2", "subject to the terms of the mozilla public license [[v]] [[version]] 2 0"),
    ("mpl-2", _MPL_HEADER),
    ("epl-2", "under the terms of the eclipse public license [[v]] [[version]] 2 0"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("unlicense", _UNLICENSE),
    ("zlib", _ZLIB),
    ("mit", _MIT),
    ("bsd-2", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("isc", _ISC),
]
#: Templates of so many mandatory words are the wording of a licence or its header; shorter ones only name it.
WORDING = 24
#: A run after one of these words, next to it or with one word between, says the opposite.
NEGATIONS = ("no", "not", "never")


def parse(template: str) -> list:
    """Nested list of words, ("any", n) and ("maybe", list)."""
    root: list = []
    stack = [root]
    for mark in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if mark == "[[":
            inner: list = []
            stack[-1].append(("maybe", inner))
            stack.append(inner)
        elif mark == "]]":
            stack.pop()
        else:
            stack[-1].append(("any", int(mark[2:-2])) if mark[0] == "{" else mark)
    if len(stack) != 1:
        raise ValueError(f"unbalanced template: {template}")
    return root


def compile_template(template: str) -> tuple[list[dict[str, int]], list[set[int]], list[bool], int]:
    """(word edges, free edges, whether any word leads on to the next state, accepting state)."""
    words: list[dict[str, int]] = [{}]
    free: list[set[int]] = [set()]
    wild: list[bool] = [False]

    def state() -> int:
        words.append({}), free.append(set()), wild.append(False)
        return len(words) - 1

    def build(parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, str):
                words[at][part] = at = state()
            elif part[0] == "any":
                begin = at
                for _ in range(part[1]):
                    wild[at] = True
                    at = state()
                for s in range(begin, at) if at > begin else ():
                    free[s].add(at)
            else:
                entry = at
                at = build(part[1], at)
                after = state()
                free[at].add(after), free[entry].add(after)
                at = after
        return at

    entry = state()  # nothing leads back to the start
    free[0].add(entry)
    end = build(parse(template), entry)
    return words, free, wild, end


def longest_stretch(template: str) -> str:
    """The longest run of mandatory words, as " word word "."""
    runs, run = [], []
    for part in [*parse(template), ("any", 0)]:
        if isinstance(part, str):
            run.append(part)
        else:
            runs.append(run)
            run = []
    return " " + " ".join(max(runs, key=lambda r: len(" ".join(r)))) + " "


def worth(template: str) -> float:
    """The score of a text that a template accepts: 1 for a licence's wording, 0.8 for a notice that names one."""
    return 1.0 if sum(isinstance(part, str) for part in parse(template)) >= WORDING else 0.8


def accepts(automaton: tuple, tokens: list, start: int) -> int:
    """End of the longest accepted run of `tokens` from `start`, or -1."""
    words, free, wild, end = automaton

    def closed(states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    now, best, at = closed({0}), -1, start
    while now and at < len(tokens):
        token = tokens[at]
        step = {words[s][token] for s in now if token in words[s]} | {s + 1 for s in now if wild[s]}
        now, at = closed(step), at + 1
        if end in now:
            best = at
    return best


def first_words(automaton: tuple) -> set[str]:
    words, free, _, _ = automaton
    seen, todo = {0}, [0]
    while todo:
        for s in free[todo.pop()] - seen:
            seen.add(s)
            todo.append(s)
    return {w for s in seen for w in words[s]}


def scan_licenses(docs: DataFrame, *, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of the phrases, overlapping ones too; first_word and
    last_word are their smallest and largest start (null without any). labels adds the
    labels of accepted templates to those of the phrases; runs that are negated ("not
    licensed under ...") are not accepted. score: 1 if the wording of a licence is there,
    0.8 for a notice, 0.5 for phrases alone, else 0. Null texts count as empty; whole texts are
    read, in time proportional to their length; repeated rows stay, each with its own
    result; an empty table gives no rows. Input columns of these names get `_in`.
    """
    docs = keep_clear(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    compiled = [(label, worth(t), longest_stretch(t).encode(), compile_template(t)) for label, t in templates]
    machines = [(label, score, stretch, ([{w.encode(): s for w, s in edges.items()} for edges in m[0]], *m[1:]), {w.encode() for w in first_words(m)}) for label, score, stretch, m in compiled]
    negations = {w.encode() for w in NEGATIONS}
    wanted = [(f" {phrase} ".encode(), label) for phrase, label in phrases]
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    @F.arrow_udf(kind)
    def scan(texts: pa.Array) -> pa.Array:
        find = re.compile(rb"[0-9a-z\x80-\xff]+").findall
        out = []
        for text in texts.cast(pa.binary()).to_pylist():
            tokens = find((text or b"").lower())
            joined = b" " + b" ".join(tokens) + b" "
            places, base, more = [], set(), set()
            for phrase, label in wanted:
                at, seen, word = joined.find(phrase), 0, 0
                while at >= 0:
                    seen, word = at, word + joined.count(b" ", seen, at)
                    places.append(word)
                    base.add(label)
                    at = joined.find(phrase, at + 1)
            best = 0.5 if base else 0.0
            for label, score, stretch, machine, starts in machines:
                if (label not in more or score > best) and stretch in joined and any(accepts(machine, tokens, i) > 0 for i, w in enumerate(tokens) if w in starts and negations.isdisjoint(tokens[max(i - 2, 0) : i])):
                    more.add(label)
                    best = max(best, score)
            out.append({
                "n_words": len(tokens), "n_base": len(places),
                "first_word": min(places, default=None), "last_word": max(places, default=None),
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)),
                "score": best,
            })
        kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
        return pa.array(out, pa.struct(kinds))

    found = spare(docs, "_scan")
    return docs.withColumn(found, scan(F.col("text"))).select(*docs.columns, f"{found}.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text")


def template_regex(template: str) -> str:
    """The template as a regular expression over words that are each followed by a blank."""
    def of(parts: list) -> str:
        return "".join(p + " " if isinstance(p, str) else f"(?:[^ ]+ ){{0,{p[1]}}}" if p[0] == "any" else f"(?:{of(p[1])})?" for p in parts)
    return " " + of(parse(template))


def _sql() -> str:
    labels = sorted({label for label, _ in TEMPLATES} | {label for _, label in PHRASES})
    base = {p: label for p, label in PHRASES}
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {p.count(' ')} + 1)) AS i FROM d WHERE contains(j, ' {p} ')) "
        f"WHERE w[i:i + {p.count(' ')}] = ['{"', '".join(p.split())}']" for p, label in base.items())
    flags = ", ".join(f"(contains(j, '{longest_stretch(t)}') AND regexp_matches(k, '{template_regex(t)}')) AS t{i}" for i, (_, t) in enumerate(TEMPLATES))
    by = {label: " OR ".join(f"t{i}" for i, (x, _) in enumerate(TEMPLATES) if x == label) or "false" for label in labels}
    named = ", ".join(f"CASE WHEN {by[label]} OR list_contains(coalesce(ls, []), '{label}') THEN '{label}' END" for label in labels)
    whole, any_ = (" OR ".join(f"t{i}" for i, (_, t) in enumerate(TEMPLATES) if worth(t) >= least) for least in (1, 0))
    starts = "|".join(sorted({w for _, t in TEMPLATES for w in first_words(compile_template(t))}))
    denied = f" (?:{'|'.join(NEGATIONS)}) (?:[^ ]+ )?(?:{starts}) "
    return rf"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM t),
d AS (SELECT *, regexp_replace(j, '{denied}', ' - ', 'g') AS k FROM s),
p AS ({places}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS ls FROM p GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, b.* EXCLUDE (doc_id), {flags} FROM d LEFT JOIN b ON d.doc_id = b.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(ls, ','), '') AS base_labels, array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), ',') AS labels,
  CASE WHEN {whole} THEN 1.0 WHEN {any_} THEN 0.8 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM m
"""


SQL = _sql()
