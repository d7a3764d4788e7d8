"""Licences recognised from their sentences.

1. Sentences are normalised (lower case, words and numbers only) and mapped to identifiers
   of known licence sentences; all others drop out.
   A sentence surely ends with ``.!?`` and a space.  It may end at a line's end or ``;``, or go
   on: of all readings the longest known sentence counts, from left to right.  So titles, copyright
   lines, list marks and lines ending in ``:`` stick to no sentence, however a text is wrapped.
2. The remaining sequence of identifiers is matched against licence rules.  A rule is a sequence
   of identifiers that must follow each other, others may stand between.  A rule takes its own
   sentences only, never those between them, and is matched again until it fits no more.  Rules
   that share sentences form a chain, each the beginning of the next; longer ones take first, so
   a licence isn't reported as the shorter one that it contains.

   A chain is read in one pass with a counter per place: a sentence is counted at its place
   if the place before has been counted more often.  As every sentence goes to the oldest copy
   that waits for it, the last counter is the most copies of the whole that the text holds, and
   a shorter rule holds what its counter has beyond the next longer rule's.

All in built-in functions, within the row: no shuffle, no group.  Only texts with an anchor word
are split; every known sentence contains one, so none is missed.

Cases: a null or empty text has no sentence and no licence; repeated rows and equal ids are
scanned row by row; null ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.common import pick, settled

#: Words of which every known sentence contains one.
ANCHORS = (
    "license", "licence", "licensed", "copyright", "permission", "redistribution", "redistributions",
    "redistribute", "warranty", "warranties", "public domain", "the mpl", "software", "covenant",
)

#: Known licence sentences, as they are commonly written.
SENTENCES = {
    "mit-name": "Released under the MIT License",
    "mit-name-2": "This project is licensed under the MIT License",
    "mit-name-3": "Licensed under the MIT License",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-grant-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-name": "Licensed under the ISC License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-3-name": "Licensed under the BSD 3-Clause License",
    "bsd-2-name": "Licensed under the BSD 2-Clause License",
    "apache-2-name": "Licensed under the Apache License, Version 2.0",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-2-copy": "You may obtain a copy of the License at",
    "apache-2-use": "you may not use this file except in compliance with the License",
    "apache-2-spdx": "SPDX-License-Identifier: Apache-2.0",
    "apache-2-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-2-body": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "apache-2-warranty": "Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-3-body": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "gpl-3-freedom": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "gpl-2-freedom": "The licenses for most software are designed to take away your freedom to share and change it",
    "gpl-2-free": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    "gpl-3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3-name-2": "Licensed under the GNU General Public License v3.0",
    "gpl-3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-name": "Licensed under the GNU General Public License, version 2",
    "gpl-2-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "gpl-2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "free-software": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-3-name": "Licensed under the GNU Lesser General Public License, version 3",
    "lgpl-3-body": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "agpl-3-body": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "agpl-3-name": "Licensed under the GNU Affero General Public License, version 3",
    "mpl-2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-2-body": "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License",
    "mpl-2-warranty": "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing",
    "mpl-2-name": "Licensed under the Mozilla Public License, version 2.0",
    "cc-by-name": "Licensed under CC BY 4.0",
    "cc-by-name-2": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-name": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-name-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-name": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-name-2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-name": "Licensed under CC BY-ND 4.0",
    "cc0-name": "Released into the public domain under CC0 1.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "Copyright, all rights reserved",
}


@dataclass(frozen=True)
class LicenseRule:
    """A licence and the sentences that show it, in their order."""

    license: str
    sentences: tuple[str, ...]


#: Rules that share sentences are beginnings of one another.
RULES = (
    LicenseRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    LicenseRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    LicenseRule("BSD-3-Clause", ("bsd-3-name",)),
    LicenseRule("BSD-2-Clause", ("bsd-2-name",)),
    LicenseRule("MIT", ("mit-grant", "mit-grant-2", "as-is")),
    LicenseRule("MIT", ("mit-grant", "mit-grant-2")),
    LicenseRule("MIT", ("mit-name",)),
    LicenseRule("MIT", ("mit-name-2",)),
    LicenseRule("MIT", ("mit-name-3",)),
    LicenseRule("MIT", ("mit-spdx",)),
    LicenseRule("ISC", ("isc-grant",)),
    LicenseRule("ISC", ("isc-name",)),
    LicenseRule("Apache-2.0", ("apache-2-notice", "apache-2-use", "apache-2-copy", "apache-2-unless")),
    LicenseRule("Apache-2.0", ("apache-2-notice", "apache-2-use", "apache-2-copy")),
    LicenseRule("Apache-2.0", ("apache-2-notice",)),
    LicenseRule("Apache-2.0", ("apache-2-body", "apache-2-warranty")),
    LicenseRule("Apache-2.0", ("apache-2-name",)),
    LicenseRule("Apache-2.0", ("apache-2-spdx",)),
    LicenseRule("GPL-3.0", ("gpl-3-body", "gpl-3-freedom")),
    LicenseRule("GPL-3.0", ("free-software",)),
    LicenseRule("GPL-3.0", ("gpl-3-terms",)),
    LicenseRule("GPL-3.0", ("gpl-3-name",)),
    LicenseRule("GPL-3.0", ("gpl-3-name-2",)),
    LicenseRule("GPL-3.0", ("gpl-3-spdx",)),
    LicenseRule("GPL-2.0", ("gpl-2-freedom", "gpl-2-free")),
    LicenseRule("GPL-2.0", ("gpl-2-terms",)),
    LicenseRule("GPL-2.0", ("gpl-2-name",)),
    LicenseRule("GPL-2.0", ("gpl-2-spdx",)),
    LicenseRule("LGPL-3.0", ("lgpl-3-body",)),
    LicenseRule("LGPL-3.0", ("lgpl-3-name",)),
    LicenseRule("AGPL-3.0", ("agpl-3-body",)),
    LicenseRule("AGPL-3.0", ("agpl-3-name",)),
    LicenseRule("MPL-2.0", ("mpl-2-form", "mpl-2-copy")),
    LicenseRule("MPL-2.0", ("mpl-2-form",)),
    LicenseRule("MPL-2.0", ("mpl-2-body", "mpl-2-warranty")),
    LicenseRule("MPL-2.0", ("mpl-2-name",)),
    LicenseRule("CC-BY-4.0", ("cc-by-name",)),
    LicenseRule("CC-BY-4.0", ("cc-by-name-2",)),
    LicenseRule("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    LicenseRule("CC-BY-SA-4.0", ("cc-by-sa-name-2",)),
    LicenseRule("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    LicenseRule("CC-BY-NC-4.0", ("cc-by-nc-name-2",)),
    LicenseRule("CC-BY-ND-4.0", ("cc-by-nd-name",)),
    LicenseRule("CC0-1.0", ("cc0-name",)),
    LicenseRule("Unlicense", ("unlicense",)),
)

ANCHOR = "(?i)" + "|".join(ANCHORS).replace(" ", "[^a-z0-9]+")
SENTENCE_END = r"([.!?;])\s+"
NOT_WORD = "[^a-z0-9.+]+"
OUTER_DOTS = "(^[. ]+|[. ]+$)"


#: What is replaced in turn in a text in lower case.  It holds no capitals, so ``E`` can stand for the end of a
#: sentence and ``L`` for a place where one may end.  No pattern begins within a run that it could have begun before.
MARKS = (
    (r"[.!?]\s+", "E"),
    (r"\n|;\s", "L"),
    (r"(^|[EL])[^a-z0-9.+EL]*(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})\)", "$1"),
    (r"[^a-z0-9.+EL]+", " "),
    (r"(?<![. EL])[. L]*E[. EL]*", "E"),
    (r"(?<![. L])[. ]*L[. L]*", "L"),
    (r"^[. EL]+|(?<![. EL])[. EL]+$", ""),
)


def normal(sentence: str) -> str:
    """A sentence in its normal form, as the columns below make it."""
    return re.sub(OUTER_DOTS, "", re.sub(NOT_WORD, " ", sentence.lower()))


def known_sentences() -> list[tuple[str, str]]:
    """(normal form, identifier) of the known sentences, each a sentence to the columns below too."""
    known = {}
    for identifier, sentence in SENTENCES.items():
        if not re.search(ANCHOR, sentence):
            raise ValueError(f"sentence {identifier} has no anchor word")
        if re.search(SENTENCE_END, sentence):
            raise ValueError(f"sentence {identifier} would be cut")
        known[normal(sentence)] = identifier
    return sorted(known.items())


def chains(rules: Sequence[LicenseRule] = RULES) -> list[tuple[tuple[str, ...], list[LicenseRule]]]:
    """(sentences, rules from the longest to the shortest) of the rules that share sentences."""
    found: list[tuple[tuple[str, ...], list[LicenseRule]]] = []
    for rule in sorted(rules, key=lambda r: -len(r.sentences)):
        if not rule.sentences or len(set(rule.sentences)) < len(rule.sentences):
            raise ValueError(f"rule of {rule.license} is empty or repeats a sentence")
        for whole, members in found:
            if whole[: len(rule.sentences)] == rule.sentences:
                members.append(rule)
                break
            if set(whole) & set(rule.sentences):
                raise ValueError(f"rule of {rule.license} shares sentences of a rule that it doesn't begin")
        else:
            found.append((rule.sentences, [rule]))
    return found


def _matches(sentences: Column, whole: Sequence[str], rules: Sequence[LicenseRule]) -> Column:
    """Licences of a chain's rules that a sequence of identifiers holds."""

    def step(counts: Column, sentence: Column) -> Column:
        counted = []
        for i, known in enumerate(whole):
            waits = sentence == known
            if i:
                waits &= counts[f"c{i - 1}"] > counts[f"c{i}"]
            counted.append((counts[f"c{i}"] + waits.cast("int")).alias(f"c{i}"))
        return F.struct(*counted)

    def held(counts: Column) -> Column:
        names, longer = [], F.lit(0)
        for rule in rules:
            count = counts[f"c{len(rule.sentences) - 1}"]
            names.append(F.when(count > longer, rule.license))
            longer = count
        return F.array_compact(F.array(*names))

    if len(whole) == 1:
        return F.when(F.array_contains(sentences, whole[0]), F.array(F.lit(rules[0].license))).otherwise(
            F.array().cast("array<string>")
        )
    start = F.struct(*[F.lit(0).alias(f"c{i}") for i in range(len(whole))])
    return F.aggregate(sentences, start, step, held)


def sentence_pattern() -> str:
    """Pattern of the known sentences in a marked text, longer ones first."""
    longest = sorted((s for s, _ in known_sentences()), key=lambda s: (-len(s), s))
    return "(?<![^EL])(?:" + "|".join(re.escape(s).replace(r"\ ", "[ L]") for s in longest) + ")(?![^EL])"


def _sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in their order."""
    marked = F.lower(text)
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    known = F.create_map(*[F.lit(x) for pair in known_sentences() for x in pair])
    sentences = F.regexp_extract_all(marked, F.lit(sentence_pattern()), F.lit(0))
    return F.transform(sentences, lambda s: F.element_at(known, F.translate(s, "L", " ")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, ``sentences`` (identifiers in order) and ``licenses`` of all documents (doc_id, text)."""
    rows = pick(docs, "doc_id", "text")
    none = F.array().cast("array<string>")
    sentences = F.coalesce(F.when(F.col("text").rlike(ANCHOR), _sentence_ids(F.col("text"))), none)
    found = rows.select("doc_id", settled(sentences=sentences))
    matched = F.array_sort(
        F.array_distinct(F.concat(*[_matches(F.col("sentences"), whole, rules) for whole, rules in chains()]))
    )
    return found.select("doc_id", "sentences", F.when(F.size("sentences") > 0, matched).otherwise(none).alias("licenses"))
