import random
import re

import duckdb
import pyarrow as pa
import pytest

from cohortweave.llm import license_scan as ls
from cohortweave.llm.sql import LICENSE_SQL

BSD = [ls.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]


def found(frame, texts):
    rows = ls.scan(frame("licenses long, doc_id long, text string", [(0, i, t) for i, t in enumerate(texts)])).collect()
    return [(r.sentences, r.licenses) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_rules_in_order(frame):
    texts = [
        None,
        "",
        "prose. Released under the MIT License.\nMore prose.",
        "LICENSED   under the apache license,\n version 2.0!",
        ". ".join(BSD) + ".",
        ". ".join(BSD[:3]) + ". Other words. ",
        ". ".join([BSD[1], BSD[0]]) + ".",
        "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License.",
        "This sentence on a license is unknown.",
        "x " * 50_000 + ". Released under the MIT License",
    ]
    got = found(frame, texts)
    assert [g[1] for g in got] == [
        [], [], ["MIT"], ["Apache-2.0"], ["BSD-3-Clause"], ["BSD-2-Clause"], [], ["CC-BY-NC-4.0", "MIT"], [], ["MIT"],
    ]
    assert got[6][0] == ["bsd-source", "bsd-grant"]


def test_every_rule_is_recognised_from_its_own_text(frame):
    texts = [". ".join(ls.SENTENCES[s] for s in rule.sentences) + "." for rule in ls.RULES]
    for rule, (_, names) in zip(ls.RULES, found(frame, texts)):
        assert names == [rule.license]


def test_sentences_have_anchors(monkeypatch):
    assert len(ls.known_sentences()) > 30
    monkeypatch.setitem(ls.SENTENCES, "odd", "no such word")
    with pytest.raises(ValueError, match="anchor"):
        ls.known_sentences()


def test_repeated_rows_null_ids_and_empty_table(frame):
    docs = frame("doc_id long, text string", [(None, "Released under the MIT License.")] * 2)
    assert [r.licenses for r in ls.scan(docs).collect()] == [["MIT"]] * 2
    assert ls.scan(docs.limit(0)).count() == 0


COPYRIGHT = "Copyright (c) 2020, Jo Doe <jo@example.org>"
MIT = f"""MIT License

{COPYRIGHT}

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_3 = f"""BSD 3-Clause License

{COPYRIGHT}
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
GPL_3 = f"""{COPYRIGHT}

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL_2 = GPL_3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
APACHE = f"""{COPYRIGHT}
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
WHOLE = [(MIT, "MIT"), (BSD_3, "BSD-3-Clause"), (GPL_3, "GPL-3.0"), (GPL_2, "GPL-2.0"), (APACHE, "Apache-2.0")]


def test_whole_texts_as_they_are_distributed(frame):
    layouts = [
        lambda t: t,
        lambda t: t.replace("\n", "\r\n"),
        lambda t: t.replace("\n\n", "\n"),
        lambda t: "".join(f"# {line}\n" for line in t.split("\n")) + "import os\n",
        lambda t: "/*\n" + "".join(f" * {line}\n" for line in t.split("\n")) + " */\n",
        lambda t: t.replace("1. ", "(a) ").replace("2. Red", "b) Red").replace("3. ", "* "),
        lambda t: re.sub(r"(\S{4}) (\S)", r"\1\n\2", t),
        lambda t: "Some prose on software\n" + t + "Released as it is",
    ]
    texts = [lay(text) for text, _ in WHOLE for lay in layouts]
    wanted = [[name] for _, name in WHOLE for _ in layouts]
    got = found(frame, texts)
    assert [g[1] for g in got] == wanted
    assert got[0][0] == ["mit-grant", "mit-grant-2", "as-is"]


def test_lines_and_wrapped_sentences_in_one_text(frame):
    text = "Licensed under the ISC License\nNotes follow\n\n" + MIT + "Released into the public\ndomain under CC0 1.0"
    assert found(frame, [text, "public\ndomain. Released into the public\ndomain under CC0 1.0"]) == [
        (["isc-name", "mit-grant", "mit-grant-2", "as-is", "cc0-name"], ["CC0-1.0", "ISC", "MIT"]), (["cc0-name"], ["CC0-1.0"]),
    ]


NOTICES = [
    (BSD_3, MIT, BSD_3.split("3. Neither")[0]),
    (BSD_3.split("3. Neither")[0], MIT, BSD_3),
    (BSD_3.replace("2. Red", "Licensed under the Apache License, Version 2.0\n\n2. Red"), GPL_3),
    (APACHE, APACHE, MIT, BSD_3, BSD_3, GPL_2),
]


def test_notices_of_several_licences(frame):
    got = found(frame, ["\n".join(parts) for parts in NOTICES])
    assert [g[1] for g in got] == [
        ["BSD-2-Clause", "BSD-3-Clause", "MIT"],
        ["BSD-2-Clause", "BSD-3-Clause", "MIT"],
        ["Apache-2.0", "BSD-3-Clause", "GPL-3.0"],
        ["Apache-2.0", "BSD-3-Clause", "GPL-2.0", "MIT"],
    ]


def by_removal(sentences):
    """Rules from long to short, each taking its own sentences out until it fits no more."""
    left, names = list(sentences), set()
    for rule in sorted(ls.RULES, key=lambda r: -len(r.sentences)):
        while True:
            places, start = [], 0
            for s in rule.sentences:
                if s not in left[start:]:
                    break
                places.append(left.index(s, start))
                start = places[-1] + 1
            if len(places) < len(rule.sentences):
                break
            names.add(rule.license)
            for place in reversed(places):
                del left[place]
    return sorted(names)


def test_mixed_sentences_against_removal_one_by_one_and_sql(frame):
    rng = random.Random(4)
    shared = sorted({s for whole, rules in ls.chains() if len(whole) > 1 for s in whole})
    texts = []
    for _ in range(300):
        some = rng.sample(shared, rng.randint(1, 6)) + rng.sample(sorted(ls.SENTENCES), 1)
        texts.append(". ".join(ls.SENTENCES[rng.choice(some)] for _ in range(rng.randint(0, 16))) + ".")
    got = found(frame, texts)
    assert [names for _, names in got] == [by_removal(sentences) for sentences, _ in got]
    assert len({tuple(names) for _, names in got}) > 30
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    with duckdb.connect() as con:
        con.register("documents", table)
        rows = con.execute(f"SELECT licenses FROM ({LICENSE_SQL}) ORDER BY doc_id").fetchall()
    assert [r[0] for r in rows] == [",".join(names) for _, names in got]


def test_rules_must_form_chains():
    rules = [ls.LicenseRule("a", ("x", "y")), ls.LicenseRule("b", ("y", "x"))]
    with pytest.raises(ValueError, match="doesn't begin"):
        ls.chains(rules)
    with pytest.raises(ValueError, match="repeats"):
        ls.chains([ls.LicenseRule("a", ("x", "x"))])


def test_thousands_of_licences_in_one_text(frame):
    text = ". ".join(BSD[:3] * 3000) + ". " + ". ".join(BSD) + "."
    assert found(frame, [text])[0][1] == ["BSD-2-Clause", "BSD-3-Clause"]
