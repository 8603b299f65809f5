"""Signatures, expressions of identifiers, and suppression against brute force."""

import random
import re
import time

import pytest

from shelfspark.llm import licenses, signatures

#: What a written signature says, where its expression leaves a choice.
EXAMPLES = [
    ("This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.", {"gpl-2.0-or-later"}),
    ("under the terms of the GNU General Public License version 2, as\n# published by the Free Software Foundation", {"gpl-2.0-only"}),
    ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"agpl-3.0-or-later"}),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"lgpl-2.1-or-later"}),
    ('Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.', {"apache-2.0"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0. If a copy", {"mpl-2.0"}),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY', {"mit"}),
    ("Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products", {"bsd-3-clause"}),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", {"bsd-4-clause"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided", {"isc"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided", {"0bsd"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", {"epl-1.0"}),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", {"mit", "apache-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0", "classpath-exception-2.0"}),
    ("SPDX-License-Identifier: BSD-3-Clause AND (ISC OR MPL-2.0)\nMIT", {"bsd-3-clause", "isc", "mpl-2.0"}),
]


@pytest.mark.parametrize(("text", "labels"), EXAMPLES)
def test_signatures(text, labels):
    assert {label for _, _, label, _ in licenses.detect(text.lower())} == labels


def said(expression):
    """A text that a written signature matches, its optional parts left out and the first of alternatives taken; else nothing."""
    s = re.sub(r"\(\?!.*?\)", "", expression)
    while True:
        t = re.sub(r"\(\?:((?:[^()|\\]|\\.)*)(?:\|(?:[^()\\]|\\.)*)?\)(\?)?", lambda m: "" if m[2] else m[1], s)
        if t == s:
            break
        s = t
    s = re.sub(r"\[[^\]]*\]\{\d+,\d+\}|\[[^\]]*\]\*", "", s)
    s = re.sub(r"\[(\\?.)[^\]]*\](?:\{\d+\})?", lambda m: m[1], s)
    s = re.sub(r"\\\(", "\x01", s)
    s = re.sub(r"\\\)", "\x02", s)
    s = re.sub(r"(\\?.)\?", "", s)
    return s.replace("~", '"').replace("\\.", ".").replace("\\*", "*").replace("\\s*", "").replace("\\s+", " ").replace("\x01", "(").replace("\x02", ")")


def test_every_signature_may_be_wrapped():
    """Line breaks, comment marks and indents between any two words."""
    tried = 0
    for rules in (signatures.NOTICES, signatures.TEXTS):
        for label, _, expression in rules:
            text = said(expression)
            own = [i for i, r in enumerate(licenses.rules()) if r[0] == label]
            if not any(licenses.rules()[i][3].search(text) for i in own):
                continue
            tried += 1
            for gap in ("\n", "  ", "\n * ", "\n# ", "\r\n\t// "):
                wrapped = text.replace(" ", gap)
                run = set(licenses.gated(wrapped)) & set(own)
                assert any(licenses.rules()[i][3].search(wrapped) for i in run), (label, wrapped)
    assert tried >= 0.9 * (len(signatures.NOTICES) + len(signatures.TEXTS))


def test_signatures_are_written_out():
    assert len(signatures.NOTICES) + len(signatures.TEXTS) >= 180 and len({e for _, _, e in signatures.NOTICES + signatures.TEXTS}) == len(signatures.NOTICES + signatures.TEXTS)


def test_suppression_against_brute_force():
    rng = random.Random(4)
    for _ in range(2000):
        found = []
        for i in range(rng.randrange(0, 14)):
            a = rng.randrange(0, 12)
            found.append((a, a + rng.randrange(1, 12), f"l{i}", rng.randrange(1, 6), i))

        def within(f, k):
            same = (f[0], f[1], f[3]) == (k[0], k[1], k[3])
            return k[0] <= f[0] and k[1] >= f[1] and k[3] >= f[3] and (not same or k[4] < f[4])

        want = {f for f in found if not any(k != f and within(f, k) for k in found)}
        assert set(licenses.suppressed(found)) == want


def test_a_long_detection_far_back_suppresses():
    found = [(0, 1000, "long", 4, 0)] + [(10 + 20 * i, 200 + 20 * i, f"s{i}", 2, i + 1) for i in range(40)]
    assert [f[2] for f in licenses.suppressed(found)] == ["long"]


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the MIT License", "x", 5)], "doc_id bigint, text string, labels string, score int")
    out = licenses.find(df)
    assert sorted(out.columns) == sorted({*df.columns, "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"}) and out.first().labels == ["mit"]
    assert licenses.find(df.where("false")).count() == 0


def labels(text):
    return {label for _, _, label, _ in licenses.detect(text.lower())}


def test_expressions_of_any_length():
    many = [*signatures.IDENTIFIERS] * (500 // len(signatures.IDENTIFIERS) + 1)
    text = "SPDX-License-Identifier: " + " OR ".join(f"({x}" if i % 3 == 0 else x for i, x in enumerate(many)) + " AND MPL-2.0"
    assert labels(text) >= {"mpl-2.0"} and len(labels(text)) > 0.9 * len(set(signatures.IDENTIFIERS))
    spans = [(s, e) for s, e, label, _ in licenses.detect(text.lower()) if label == "mpl-2.0"]
    assert spans[-1] == (len(text) - 7, len(text))
    assert labels("SPDX-License-Identifier: MIT\nOR Apache-2.0") == {"mit"}  # an expression ends with its line
    assert labels("spdx-license-identifier: mit-or-gpl-2.0") <= {"mit"}


@pytest.mark.parametrize("n", [10, 200, 3000])
def test_holders_of_any_length(n):
    name = "Example Holder of Rights, " * (n // 26 + 1)
    assert labels(f"Neither the name of {name} nor the names of its contributors may be used to endorse or promote products") == {"bsd-3-clause"}
    assert "ftl" in labels(f"Portions of this software are copyright {name} The FreeType Project")
    assert "proprietary" in labels(f"Unauthorized copying {'of this file, ' * n} is strictly prohibited")


@pytest.mark.parametrize("text", ["SPDX-License-Identifier: " * 30_000, "spdx-license-identifier: " + "mit or " * 100_000, "spdx-license-identifier: " + "a" * 700_000, "neither the name of " * 30_000 + "endorse", "unauthorized copying " * 30_000 + " " * 100_000, "may not be reproduced, stored " * 20_000 + "without " * 20_000])
def test_linear(text):
    began = time.process_time()
    licenses.scan(text.encode())
    assert time.process_time() - began < 10
