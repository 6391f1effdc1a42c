"""Real headers, wrapped and in comments; negations; the gate; suppression against brute force."""

import random
import time

import pytest

from verbaloom.llm import op01_license as o

HEADERS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}


def wrapped(text, width, prefix):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join(prefix + x for x in [*lines, line])


@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// ", "; ", "\t"])
@pytest.mark.parametrize("width", [30, 61, 72])
def test_headers(prefix, width):
    scanner = o.Scanner()
    for label, text in HEADERS.items():
        assert label in {k[2] for k in scanner.detect(wrapped(text, width, prefix).lower())}, (label, prefix, width)


def test_hand_written_rules():
    assert len(o.NAMES) + len(o.PASSAGES) >= 200


def test_every_rule_passes_its_gates():
    """A text made of a plain rule finds its label: keyword and stem occur in what the regex matches."""
    scanner, plain = o.Scanner(), 0
    for label, keyword, rx in o.NAMES + o.PASSAGES:
        text = rx.replace("\\.", ".").replace("licen[sc]e", "license")
        if any(c in text for c in "({[?|*+\\"):
            continue
        plain += 1
        assert label in {k[2] for k in scanner.detect(text)}, (label, keyword)
    assert plain > 60


def test_some_rules():
    scanner = o.Scanner()
    for text, label in [
        ("alle rechte vorbehalten", "all-rights-reserved"), ("for personal use only", "non-commercial"), ("the origin of this software must not be misrepresented", "zlib"),
        ("cc0", "cc0-1.0"), ("creative commons attribution-sharealike", "cc-by-sa-4.0"), ("under the same terms as perl itself", "perl"), ("may not be copied without prior written permission", "proprietary"),
        ("https://www.w3.org/consortium/legal", "w3c"), ("free art license", "lal-1.3"), ("unauthorised copying of this file is strictly prohibited", "proprietary"),
    ]:
        assert label in {k[2] for k in scanner.detect(text)}, text


def test_negations_are_no_grants():
    for text in ("this is not released under the mit license", "it was never licensed under the mit license", "isn't available under the mit license"):
        assert [k[2:] for k in o.Scanner().detect(text)] == [("mit", 5)], text
    assert [k[2:] for k in o.Scanner().detect("it is released under the mit license")] == [("mit", 3)]


def test_suppression_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        found = sorted((rng.randint(1, 5), s := rng.randint(0, 60), -(s + rng.randint(1, 30)), k) for k in range(rng.randint(0, 40)))
        kept, cover, got = [], o.Cover([f[1] for f in found]), []
        for _, s, e, k in found:
            if not any(a <= s and -e <= b for a, b in kept):
                kept.append((s, -e))
            if cover.end(s) < -e:
                cover.add(s, -e)
                got.append((s, -e))
        assert got == kept


def test_many_detections_take_linear_time():
    began = time.perf_counter()
    assert len(o.Scanner().detect("mit license. " * 80_000)) == 80_000  # 1 MB
    assert time.perf_counter() - began < 20
