import pytest

from verbaloom.llm import op01_license

TEXTS = [
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("redistributions of source code must retain the above copyright notice", "bsd-2-clause"),
    ("either version 3 of the license, or (at your option) any later version", "gpl-3.0-or-later"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


@pytest.mark.parametrize("gap", [" ", "\n", "\n ", "\n * ", "\n# ", "\r\n// ", "  ", "\t", "\n#\n# "])
@pytest.mark.parametrize("text, label", TEXTS)
def test_wrapped_texts(text, label, gap):
    scanner, words = op01_license.Scanner(), text.split()
    for cut in range(1, len(words)):
        wrapped = "é\n\n  so: " + " ".join(words[:cut]) + gap + " ".join(words[cut:]) + ".\n\nend"
        found = [wrapped[s:e] for s, e, x, _ in scanner.detect(wrapped) if x == label]
        assert found == [wrapped[wrapped.index(words[0], 8) : wrapped.rindex(".")]], wrapped


def test_places_of_text_without_runs_stay():
    assert op01_license.unwrapped("a b c") == ("a b c", [0], [0])
    assert [k[:3] for k in op01_license.Scanner().detect("the  mit license")] == [(5, 16, "mit")]
