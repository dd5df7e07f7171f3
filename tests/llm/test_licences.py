import random

import pytest

from scour.llm import licences, queries

from tests.llm.conftest import FOLDER, ODD


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def test_alignment_is_common_and_rising():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        pairs = licences.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
        unique = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
        if len(unique) == len(a) == len(b):
            assert len(pairs) == longest_common(a, b)


def test_longest_rising():
    rng = random.Random(1)
    for _ in range(200):
        v = rng.sample(range(20), rng.randrange(9))
        kept = [v[i] for i in licences.rising(v)]
        assert kept == sorted(kept) and len(kept) == longest_common(v, sorted(v))


@pytest.mark.parametrize("name", sorted(licences.TEMPLATES))
def test_finds_edited_notices_anywhere(name):
    rng = random.Random(name)
    scanner = licences.Scanner(licences.TEMPLATES, 0.8, 1.5)
    notice = licences.TEMPLATES[name].split()
    if len(notice) > 12:
        notice = [w for i, w in enumerate(notice) if i % 12 != 5]
        notice[7:7] = ["extra", "words"]
    noise = lambda n: " ".join(rng.choice(["the", "of", "lorem", "ipsum", "license", "and", "copy"]) for _ in range(n))
    text = f"{noise(300)}. {' '.join(notice)} {noise(400)} é {' '.join(notice)}\n{noise(50)}"
    found = [f for f in scanner.findings(text) if f[0] == name]
    assert len(found) == 2 and all(f[1] >= 0.8 for f in found)
    for f, at in zip(found, (text.index(notice[0]), text.rindex(" ".join(notice)))):
        assert abs(f[2] - at) < 60 and len(" ".join(notice)) - 60 < f[3] - f[2] < len(" ".join(notice)) + 60


def test_query(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op8_licence_scan"](spark, FOLDER).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        said = [n for n in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice") if licences.TEMPLATES[n] in t]
        assert set(said) <= {s.split(":")[0] for s in rows[i].spans.split(",")}
        if rows[i].n_findings:
            assert said, t[:300]


def test_odd_rows(odd):
    df, name = licences.scan_licences(odd)
    assert df.count() == len(ODD) and all(r[name] == [] for r in df.collect())
    assert licences.scan_licences(odd.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        licences.scan_licences(odd, {"empty": "!"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0-notice"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0-notice"]), ("Released under the BSD License.", ["BSD-notice"]),
        ("Licensed under the MIT License.", ["MIT-notice"]), ("Licensed under the Frob License, Version 2.0.", []),
        (licences.TEMPLATES["GPL-3.0-header"].replace("3", "2"), ["GPL-2.0-header"]), (licences.TEMPLATES["GPL-3.0-header"].replace("General", "Lesser General").replace("program", "library"), ["LGPL-3.0-header"]),
        (licences.TEMPLATES["GPL-3.0-notice"].replace("General", "Lesser General"), ["LGPL-3.0-notice"]), (licences.TEMPLATES["GPL-3.0-notice"].replace("version 3", "v3.0"), ["GPL-3.0-notice"]),
    ],
)
def test_kin_are_told_apart(text, want):
    found = licences.Scanner(licences.TEMPLATES, 0.8, 1.5).findings(f"Some words before. {text} And some words after that.")
    assert [f[0] for f in found] == want


def test_whole_licences_and_later_parts():
    scanner = licences.Scanner(licences.TEMPLATES, 0.8, 1.5)
    for name, text in licences._texts().items():
        found = scanner.findings(text)
        assert any(f[0] == name and f[1] > 0.97 for f in found) and max(found, key=lambda f: f[3] - f[2])[0] == name, (name, found)
    for name in ("GPL-2.0", "LGPL-2.1", "MPL-2.0", "Apache-2.0", "MIT"):
        text = licences.TEMPLATES[name]
        later = [f for f in scanner.findings("words before " + text[len(text) // 2 :]) if f[0] == name]
        assert len(later) == 1 and 0.3 < later[0][1] < 0.6, (name, later)
