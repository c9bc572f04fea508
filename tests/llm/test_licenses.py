import random
import re

from tremorlake.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    hits = [(i, label) for p, label in licenses.BASE_PHRASES.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    None,
    "",
    "CC BY cc-by CC.BY ccby",
    "the MIT License, MIT License. gnu general public license apache license",
    "É apache\nLICENSE ünï cc by cc by",
    "K Apache License K",
    "0 mit 0 license",
    "cc cc by by " * 2000,
    "x" * 100_000,
    "so the apache license É " * 3000 + "end",
]


def test_base_places_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_expressions():
    assert licenses.to_postfix("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and", "or"]
    assert licenses.to_postfix("(MIT OR GPL-2.0) AND BSD-3-Clause") == ["MIT", "GPL-2.0", "or", "BSD-3-Clause", "and"]
    for bad in ("", "AND MIT", "MIT OR", "(MIT", "MIT)", "()", "WITH"):
        assert licenses.to_postfix(bad) is None
    assert licenses.evaluate(licenses.to_postfix("MIT OR GPL-3.0")) == ({"mit", "gpl"}, True)
    assert licenses.evaluate(licenses.to_postfix("MIT AND GPL-3.0")) == ({"mit", "gpl"}, False)
    assert licenses.evaluate(licenses.to_postfix("GPL-2.0 WITH GCC-exception-3.1")) == ({"gpl"}, False)


def test_tags_and_notices():
    r = licenses.scanner()("// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode\n# spdx-license-identifier: GPL-3.0-only\nAll rights reserved.")
    assert r["labels"] == "all-rights-reserved,apache,gpl,mit" and r["base_labels"] == "" and r["permissive"] is False
    assert r["expressions"] == ["MIT Apache-2.0 or", "GPL-3.0-only"]


def test_expressions_in_prose():
    f = licenses.scanner()
    for text, labels, found in [
        ("SPDX-License-Identifier: MIT and see the LICENSE file", "mit", ["MIT"]),
        ("SPDX-License-Identifier: MIT OR", "mit", ["MIT"]),
        ("/* SPDX-License-Identifier: (MIT OR BSD-3-Clause */", "bsd,mit", ["MIT BSD-3-Clause or"]),
        ("License: MIT or Apache-2.0.", "apache,mit", ["MIT Apache-2.0 or"]),
        ("license : see the file", "", []),
        ("SPDX-License-Identifier: Zlib\nMIT", "zlib", ["Zlib"]),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 with thanks", "gpl", ["GPL-2.0 Classpath-exception-2.0 with"]),
        ("SPDX License Identifier MIT", "", []),
        ("SPDX-License-Identifier: AND MIT", "", []),
        ("é SPDX-License-Identifier: (MIT) AND (ISC OR (MPL-2.0", "isc,mit,mpl", ["MIT ISC MPL-2.0 or and"]),
    ]:
        r = f(text)
        assert (r["labels"], r["expressions"]) == (labels, found), text


def test_identifiers_match_whole():
    f = licenses.scanner()
    for text, labels, free in [
        ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by,cc-by-nc", False),
        ("SPDX-License-Identifier: CC-BY-ND-4.0 OR CC-BY-NC-SA-4.0", "cc-by,cc-by-nc-sa,cc-by-nd", False),
        ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa", False),
        ("SPDX-License-Identifier: CC-BY-3.0-DE", "cc-by", True),
        ("License: Mitigation plan", "", None),
        ("license: mitral valve", "", None),
        ("license: apachean people", "", None),
        ("License: BSD-3-Clause-No-Nuclear-License", "bsd-3-clause-no-nuclear-license", None),
        ("# SPDX-License-Identifier: GPL-2.0+ OR\n# MIT", "gpl,mit", True),
        ("SPDX-License-Identifier: (GPL-3.0-only\n * AND\n * ISC)\nMIT", "gpl,isc", False),
        ("License: MIT or\nsomething else", "mit", True),
        ("License: MIT or well-known", "mit", True),
        ('{"name": "x", "license": "MIT"}', "mit", True),
        ("license = 'MIT OR Apache-2.0'", "apache,mit", True),
        ('SPDX-License-Identifier = "LGPLv3+"', "lgpl", False),
        ("License: BUSL-1.1", "busl", False),
        ("license: Zlib", "zlib", True),
    ]:
        r = f(text)
        assert r["labels"] == labels and (r["permissive"] == free or free is None and not r["permissive"]), (text, r)


def plain_notices(text):
    """Labels of the longest notice at each word, by slices."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    found = set()
    for i in range(len(words)):
        here = [p for p in licenses.NOTICE_PHRASES if words[i : i + p.count(" ") + 1] == p.split()]
        found |= {licenses.NOTICE_PHRASES[max(here, key=len)]} if here else set()
    return found - {""}


def test_notices_against_a_plain_scanner():
    r = random.Random(2)
    f = licenses.scanner()
    pieces = [*licenses.NOTICE_PHRASES, *licenses.BASE_PHRASES, "cc", "by", "the", "creative commons", "Noncommercial", "zlib"]
    for _ in range(300):
        text = r.choice([" ", "-", ", "]).join(r.choice(pieces) for _ in range(r.randrange(12)))
        base = brute(text)[4]
        assert f(text)["labels"] == ",".join(sorted(plain_notices(text) | set(filter(None, base.split(","))))), text


def test_time_is_linear_in_hits():
    import time

    f, took = licenses.scanner(), []
    text = "SPDX-License-Identifier: MIT OR ISC, the apache license and so on; "
    for n in (20_000, 80_000):  # 1.3 and 5.3 MB
        start = time.process_time()
        r = f(text * n)
        took.append(time.process_time() - start)
        assert r["n_base"] == n and r["last_word"] == r["n_words"] - 5 and len(r["expressions"]) == n
    assert took[1] < 10 * took[0]
