"""No operator leaves out part of its input: ids that are null or repeat, several licences in one text."""

import random


def _prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_null_and_repeated_ids_lose_no_text(spark):
    from marksheet.llm.bagminhash import drop_near_duplicates
    from marksheet.llm.exacthash import drop_exact_duplicates

    a, b, c, d, e, f = map(_prose, range(6))
    # Null ids over different texts, id 7 over two texts, a copy (id 3) that shares its id with a document that stays.
    rows = [(None, a), (None, b), (None, b.upper()), (7, c), (7, d), (3, e), (9, e), (3, f), (None, "  "), (8, "\t")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    want = sorted((str(i), t.lower()) for i, t in [(None, a), (None, b), (7, c), (7, d), (9, e), (3, f), (None, "  "), (8, "\t")])
    for drop in (drop_exact_duplicates, drop_near_duplicates):
        kept = drop(docs)
        assert kept.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["text"].lower()) for r in kept.collect()) == want
        docs = docs if drop is drop_exact_duplicates else kept
    both = drop_near_duplicates(drop_exact_duplicates(docs))
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in both.collect()) == want
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_every_wording_of_a_block_is_found(spark):
    from marksheet.llm.licences import TEMPLATES, scan_block, scan_licenses

    names = lambda text: [TEMPLATES[w[0]][0] for w in scan_block(text)]
    dual = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert names(dual) == ["MIT", "Apache-2.0"] and names(dual.replace("\n", " ")) == ["MIT", "Apache-2.0"]
    for nth, (name, wording) in enumerate(TEMPLATES):
        # Some wordings are said alike by two templates ("MIT License").
        assert [TEMPLATES[w[0]][0] for w in scan_block(wording)] == [name] and scan_block(wording)[0][2:] == (0, []), nth
        for seed in range(3):
            prose = f"{_prose(seed, 900)} {wording} {_prose(seed + 9, 900)}"
            assert names(prose) == [name], (name, seed)
            other, other_wording = TEMPLATES[(nth + 7) % len(TEMPLATES)]
            assert names(f"{prose} {other_wording} {_prose(seed + 5, 5)}") == [name, other]
    crowd = " ".join(f"{_prose(n, 2 + n % 40)} {w}" for n, (_, w) in enumerate(TEMPLATES * 3))
    assert names(crowd) == [name for name, _ in TEMPLATES * 3]
    for name, wording in TEMPLATES:  # hard-wrapped, as in a comment
        wrapped = "\n".join("# " + " ".join(wording.split()[i : i + 9]) for i in range(0, len(wording.split()), 9))
        assert names(f"# Copyright 2020 Someone\n{wrapped}\nimport os\n") == [name]
    assert names("SPDX-License-Identifier: MIT\nint main() {}") == ["MIT"] and names("The MIT License (MIT)") == ["MIT"]
    assert names("word " * 200_000 + dual) == ["MIT", "Apache-2.0"]
    assert names("Licensed under the Apache Licence (English: License), Version 2.0.") == ["Apache-2.0"]
    wrapped = TEMPLATES[2][1].replace(", ", ",\n")
    rows = [(1, dual), (2, "no words on it\nthe licence fee\nwas raised"), (3, wrapped), (4, "x " * 200_000)]
    out = sorted((r["doc_id"], r["block_start"], r["license"] or "", r["exact"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, 0, "Apache-2.0", True), (1, 0, "MIT", True), (2, 15, "", False), (3, 0, "MIT", True)]


def test_other_licences_are_not_taken_for_ours():
    from marksheet.llm.licences import TEMPLATES, _scan

    names = lambda text: [w[6] for w in _scan(text, TEMPLATES)[0]]
    assert names("Licensed under the EUPL v1.2") == [] or "MIT" not in names("Licensed under the EUPL v1.2")
    assert names("Licensed under the European Union Public Licence, version 1.2") == ["EUPL-1.2"]
    assert names("Distributed under the Boost Software License, Version 1.0.") == ["BSL-1.0"]
    assert names("Released under the Foo License.") == [] and names("Licensed under the Foobar License, Version 2.0.") == []
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0-only"]
    for said, want in {
        "License: MIT": ["MIT"], "MIT License": ["MIT"], "Licensed under MIT": ["MIT"], "BSD license": ["BSD"], "Mozilla Public License Version 2.0": ["MPL-2.0"], "SPDX-License-Identifier: EUPL-1.2": ["EUPL-1.2"],
        "Dual licensed under the MIT or GPL": ["MIT", "GPL"], "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["MIT", "Apache-2.0"], "License: Apache-2.0 and BSD-3-Clause": ["Apache-2.0", "BSD-3-Clause"],
    }.items():
        assert names(said) == want and names(f"some words before\n{said}\nand after it") == want, said
    for prose in ("The licence fee was raised, and mit der Zeit the license expired.", "A license to fish is issued by the county, version 2 of the form applies.", "Permission to use the hall is granted by the apache museum.", "He lost his driving license in 2019."):
        assert names(prose) == [], prose


def test_licences_on_odd_rows(spark):
    from marksheet.llm.licences import scan_licenses

    line = "Released under the MIT License."
    rows = [(1, line, "mine"), (1, line, "mine"), (None, line, "x"), (2, None, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = [(r["doc_id"], r["license"]) for r in scan_licenses(df).collect()]
    assert sorted(got, key=str) == [(1, "MIT"), (1, "MIT"), (None, "MIT")] and scan_licenses(df.limit(0)).count() == 0
