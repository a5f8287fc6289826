"""Surrogates where formats are short, secrets long and names words."""

import re
import string

KEY = b"test-key"


def replaced(spark, texts, **options):
    from marksheet.llm.surrogate import pseudonymise

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pseudonymise(df, KEY, **options).orderBy("doc_id").collect()]


def test_one_letter_addresses_stay_distinct(spark):
    """676 addresses over 26 domains of one letter: more than their form has room for."""
    addresses = [f"{a}@{b}.com" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    for limit in (100_000, 0):  # moves sent to the workers, and joined
        out = replaced(spark, addresses, broadcast_limit=limit)
        assert len(set(out)) == len(addresses) and not set(out) & set(addresses)
        domains = {}
        for old, new in zip(addresses, out, strict=True):
            domains.setdefault(old.split("@")[1], set()).add(new.split("@")[1])
        assert all(len(d) == 1 for d in domains.values())  # colleagues stay colleagues
        made = {d for s in domains.values() for d in s}
        assert len(made) == 26 and not made & set(domains)


def test_crowded_numbers_get_longer(spark):
    """A format of few values: every value of a short hexadecimal address is taken."""
    from marksheet.llm.surrogate import assign

    rows = [("ip6", f"::{i:x}") for i in range(16)] + [("ssn", f"{i:03}") for i in range(1000)]
    out = assign(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()
    assert len({(r["kind"], r["surrogate"]) for r in out}) == len(rows) and not {(r["kind"], r["surrogate"]) for r in out} & set(rows)


def test_no_tail_of_a_secret_stays(spark):
    long = "".join(chr(97 + i * 7 % 26) + str(i % 10) for i in range(400))
    texts = [f"password={long}", f"token: {long}", f"key ghp_{long} end", f"-----BEGIN PRIVATE KEY-----\n{long * 60}\n-----END PRIVATE KEY-----"]
    for old, new in zip(texts, replaced(spark, texts), strict=True):
        kept = max((len(m) for m in re.findall(r"[a-z0-9]+", old) for k in range(0, len(m) - 20, 10) if m[k : k + 20] in new), default=0)
        assert kept == 0 and len(new) == len(old), old[:20]


def test_words_are_not_names(spark):
    texts = ["Dr May wrote in May that Dr May left.", "Mr Long took a Long road; Mr Winter froze in Winter.", "Mrs Novak came. Novak left.", "Version 1.2.3.4 and v10.0.0.1 but host 10.0.0.1"]
    out = replaced(spark, texts)
    assert " wrote in May that " in out[0] and "May wrote" not in out[0] and out[0].count("May") == 1
    assert "a Long road" in out[1] and "in Winter." in out[1] and "Mr Long" not in out[1]
    assert "Novak" not in out[2]
    assert out[3].startswith("Version 1.2.3.4 and v10.0.0.1 but host ") and not out[3].endswith("10.0.0.1")
