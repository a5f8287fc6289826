"""Lexical search, the n-gram join and spelling variants against SQL and brute force, and on odd input."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, n string, item_id string, word string, score string"
BASE = "one two three four five six seven eight nine ten eleven"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, BASE), (5, BASE.upper()), (5, BASE.upper()), (None, f"{BASE} twelve"), (7, "word " * 30_000), (8, "é" * 50), (9, f"{BASE}!"), (10, "two words"), (11, "two words"), (12, "lettering lettering"), (13, "letterings letterings"),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_jaccard_join"])
def test_queries_equal_sql(spark, con, name):
    from marksheet.llm.queries import ORACLES, QUERIES

    mine, theirs = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert rows_of(mine.select(*theirs.columns)) == sorted(theirs.fetchall(), key=str)


# Lexical search --------------------------------------------------------------------------------


def terms(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_ranking(docs, items, k):
    lists = [(i, Counter(terms(t))) for i, t in docs]
    used = [c for _, c in lists if c]
    n, total = len(used), sum(sum(c.values()) for c in used)
    want = defaultdict(set)
    for i, t in items:
        want[i] |= set(terms(t))
    out = []
    for item, words in want.items():
        found = []
        for i, c in lists:
            m = 50 + (50 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in o for o in used) + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, at, i, -s) for at, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_ranking_on_odd_rows_and_in_blocks(spark, odd):
    from marksheet.llm.lexical import rank_documents

    items = [(1, "TWO words, two"), (2, None), (3, ""), (4, "éé nothing"), (1, "eleven"), (None, "word x"), (5, "é" * 50), (6, "eight nine-ten\x00seven")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for k, most in ((50, 32 << 20), (2, 200), (1, 1)):
        assert rows_of(rank_documents(odd, table, k, most_bytes=most)) == brute_ranking(ODD, items, k), (k, most)
    assert rank_documents(odd.limit(0), table).count() == 0 and rank_documents(odd, table.limit(0)).count() == 0
    assert rank_documents(odd, table.where("text IS NULL")).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_go_by_id_over_all_tasks(spark):
    from marksheet.llm.lexical import rank_documents

    docs = spark.createDataFrame([(i, "same words here" if i < 998 else "others") for i in range(2500, 0, -1)], "doc_id long, text string").repartition(9)
    items = spark.createDataFrame([(1, "same")], "item_id int, text string")
    assert [(r["rank"], r["doc_id"]) for r in rank_documents(docs, items, 40).orderBy("rank").collect()] == [(i, i) for i in range(1, 41)]


# N-gram join -----------------------------------------------------------------------------------


def brute_components(docs, percent=80):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[find(a)] = find(b)
    least = defaultdict(list)
    for i, (name, _) in enumerate(docs):
        least[find(i)].append(name)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((name, len(sets[i]), smallest[find(i)]) for i, (name, _) in enumerate(docs)), key=str)


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        at = rng.randrange(len(out) + 1)
        kind = rng.random()
        out[at : at + (kind > 0.3)] = [f"new{rng.randrange(10**9)}"] if kind < 0.7 else []
    return out


def test_components_equal_brute_force(spark, odd):
    from marksheet.llm.paritysketch import jaccard_components

    assert rows_of(jaccard_components(odd)) == brute_components(ODD)
    rng = random.Random(5)
    passage = [f"common{i}" for i in range(60)]
    docs = []
    for size in (4, 5, 6, 8, 9, 12, 20, 40, 62, 67, 70, 80, 100, 130, 160, 300, 700):
        for group in range(4):
            base = [f"w{size}x{group}x{rng.randrange(10**9)}" for _ in range(size)]
            base = base + passage if group % 2 else base
            for _ in range(5):
                text = edited(rng, base, rng.randrange(1 + size // 18))
                docs.append((len(docs), " ".join(edited(rng, text, 1) if rng.random() < 0.3 else text)))
            docs.append((len(docs), " ".join(base[: len(base) * 4 // 5 + rng.randrange(3)])))
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for percent in (80, 60, 95):
        assert rows_of(jaccard_components(table, percent, elements_a_bucket=2000)) == brute_components(docs, percent), percent
    assert jaccard_components(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_components(table, 50)


def test_a_chain_in_one_crowded_block_is_followed(spark):
    """Copies that each change a few words more: neighbours link, the ends are far apart."""
    from marksheet.llm.paritysketch import jaccard_components

    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        docs.append((500 - i, " ".join(words)))
        words = list(words)
        for at in range(i * 6 % 400, i * 6 % 400 + 6):
            words[at % 400] = f"n{i}x{at}"
    docs += [(1000 + i, " ".join([f"w{j}" for j in range(60)] + [f"z{i}x{j}" for j in range(340)])) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard_components(table)) == brute_components(docs)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 100), st.integers(0, 100), st.integers(0, 2**32), st.sampled_from([60, 80, 90]))
def test_pigeonhole_finds_every_pair(common, left, right, seed, percent):
    from marksheet.llm.paritysketch import bands_of, blocks, most_apart, parity_bits

    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2**64, common + left + right, dtype=np.uint64)
    a, b = np.sort(h[: common + left]), np.sort(np.concatenate([h[:common], h[common + left :]]))
    order = lambda v: (int(v) * seed) % 1_000_003  # any order that both share
    prefix = lambda s: {int(v) for band, need in bands_of(len(s), percent) for v in sorted(blocks(s, band, percent), key=order)[:need]}
    for s in (a, b):
        assert all(len(blocks(s, band, percent)) >= need for band, need in bands_of(len(s), percent))
    if 100 * common >= percent * (common + left + right):
        assert left + right <= most_apart(len(a), len(b), percent)
        assert prefix(a) & prefix(b)
        assert sum(int(x).bit_count() for x in (parity_bits(a) ^ parity_bits(b)).view(np.uint64)) <= left + right


def test_thin_sketches_are_drawn_again(spark, monkeypatch):
    from marksheet.llm import paritysketch as P

    plain = P.shared_blocks
    seeds = []

    def first_is_thin(docs, width, percent, buckets, seed, text, **more):
        seeds.append(seed)
        out = plain(docs, width, percent, buckets, seed, text, **more)
        return out if seed else out.union(out.limit(0).union(docs.sparkSession.createDataFrame([(2, 3, 1, 5)], out.schema)))

    monkeypatch.setattr(P, "shared_blocks", first_is_thin)
    docs = [(i, f"{BASE} {' '.join(f'{i % 7}x{j}' for j in range(300))} {i}") for i in range(21)]
    assert rows_of(P.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_components(docs) and seeds == [0, 1]


# Spelling variants -----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, spoil=None, shortest=7, least=2, times=10):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if spoil and h % spoil == 0 else w] += 1
    n = {w: c for w, c in n.items() if c >= least and len(w) >= shortest}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * c else None
    out = []
    for w, c in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def test_spelling_query_equals_brute_force(spark):
    from marksheet.llm.queries import op13_spelling

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = rows_of(op13_spelling(spark, SF))
    assert found == brute_variants(docs, 31) and any(r[1] for r in found)


def test_spelling_on_odd_rows_chains_and_ties(spark, odd):
    from marksheet.llm.spelling import spelling_variants

    assert rows_of(spelling_variants(odd, delete_one_in=31)) == brute_variants(ODD, 31)
    assert rows_of(spelling_variants(odd, shortest=2)) == brute_variants(ODD, shortest=2)
    text = "chainword " * 2000 + "chainwords " * 200 + "chainwordss " * 20 + "chainwordsss " * 2 + "tiesword " * 2 + "tiesworda " * 20 + "tieswordb " * 20 + "aaaaaaaa " * 3 + "aaaaaaa " * 30 + "ÉÀÿéàÿéà ÉÀÿéàÿéà éàÿéàÿéb éàÿéàÿéb " + "x" * 40 + " " + "x" * 41
    docs = [(1, text), (1, text), (2, "x" * 41 + " " + "x" * 40)]
    for n in (None, 3):
        found = rows_of(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), delete_one_in=n))
        assert found == brute_variants(docs, n)
    assert ("chainwordsss", "chainwordss", "chainword") in {r[:3] for r in rows_of(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert spelling_variants(odd.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeéÿ", min_size=7, max_size=14), st.integers(0, 13), st.sampled_from("abcdeéÿ"), st.integers(4, 16))
def test_reduced_neighbourhood_holds_every_edit(word, at, letter, symbols):
    from marksheet.llm.spelling import neighbourhoods

    at %= len(word)
    codes = set(neighbourhoods([word], symbols)[1][0].tolist())
    for other in (word, word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word + letter):
        assert int(neighbourhoods([other], symbols)[0][0]) in codes
