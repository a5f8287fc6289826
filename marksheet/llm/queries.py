"""The registered query of each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _tokenizer_file(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), *_tokenizer_file("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


#: The production key is a secret of the deployment; this one is for the registered query.
SURROGATE_KEY = b"registered-query-key"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogate import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_50k.json")[0])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bagminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exacthash import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paritysketch import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), delete_one_in=31)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_langid, op3_surrogates, op4_warc, op5_quality_rules, op6_packing, op7_near_duplicates, op8_exact_dedup, op9_licenses, op10_hmm, op11_lexical_search, op12_jaccard_join, op13_spelling)
}

# Normalised text of op8 and what goes with it.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op11_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
        it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
        g AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY r, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, nn),
        s AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * nn) // ll)))) AS score
            FROM it JOIN tf USING (term) JOIN w USING (term) JOIN d USING (r), g GROUP BY item_id, r)
        SELECT item_id, CAST(n AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score
        FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s JOIN d USING (r) WHERE score > 0) WHERE n <= 50""",
    "op12_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY a.r, b.r),
        l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d e ON e.r = reach.b GROUP BY d.r, d.doc_id""",
    "op8_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op5_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
        dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+4]) AS n FROM win),
        rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM dup WHERE n > 1) GROUP BY doc_id),
        f AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
                len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
                len(list_filter(w, lambda x: list_contains([STOP], x))) AS n_stop
            FROM d LEFT JOIN rep USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND CAST(VERDICT AS BOOLEAN) AS kept
        FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
            coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_bullet / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(n_ellipsis / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
            coalesce(n_stop / nullif(n_words, 0), 0) AS stop_ratio FROM f)""".replace("\\\\", "\\"),
}


def _with_rules(sql: str) -> str:
    from .rules import STOP_WORDS, THRESHOLDS

    stop = sorted({v for words in STOP_WORDS.values() for w in words for v in (w, w.capitalize())})
    bounds = []
    for r in THRESHOLDS:
        both = [f"{r.feature} >= {r.low}"] * (r.low is not None) + [f"{r.feature} <= {r.high}"] * (r.high is not None)
        bounds.append(f"({' AND '.join(both)}{f' OR n_words < {r.least}' if r.least else ''})")
    return sql.replace("STOP", ", ".join(f"'{w}'" for w in stop)).replace("VERDICT", " AND ".join(bounds).join("()"))


ORACLES["op5_quality_rules"] = _with_rules(ORACLES["op5_quality_rules"])
