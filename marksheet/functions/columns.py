"""Column functions: cleaning, mapping, text and grades. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The grade scale and its text labels.
GRADES = (0.0, 0.25, 0.5, 0.75, 1.0)
GRADE_LABELS = {"incorrect": 0.0, "mostly incorrect": 0.25, "partially correct": 0.5, "mostly correct": 0.75, "correct": 1.0}

# Stop words by which a question's language is voted on.
EN_STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself "
    "no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
DE_STOP_WORDS = (
    "aber als am an auch auf aus bei beim bin bis da das dass daten de dem den der des die dies diese dieser dieses du ein eine einem einen einer er es für haben hat "
    "ich im in ist ja man mit nein nicht oder sich sie sind und von was weil wenn wer wie wird wo zu zum zur"
).split()


def trim(c: Column) -> Column:
    """Unicode-aware strip, as for text rather than for padded fields."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_key(c: Column) -> Column:
    """Null to '', then stripped."""
    return trim(F.coalesce(c.cast("string"), F.lit("")))


def to_numeric(c: Column) -> Column:
    """Numbers as doubles; what is not a number becomes null."""
    return c.try_cast("double")


def mapped(c: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """A CASE over a small fixed table."""
    items = list(table.items())
    out = reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), items[1:], F.when(c == items[0][0], F.lit(items[0][1])))
    return out.otherwise(default) if default is not None else out


def grade_label_to_number(c: Column, strict: bool = True) -> Column:
    """Text label to 0..1. An unknown label is an error (``strict``) or null."""
    found = mapped(F.lower(trim(c)), GRADE_LABELS)
    if not strict:
        return found
    return F.when(c.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("unknown grade label: "), c)).cast("double")).otherwise(found)


def grade_number_to_label(c: Column) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[1], kv[0]), list(GRADE_LABELS.items())[1:], F.when(c == 0.0, "incorrect"))


def is_llm_to_binary(c: Column) -> Column:
    """Yes/No to '1'/'0'; null stays, anything else is an error."""
    low = F.lower(trim(c))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(low == "yes", "1").when(low == "no", "0").otherwise(F.raise_error(F.concat(F.lit("not Yes or No: "), c)).cast("string"))


def yes_no_unknown(c: Column) -> Column:
    low = F.lower(trim(c))
    return F.when(low.isin("yes", "y", "true", "1"), "Yes").when(low.isin("no", "n", "false", "0"), "No").otherwise("Unknown")


def clamp_grade(c: Column) -> Column:
    """Clipped to [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def snap_to_grade(c: Column) -> Column:
    """The nearest of the five grades; a tie goes down."""
    return F.ceil(clamp_grade(c) * 4 - 0.5).cast("double") / 4


def safe_name_token(c: Column) -> Column:
    return F.translate(c, r'/\:*?"<>| ', "__________")


def model_short_name(c: Column) -> Column:
    """Column name without its model prefix."""
    return F.translate(F.regexp_replace(c, "^(new_grade_|grade_|pred_)", ""), "/", "_")


def model_family(c: Column) -> Column:
    return F.when(c.startswith("new_grade_"), "LLM").when(c.startswith("grade_bert") | c.startswith("grade_mdeberta"), "Transformer").when(c.startswith("grade_prior"), "Prior").when(c.startswith("pred_tfidf"), "TF-IDF").otherwise("Other")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), 0)


def token_count_whitespace(c: Column) -> Column:
    """Runs of visible characters; 0 for null and blank text."""
    return F.size(words(c)).cast("long")


def normalize_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")


def qa_concat(q: Column, a: Column) -> Column:
    return F.concat(F.lit("question: "), normalize_text(q), F.lit(" answer: "), normalize_text(a))


def tokenize_alnum(c: Column) -> Column:
    """Lower-case runs of letters a-z, digits and umlauts."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-zA-Z0-9äöüÄÖÜ]+"), 0)


def overlap_ratio(q: Column, a: Column) -> Column:
    """Share of the question's distinct tokens that the answer has; 0 without question tokens."""
    mine = F.array_distinct(tokenize_alnum(q))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, tokenize_alnum(a))).cast("double"), F.size(mine).cast("double")), F.lit(0.0))


def overlap_template(q: Column, a: Column) -> Column:
    """Seven fixed rules on answer length and overlap with the question."""
    text = trim(F.coalesce(a, F.lit("")))
    n, share = F.char_length(text), overlap_ratio(q, a)
    return (
        F.when(n == 0, 0.0).when(n < 8, 0.25)
        .when((share < 0.05) & (n < 25), 0.25)
        .when(share < 0.10, F.when(n < 50, 0.25).otherwise(0.5))
        .when(share < 0.25, F.when(n < 40, 0.5).otherwise(0.75))
        .when(share < 0.45, F.when(n < 30, 0.5).otherwise(0.75))
        .otherwise(F.when(n < 20, 0.75).otherwise(1.0))
    )


def detect_language(c: Column) -> Column:
    """Stop-word votes; an umlaut or sharp s gives two more to German; a tie is unknown."""
    low = F.lower(F.coalesce(c, F.lit("")))
    tokens = F.regexp_extract_all(low, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ']+"), 0)
    votes = lambda stop: F.size(F.filter(tokens, lambda t: t.isin(stop)))
    de = votes(DE_STOP_WORDS) + F.when(low.rlike("[äöüß]"), 2).otherwise(0)
    en = votes(EN_STOP_WORDS)
    return F.when(F.size(tokens) == 0, "unknown").when(de > en, "de").when(en > de, "en").otherwise("unknown")


def grade_from_model_output(c: Column, field: str = "grade") -> Column:
    """Strict JSON, then JSON without code fences, then the first grade in the text, else -1."""
    bare = F.regexp_replace(c, "```(json)?", "")
    number = F.regexp_extract(c, r"(?:^|[^0-9.])(0\.25|0\.5|0\.75|0\.0|1\.0|0|1)(?:[^0-9.]|\.?$|\.[^0-9])", 1)
    tries = [F.get_json_object(c, f"$.{field}"), F.get_json_object(bare, f"$.{field}"), F.nullif(number, F.lit(""))]
    return F.coalesce(*(t.try_cast("double") for t in tries), F.lit(-1.0))


def consensus_grade(a: Column, b: Column) -> Column:
    """Mean of two grades at most 0.5 apart, snapped to the scale; an exact midpoint goes towards 0.5.

    The published example that gives 1.00 for 1.00 and 0.75 conflicts with that rule; the rule is
    kept (0.75).
    """
    mean = (a + b) / 2
    quarters = mean * 4
    low = F.floor(quarters)
    snapped = F.when(quarters - low == 0.5, F.when(mean > 0.5, low).otherwise(low + 1)).otherwise(F.rint(quarters))
    return F.when(F.abs(a - b) <= 0.5, snapped.cast("double") / 4)


def audit_status(a: Column, b: Column) -> Column:
    bad = a.isNull() | b.isNull() | ~a.isin(*GRADES) | ~b.isin(*GRADES)
    return F.when(bad, "invalid_grade_input").when(F.abs(a - b) > 0.5, "distance_gt_0.5").otherwise("within_threshold")


def llm_flag_and(a: Column, b: Column) -> Column:
    return F.when((F.lower(trim(a)) == "yes") & (F.lower(trim(b)) == "yes"), "Yes").otherwise("No")


def linear_grade_code(grade: Column, step: float = 0.5) -> Column:
    return F.rint((grade - 1.0) / step).cast("int")
