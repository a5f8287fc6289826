"""Editor documents (nested JSON of any depth) to text, inside the JVM.

A document is parsed to a variant and taken apart level by level in its own row: a list of open nodes,
each with its path of child numbers, is replaced by the list of their children, while every text and
line end is kept with its path. Sorting the pieces by path puts them in the order of the document. No
row leaves its partition, and depth is limited by the document alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import trim

# Nodes that end a line.
_BREAKS = ("paragraph", "listItem", "heading", "hardBreak")
_NODES, _PIECES = "array<struct<path:array<int>,node:variant>>", "array<struct<path:array<int>,text:string>>"
#: A node's own text comes before its children, which are numbered from 0, and its line end after them.
_OWN, _END = -1, 2**31 - 1


def _has_type(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _children(node: Column, path: Column) -> Column:
    content = F.try_variant_get(node, "$.content", "array<variant>")
    return F.coalesce(F.transform(content, lambda c, i: F.struct(F.concat(path, F.array(i)).alias("path"), c.alias("node"))), F.array().cast(_NODES))


def _pieces(node: Column, path: Column) -> Column:
    kind = F.try_variant_get(node, "$.type", "string")
    text = F.try_variant_get(node, "$.text", "variant")
    known = F.when(text.isNull(), "").when(_has_type(text, "STRING"), text.cast("string")).otherwise(F.raise_error(F.lit("the text of a node is no string")))
    own = F.struct(F.concat(path, F.array(F.lit(_OWN))).alias("path"), F.when(kind == "text", known).otherwise("").alias("text"))
    end = F.struct(F.concat(path, F.array(F.lit(_END))).alias("path"), F.when(kind.isin(*_BREAKS), "\n").otherwise("").alias("text"))
    return F.filter(F.array(own, end), lambda x: x["text"] != "")


def text_of(root: Column, levels: Column) -> Column:
    """The text under a variant node: text nodes in order, a newline after each line-ending node, stripped.

    ``levels``: at least the depth. Anything that is no object has no text.
    """
    start = F.struct(F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("node"))).alias("nodes"), F.array().cast(_PIECES).alias("pieces"))

    def step(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["nodes"], lambda x: _children(x["node"], x["path"])))
        pieces = F.flatten(F.transform(state["nodes"], lambda x: _pieces(x["node"], x["path"])))
        return F.when(F.size(state["nodes"]) == 0, state).otherwise(F.struct(below.alias("nodes"), F.concat(state["pieces"], pieces).alias("pieces")))

    pieces = F.aggregate(F.sequence(F.lit(1), levels), start, step)["pieces"]
    return trim(F.concat_ws("", F.transform(F.array_sort(pieces), lambda p: p["text"])))


def _levels(document: Column) -> Column:
    """No list of children is without a bracket, so brackets bound the depth."""
    return F.length(document) - F.length(F.replace(document, F.lit("["), F.lit(""))) + 1


def _given(document: Column) -> Column:
    return F.coalesce(document, F.lit("")) != ""


def rich_text_column_job(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: the text of the editor document in ``column``. Null and empty give ''; what is no JSON,
    repeats a key or has a text that is no string is an error."""
    d = F.col(column)
    return df.withColumn(out, F.when(_given(d), text_of(F.parse_json(d), _levels(d))).otherwise(""))


def _accuracy(example: Column) -> Column:
    a = F.try_variant_get(example, "$.accuracy", "variant")
    said = F.when(_has_type(a, "BOOLEAN"), F.initcap(a.cast("string"))).when(_has_type(a, "DECIMAL") | _has_type(a, "DOUBLE"), F.try_variant_get(a, "$", "double").cast("string")).otherwise(F.try_variant_get(a, "$", "string"))
    return F.when(a.isNull(), "N/A").when(F.is_variant_null(a), "None").otherwise(said)


def rich_question_column_job(df: DataFrame, column: str) -> DataFrame:
    """question, rubric and examples of a question document: {content, rubric, examples: [{content, accuracy}]}.

    Examples are numbered and say their accuracy. Missing parts, null and empty documents give ''; a
    document or example that is no object is an error.
    """
    d = F.col(column)
    v = F.parse_json(d)
    levels = _levels(d)
    text = lambda node, path: text_of(F.try_variant_get(node, path, "variant"), levels)
    an_object = lambda x, name: F.when(_has_type(x, "OBJECT"), x).otherwise(F.raise_error(F.lit(f"{name} is no object")).cast("variant"))
    root = F.when(_given(d), an_object(v, "the document"))
    examples = F.coalesce(F.variant_get(F.col("_root"), "$.examples", "array<variant>"), F.array().cast("array<variant>"))
    lines = F.transform(examples, lambda e, i: F.concat(F.lit("Ex "), (i + 1).cast("string"), F.lit(" (Acc: "), _accuracy(an_object(e, "an example")), F.lit("): "), text(e, "$.content")))
    out = df.withColumn("_root", root)
    return out.select(*df.columns, text(F.col("_root"), "$.content").alias("question"), text(F.col("_root"), "$.rubric").alias("rubric"), F.array_join(lines, "\n---\n").alias("examples"))
