"""Cutting spans of code points out of texts, shared by the operators that remove lines or passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_key(text: str = "text") -> F.Column:
    """Tells rows with the same doc_id and different texts apart."""
    return F.xxhash64(text)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans (doc_id, text_key, start, end) cut out of text and n_chars, if there is such a column, set anew.

    Spans are taken as code points, end exclusive, and may touch or overlap.  Documents without spans
    pass unchanged; a document that loses all its text keeps its row with an empty one.
    """
    cuts = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("_cuts.start").alias("_from"), F.col("_cuts.end").alias("_to"))
    begin, end = cuts["_from"], cuts["_to"]

    @F.pandas_udf("string")
    def cut(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        def one(t, a, b):
            parts, at = [], 0
            for x, y in zip(a, b, strict=True):
                parts.append(t[at : max(at, x)])
                at = max(at, y)
            return "".join([*parts, t[at:]])

        return pd.Series([t if t is None or a is None else one(t, a, b) for t, a, b in zip(text, start, end, strict=True)])

    met = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["_doc"]) & (text_key(docs["text"]) == cuts["_key"]), "left")
    text = F.when(begin.isNull(), docs["text"]).otherwise(cut(docs["text"], begin, end))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(begin.isNull(), docs["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return met.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])
