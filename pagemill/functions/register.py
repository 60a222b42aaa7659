"""The page functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..html import classify as K
from ..html import extract as X
from ..html import metadata as M
from ..html import sanitize as S
from ..html.tree import parse


def register(spark: SparkSession) -> None:
    """``page_text_length(html)``, ``page_content(html, url)``, ``page_title(html)``,
    ``clean_html(html)``, ``page_type(html, url)``; null html gives null."""

    def column(name, of, kind, arity=1):
        if arity == 1:

            @F.pandas_udf(kind)
            def f(html: pd.Series) -> pd.Series:
                return html.map(lambda h: None if h is None else of(h, None))

        else:

            @F.pandas_udf(kind)
            def f(html: pd.Series, url: pd.Series) -> pd.Series:
                return pd.Series([None if h is None else of(h, u) for h, u in zip(html, url)])

        spark.udf.register(name, f.asNondeterministic())

    def extracted(html, url):
        doc = parse(html)
        kind, confidence = K.classify(doc, url)
        return X.rescue(html, X.extract_tree(doc, X.Options(page_type=kind), confidence))

    column("page_text_length", lambda h, u: extracted(h, u).text_length, "long")
    column("page_content", lambda h, u: extracted(h, u).content_html, "string", 2)
    column("page_title", lambda h, u: M.metadata(parse(h)).get("title"), "string")
    column("clean_html", lambda h, u: S.clean_html(h), "string")
    column("page_type", lambda h, u: K.classify(parse(h), u)[0], "string", 2)
