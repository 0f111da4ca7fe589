"""Readable text of HTML pages, by the standard library's parser inside Arrow batches.

Scripts, styles and other elements without readable text hide what they hold; what stands in an
article or main element is preferred to the rest. A page without readable text, or one that the
parser cannot read, stands as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Elements that hide their text, and elements that hold the main text.
KIND = dict.fromkeys(("script", "style", "noscript", "template", "svg"), "hidden") | dict.fromkeys(("article", "main"), "main")
MAX_CHARS = 2_000_000


class _Tokens(HTMLParser):
    """The page as (what, value): a change of depth by a kind of element, or a piece of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int | str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in KIND:
            self.found.append((KIND[tag], 1))

    def handle_endtag(self, tag):
        if tag in KIND:
            self.found.append((KIND[tag], -1))

    def handle_data(self, data):
        if text := data.strip():
            self.found.append(("text", text))


def readable(html: str | None) -> tuple[str, str]:
    """(text, how it was found): main content, else all text, else the raw page.

    Hidden elements count first: a main element within one is none. Tags that close more than is open
    close nothing.
    """
    raw, tokens = html or "", _Tokens()
    try:
        tokens.feed(raw)
    except Exception:  # noqa: BLE001 - whatever the parser stumbles over, the page is text
        return raw, "fallback"
    depth, shown = {"hidden": 0, "main": 0}, []
    for what, value in tokens.found:
        if what == "hidden" or (what == "main" and not depth["hidden"]):
            depth[what] = max(0, depth[what] + value)
        elif what == "text" and not depth["hidden"]:
            shown.append((depth["main"] > 0, value))
    main = [text for inside, text in shown if inside]
    if not shown:
        return raw, "raw"
    return "\n".join(main or [text for _, text in shown]), "html_main" if main else "html_all"


@F.pandas_udf(StructType().add("text", StringType()).add("extractor", StringType()))
def readable_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        yield pd.DataFrame([readable(x) for x in pages], columns=["text", "extractor"])


def main_text(pages: DataFrame, html: str = "html", max_chars: int = MAX_CHARS) -> DataFrame:
    """pages with text, extractor, text_chars, text_sha256 and reason (document_too_long or null) in
    place of the markup."""
    rest = [c for c in pages.columns if c != html]
    got = pages.select(*rest, readable_text(html).alias("_r"))
    chars = F.length("_r.text")
    return got.select(
        *rest, F.col("_r.text").alias("text"), F.col("_r.extractor").alias("extractor"), chars.alias("text_chars"),
        F.sha2(F.col("_r.text").cast("binary"), 256).alias("text_sha256"), F.when(chars > max_chars, "document_too_long").alias("reason"),
    )
