"""Text of web pages. Text hidden by style stays: a reader of the page source sees it too."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X

# In this order: code and comments go, block tags break lines, other tags vanish.
STEPS = [
    (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|head|body|html|title)\b[^>]*>",
     "\n"),
    (r"<[A-Za-z/!][^>]*>", ""),
]
# What each step's match ends with. Behind the last such end nothing can match, and
# looking there would cost a scan to the end of the page for every opening.
ENDS = [r"(?is)\A.*</(script|style)\s*>", r"(?s)\A.*-->", r"(?s)\A.*>", r"(?s)\A.*>"]
# The ampersand is last, so that an escaped entity is unescaped once.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_text(html):
    pages = F.array(html)
    for (pattern, to), end in zip(STEPS, ENDS):
        halves = F.transform(pages, lambda t: F.struct(t.alias("whole"), F.regexp_extract(t, end, 0).alias("front")))
        pages = F.transform(halves, lambda h: F.concat(
            F.regexp_replace(h.front, pattern, to), F.substr(h.whole, F.length(h.front) + 1)
        ))
    text = F.get(pages, F.lit(0))
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return X.normalize_lines(text)


def extract_pages(df, html="html"):
    """Adds the whole text, its display preview and whether the preview is shortened."""
    df = X.computed_once(df, text=html_text(F.col(html)))
    return df.withColumn("preview", F.left("text", F.lit(S.PREVIEW_CHARS))).withColumn(
        "truncated", F.length("text") > S.PREVIEW_CHARS
    )
