"""Text of uploaded files. One row in, one row out; failures give less text and a note.

Hidden text (white, tiny, off the page) is kept on purpose: a model reads it too.
A note means that something was not read: such a document is never clean.
"""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X
from parapet.functions.pdf_reader import read_pdf


def extract_documents(df, name="name", content="content"):
    """Adds text and note to rows of file name and bytes."""
    is_pdf = X.extension(F.col(name)) == ".pdf"
    df = df.withColumn("__pdf", F.when(is_pdf, F.col(content)))
    df = extract_pdf(df, "__pdf", "__pdf_text", "__pdf_note")
    read = F.when(is_pdf, F.col("__pdf_text")).otherwise(X.decode_utf8(F.col(content)))
    df = X.computed_once(df, __text=read)
    text = X.strip(F.coalesce("__text", F.when(is_pdf, F.lit(None)).otherwise("")))
    note = F.when(is_pdf, F.col("__pdf_note")).when(F.col("__text").isNull(), "Text files must be UTF-8")
    done = df.withColumn("text", text).withColumn("note", note).drop("__pdf", "__text", "__pdf_text", "__pdf_note")
    return X.computed_once(done, "text", "note")


def extract_pdf(df, content, text="text", note="note", max_chars=S.PDF_MAX_CHARS):
    """Adds the text of PDF bytes and, where anything is not read or is cut, a note on what."""
    keep = df.columns
    df = X.computed_once(df.withColumn("__read", read_pdf(F.col(content))), "__read")
    df = X.computed_once(df, __whole=X.normalize_column("__read.text"))
    too_long = F.when(F.length("__whole") > max_chars, f"the text is longer than {max_chars:,} characters and was cut")
    notes = F.nullif(F.concat_ws("; ", "__read.problem", too_long), F.lit(""))
    return df.select(*keep, F.left("__whole", F.lit(max_chars)).alias(text), notes.alias(note))


def document_verdict(verdict, text, note):
    """A document's verdict: blocked stays; one with nothing read, or anything unread, is incomplete."""
    unread = note.isNotNull() | F.coalesce(text == "", F.lit(True))
    return F.when(verdict == S.BLOCKED, verdict).when(unread, S.INCOMPLETE).otherwise(verdict)
