"""Structure of pages given as lines: captions, headings, footnotes, references, page labels, sections.

All tests are Column expressions over a line's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A label at a line's start, its kind, and what shows that the line only speaks of it.
CAPTIONS = (("table", r"^(?:Table|TABLE)\s+[A-Z]?[0-9]+"), ("figure", r"^(?:Figure|FIGURE|Chart|CHART|Fig\.)\s+[A-Z]?[0-9]+"), ("box", r"^(?:Box|BOX)\s+[A-Z]?[0-9]+"))
REFERENCE = r"^\S+\s+[A-Z]?[0-9.]+\s+(?:shows|gives|presents|and|which|indicates|below|above)\b"
MAX_HEADING_WORDS = 20


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def caption_kind(c: Column) -> Column:
    """table, figure, box or null; a sentence about a table is no caption."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(CAPTIONS):
        kind = F.when(c.rlike(pattern), name).otherwise(kind)
    return F.when(~c.rlike(REFERENCE), kind)


def is_heading(c: Column) -> Column:
    """A short line in capitals or with capital initials, or numbered; not a sentence."""
    words = _words(c)
    n = F.size(words)
    capital = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}") & (F.upper(w) == w)))
    title = ~c.rlike(r"(?:^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}") & c.rlike(r"\p{L}")
    numbered = c.rlike(r"^(?:\(?[0-9]{1,2}[.)]|[IVXLC]{1,6}[.)])\s+\S")
    sentence = c.rlike(r"[.,;]$") & (n > 3)
    return (n > 0) & (n <= MAX_HEADING_WORDS) & ~sentence & (numbered | (capital >= F.greatest(F.lit(1), F.floor(n * 0.7))) | title)


def line_kind(c: Column) -> Column:
    """heading, other for a few short words, or paragraph."""
    short = (F.size(_words(c)) < 4) & (F.length(c) < 40)
    return F.when(is_heading(c), "heading").when(short, "other").otherwise("paragraph")


def is_footnote(c: Column) -> Column:
    """Starts with a mark or a word of source, or is short and cites."""
    cites = (F.size(_words(c)) <= 40) & c.rlike(r"\((?:19|20)[0-9]{2}\)|https?://|ibid|op\. cit")
    return c.rlike(r"^(?:[0-9]{1,3}|\*{1,3}|†)\s+\S") & c.rlike(r"\p{L}") | c.rlike(r"^(?:Notes?|Source|SOURCE)") | cites


def reference_marks(c: Column) -> Column:
    """Numbers in brackets that point to a note or a work."""
    return F.regexp_extract_all(c, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1))


def page_label(c: Column) -> Column:
    """The number of a line that is nothing but a page number, else null."""
    found = F.regexp_extract(c, r"^\s*(?:[Pp]age\s+)?([0-9]{1,4}|[ivxlc]{1,7})\s*$", 1)
    return F.when(found != "", found)


#: How a section is told: (method, pattern with the number as its first group, needs a heading, confidence).
SECTIONS = (
    ("numbered_dotted_pattern", r"^([0-9]{1,2}(?:\.[0-9]{1,3})+)\.?\s", False, 0.8),
    ("chapter_pattern", r"^(?:[Cc]hapter|CHAPTER)\s+([0-9IVXLC]+)", True, 0.9),
    ("standalone_heading", r"^\(?([0-9]{1,2})[.)]\s+\S", True, 0.85),
)


def section_starts(lines: DataFrame) -> DataFrame:
    """(document_id, unit_index, number, method, confidence) of the lines where a section starts."""
    text, heading = F.col("text"), is_heading(F.col("text"))
    method, number, confidence = F.when(heading, "standalone_heading"), F.lit(""), F.when(heading, 0.7)
    for name, pattern, needs, sure in reversed(SECTIONS):
        fits = text.rlike(pattern) & (heading if needs else (heading | (F.size(_words(text)) > 3)))
        method, number = F.when(fits, name).otherwise(method), F.when(fits, F.regexp_extract(text, pattern, 1)).otherwise(number)
        confidence = F.when(fits, F.when(heading & F.lit(not needs), 0.95).otherwise(sure)).otherwise(confidence)
    rows = lines.select("document_id", "unit_index", "text", method.alias("method"), number.alias("number"), confidence.alias("confidence"))
    return rows.where("method is not null").select("document_id", "unit_index", "number", "method", "confidence")


def sections(lines: DataFrame, least: float = 0.7) -> DataFrame:
    """Confirmed sections with their first and last line: the last is before the next start."""
    starts = section_starts(lines).where(F.col("confidence") >= least)
    ends = lines.groupBy("document_id").agg(F.max("unit_index").alias("_last"))
    w = Window.partitionBy("document_id").orderBy("unit_index")
    rows = starts.withColumn("_next", F.lead("unit_index").over(w)).withColumn("section", F.row_number().over(w)).join(ends, "document_id")
    return rows.select("document_id", "section", "number", "method", "confidence", F.col("unit_index").alias("first_line"), F.coalesce(F.col("_next") - 1, "_last").alias("last_line"))


def grid_quality(c: Column) -> Column:
    """HIGH, MEDIUM or LOW by the cells that bars or gaps of two blanks cut a table line into."""
    cells = F.size(F.split(F.trim(c), r" *[|] *| {2,}"))
    return F.when(cells >= 3, "HIGH").when(cells == 2, "MEDIUM").otherwise("LOW")


def tables(lines: DataFrame) -> DataFrame:
    """(document_id, first_line, lines, columns, quality) of runs of neighbouring table lines: gaps and islands."""
    w = Window.partitionBy("document_id").orderBy("unit_index")
    rows = lines.where("unit_type = 'table'").select("document_id", "unit_index", "text", (F.col("unit_index") - F.row_number().over(w)).alias("_run"))
    cells = F.size(F.split(F.trim("text"), r" *[|] *| {2,}"))
    found = rows.groupBy("document_id", "_run").agg(F.min("unit_index").alias("first_line"), F.count(F.lit(1)).alias("lines"), F.min(cells).alias("least"), F.max(cells).alias("columns"))
    quality = F.when((F.col("lines") >= 2) & (F.col("least") >= 3), "HIGH").when(F.col("columns") >= 2, "MEDIUM").otherwise("LOW")
    return found.select("document_id", "first_line", "lines", "columns", quality.alias("quality"))
