"""Title, authors, year and identifier from the front of a marked-up document, by ranked rules over its lines.

Each field is the first answer of a list of rules. A rule of the year names where it looks (the whole
head, the front before the abstract, the identifier, the file's name) and a pattern; whether a rule is a
statement of the document about itself decides if the file's name may speak against it. Titles and
authors are read from lines, which are marked once. All of it is column code within a row: no shuffle.

Null and empty texts have no fields but what the file's name gives; nothing beyond the head of
HEAD_CHARS characters is looked at, as front matter ends there. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of the head, lines after the title in which authors are looked for, lengths of titles and author lines.
HEAD_CHARS, AUTHOR_LINES, SHORTEST_TITLE, LONGEST_AUTHORS, MARKER_CHARS = 3000, 15, 10, 400, 30
# What a year and an identifier look like, and the words that stand before them.
YEAR = r"(19\d{2}|20\d{2})"
DOI, DOI_LINK = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", r"(?i)(?:https?://)?(?:dx\.)?doi\.org/(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
# A statement may run on over lines, but not into a heading, and a year is no part of a longer number.
REACH = rf"(?:(?!\n[ \t]*#)[\s\S]){{0,60}}?(?<!\d){YEAR}(?!\d)"
PUBLISHED, SUBMITTED = rf"(?i)(?:published|copyright|©|\(c\)){REACH}", rf"(?i)(?:received|accepted|submitted){REACH}"
ARXIV = r"\b(\d{2})\d{2}\.\d{4,5}(?:v\d+)?\b"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
AFTER_MONTH, BEFORE_MONTH = rf"(?i){MONTH}\s+{YEAR}", rf"(?i){YEAR}\s+{MONTH}"
FRONT_END = r"(?im)^\s*#{0,3}\s*\**\s*(?:abstract|introduction|summary)\b"
# Headings that are no titles, lines that are no front matter, words that authors' lines do not hold or begin with.
NO_TITLE = """research article, review, reviews, report, letter, letters, perspective, commentary, abstract, introduction, summary, editor's evaluation,
competing interests, competing interest, main, results, methods, tools and resources, open access, edited by, reviewed by, correspondence, citation, copyright,
disclaimer, graphical abstract, highlights, keywords, key words, funding, acknowledgments, acknowledgements, data availability statement, conflict of interest,
publisher's note, special issue article, original research, original article, review article, research paper, brief communication, short communication,
letter to the editor, case report, editorial, erratum, correction, systematic review, specialty section, author contributions, supplementary material"""
NO_TITLE_FORMS = (
    r"(?:the author\(s\)|under (?:exclusive )?licen[cs]e|all rights reserved|©|\(c\)\s|copyright|springer nature|creative commons)",
    r"^\d+(?:\.\d+)*\.?\s+(?:introduction|methods?|results?|discussion|abstract)\b",
    r"^[a-z][a-z .&]+\s*\(?\d{4}(?!\d)\)?[,;:\s]*\d+",
)
NO_LINE = r"^\s*<!--|^\s*\d+\s+of\s+\d+\s*$|^\s*\*\*=*=>|^\s*$|^\s*-----"
NO_AUTHORS = r"(?i)\b(?:university|institute|department|laboratory|college|school|hospital|abstract|figure)\b"
NO_AUTHORS_LEAD = r"(?i)^(?:however|moreover|therefore|furthermore|additional(?:ly)?|although|whereas|here\b|we\b|our\b|in this|this (?:paper|work|article|study)|index terms|key ?words?|abstract|introduction|copyright)"
BULLETS = "-‐‑‒–—―•·‣▪●"
SELF_CITATION = r"\((?:19|20)\d{2}\)\s*([^\n]{10,300}?)\s*(?=_[A-Z])"


@dataclass(frozen=True)
class Year:
    """A rule for the year: where it looks, what for, and whether the document says so of itself. Two digits are of an identifier by year and month."""

    scope: str
    pattern: str
    stated: bool = False

    def found(self) -> Column:
        text = F.nullif(F.regexp_extract(F.coalesce(F.col(self.scope), F.lit("")), self.pattern, 1), F.lit("")).cast("int")
        return F.when(text >= 100, text).when(text >= 91, 1900 + text).otherwise(2000 + text)


# The rules in order of trust.
YEARS = (
    Year("head", PUBLISHED, stated=True),
    Year("head", ARXIV),
    Year("doi", r"[./]((?:19|20)\d{2})[./]", stated=True),
    Year("front", AFTER_MONTH),
    Year("front", BEFORE_MONTH),
    Year("head", SUBMITTED, stated=True),
    Year("front", rf"\({YEAR}\)"),
    Year("front", rf"\b{YEAR}\b"),
)
FILE_ARXIV = Year("filename", ARXIV)


def clean(text: Column) -> Column:
    """Without emphasis, brackets and escapes, in one line, and without bullets before it."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[*_\\]+", ""), r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), f"^[{BULLETS}]+\\s*", ""))


def is_title(text: Column) -> Column:
    """Whether a cleaned heading may be a title."""
    low = F.trim(F.lower(text), F.lit(": "))
    known = F.lit([" ".join(x.split()) for x in NO_TITLE.split(",")])
    return (F.length(text) >= SHORTEST_TITLE) & (low != "") & ~F.array_contains(known, low) & ~reduce(Column.__or__, [low.rlike(f) for f in NO_TITLE_FORMS])


def title_of_line(line: Column) -> Column:
    """The cleaned text of a heading of three levels, or of a line that is bold throughout; null for others and for what is no title."""
    heading, bold = F.regexp_extract(line, r"^#{1,3}\s+(.+?)\s*$", 1), F.regexp_extract(line, r"^\s*\*\*([^*]{10,})\*\*\s*$", 1)
    text = clean(F.when(heading != "", heading).otherwise(bold))
    return F.when(~line.rlike(NO_LINE) & is_title(text), text)


def authors_of_line(line: Column) -> Column:
    """The cleaned line if it reads as a list of names; else null."""
    whole = clean(F.regexp_replace(line, r"^#{1,6}\s+", ""))
    names = F.regexp_replace(whole, r"^(?:by|By|BY)\s+", "")
    several = names.contains(",") | names.rlike(r"\b(?:and|&|AND)\b") | (names != whole) | names.rlike(r"\b[A-Z]\.\s*[A-Z]")
    fine = names.rlike("^[A-Z]") & (F.length(names) <= LONGEST_AUTHORS) & ~names.contains("@") & ~names.rlike(NO_AUTHORS) & ~names.rlike(NO_AUTHORS_LEAD)
    return F.when(~line.rlike(NO_LINE) & fine & several, names)


def first_of(lines: Column, field) -> Column:  # noqa: ANN001 - a function from column to column
    return F.try_element_at(F.array_compact(F.transform(lines, field)), F.lit(1))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "filename") -> DataFrame:
    """doc, title, authors, year, doi, confidence of every document."""
    name = F.col(name_col) if name_col in docs.columns else F.lit(None).cast("string")
    out = docs.select(F.col(id_col).alias("doc"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, HEAD_CHARS).alias("head"), name.alias("filename"))
    link = F.nullif(F.regexp_extract("head", DOI_LINK, 1), F.lit(""))
    doi = F.regexp_replace(F.coalesce(link, F.nullif(F.regexp_extract("head", DOI, 0), F.lit(""))), r"[.,;)\]]+$", "")
    cited = F.nullif(F.regexp_replace(clean(F.nullif(F.regexp_extract("head", SELF_CITATION, 1), F.lit(""))), "[.,;:]+$", ""), F.lit(""))
    out = out.withColumns({"lines": F.split("head", "\n"), "doi": doi, "front": F.regexp_extract("head", rf"(?s)\A(.*?)(?:{FRONT_END}|\z)", 1)})
    out = out.withColumn("title", F.coalesce(first_of(F.col("lines"), title_of_line), cited))
    marker = F.substring("title", 1, MARKER_CHARS)
    at = F.coalesce(F.array_position(F.transform("lines", lambda line: F.contains(line, marker)), True), F.lit(0))  # 0 where no line holds it
    after = F.slice("lines", at.cast("int") + 1, F.lit(AUTHOR_LINES))
    stated = reduce(Column.__or__, [rule.found().isNotNull() for rule in YEARS if rule.stated])
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    file_year = F.array_max(F.regexp_extract_all(stem, F.lit(r"(?:^|[ _\-.])((?:19|20)\d{2})(?=$|[ _\-.])"), F.lit(1))).cast("int")
    out = out.withColumns({"authors": first_of(after, authors_of_line), "said": F.coalesce(*(rule.found() for rule in YEARS)), "by_file": FILE_ARXIV.found(), "stated": stated, "file_year": F.when(FILE_ARXIV.found().isNull(), file_year)})
    year = F.coalesce("by_file", F.when(~F.col("stated"), F.col("file_year")), "said", "file_year")
    out = out.withColumn("year", year)
    points = [(F.length("title") >= SHORTEST_TITLE, 0.35), (F.col("authors").isNotNull(), 0.25), (F.col("year").isNotNull(), 0.15), (F.col("doi").isNotNull(), 0.25)]
    confidence = F.round(reduce(Column.__add__, [F.when(c, F.lit(p)).otherwise(0.0) for c, p in points]), 2)
    return out.select("doc", "title", "authors", "year", "doi", confidence.alias("confidence"))
