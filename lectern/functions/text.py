"""Column functions over text: tokens, sentences, citations, keys, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that results depend on.
TOKEN = r"[a-z0-9]+(?:[-+][a-z0-9]+|[./][0-9][a-z0-9]*)*"
TOKEN_PART = r"[a-z0-9]+(?:[-+][a-z0-9]+)*"
PAGE_MARKER = r"<!--\s*page:\d+\s*-->"
CITATION = r"\[(?:Source\s+)?\d+(?:\s*(?:,|&|and)\s*(?:Source\s+)?\d+)*\]"
CITATION_ARTIFACT = r"^(?:\d{4}[a-z]|[a-z]\d{4,}|10\.\d{4,5})$"
WEAK_SCORE = 0.3
TITLE_CHARS = 80
HISTORY_TURNS = 6


def casefold(text: Column) -> Column:
    """Lower case with ß as ss; other special foldings do not occur in Latin text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokenize(text: Column) -> Column:
    """All tokens of a text in order: runs of letters and digits, joined by - + or by . / before a digit."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def subtokens(text: Column) -> Column:
    """The parts of all tokens between . and / as tokens of their own, as the index holds them."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PART), 0)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_pages(text: Column) -> Column:
    return F.split(text, PAGE_MARKER)


def furniture_key(line: Column) -> Column:
    """What repeats of a running header or footer have in common: digits become #."""
    return F.regexp_replace(casefold(F.trim(line)), r"\d+", "#")


def clean_chunk(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, PAGE_MARKER, ""))


def strip_image_placeholders(markdown: Column) -> Column:
    """Delete lines ``==> ... <==``; only then are more than two newlines made two."""
    without = F.regexp_replace(markdown, r"(?m)^\s*==>.*<==\s*$", "")
    return F.when(markdown.rlike(r"(?m)^\s*==>.*<==\s*$"), F.regexp_replace(without, r"\n{3,}", "\n\n")).otherwise(markdown)


def count_image_placeholders(markdown: Column) -> Column:
    return F.regexp_count(markdown, F.lit(r"(?m)^\s*==>.*<==\s*$"))


def substantive_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, PAGE_MARKER, ""), r"[#*|\-\s]", ""))


def doc_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def split_sentences(text: Column) -> Column:
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


def cited_numbers(text: Column) -> Column:
    """Source numbers of all citation tokens in order, repeats kept."""
    tokens = F.regexp_extract_all(text, F.lit(CITATION), 0)
    return F.flatten(F.transform(tokens, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), 0), lambda d: d.cast("int"))))


def claim_marker(numbers: Column, scores: Column, weak: float = WEAK_SCORE) -> Column:
    """unsupported without a citation in range; weak without a score of ``weak`` or more; else ok."""
    inside = F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(scores)))
    got = F.filter(F.transform(inside, lambda n: F.try_element_at(scores, n)), lambda s: s.isNotNull())
    return F.when(F.size(inside) == 0, "unsupported").when(F.array_max(got) >= weak, "ok").otherwise("weak")


def truncate(text: Column, limit: int = TITLE_CHARS) -> Column:
    flat = collapse(F.coalesce(text, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.when(flat == "", "(untitled)").when(F.length(flat) > limit, cut).otherwise(flat)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def topic_id(hashes: Column) -> Column:
    return F.concat(F.lit("topic-"), F.substring(F.sha2(F.array_join(F.array_sort(hashes), ","), 256), 1, 10))


def digest_of_set(hashes: Column) -> Column:
    """Digest of the distinct values, independent of their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(hashes)), "\n"), 256)


def format_citation(number: Column, name: Column, page: Column, section: Column) -> Column:
    return F.concat_ws(
        " · ",
        F.concat(F.lit("["), number.cast("string"), F.lit("] "), name),
        F.concat(F.lit("p."), page.cast("string")),
        F.concat(F.lit('"'), section, F.lit('"')),
    )


def is_citation_artifact(token: Column) -> Column:
    return token.rlike(CITATION_ARTIFACT)


def is_label_artifact(label: Column) -> Column:
    tokens = F.split(label, r"\s+")
    return (F.length(F.replace(label, F.lit(" "), F.lit(""))) <= 2) | F.exists(tokens, lambda t: t.rlike(r"^\d+$") | (F.length(t) == 1))


def plausible_year(year: Column, current: Column) -> Column:
    return F.when((year >= 1800) & (year <= current + 1), year)


def extract_doi(text: Column) -> Column:
    """The first DOI, without punctuation that follows it."""
    found = F.regexp_extract(text, r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", 0)
    return F.nullif(F.regexp_replace(found, r"[.,;)\]]+$", ""), F.lit(""))


def citation_year(text: Column) -> Column:
    """A year in parentheses, else any year of the last or this century."""
    inside = F.regexp_extract(text, r"\(((?:19|20)\d{2})[a-z]?\)", 1)
    loose = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(loose, F.lit(""))).cast("int")


def arxiv_year(filename: Column) -> Column:
    yy = F.nullif(F.regexp_extract(filename, r"(?:^|\D)(\d{2})(?:0[1-9]|1[0-2])\.\d{4,5}", 1), F.lit("")).cast("int")
    return F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy)


def citation_confidence(year: Column, authors: Column, title: Column, doi: Column) -> Column:
    # The weight of each field.
    score = F.when(year.isNotNull(), 0.30).otherwise(0.0) + F.when(authors.isNotNull(), 0.25).otherwise(0.0)
    score = score + F.when(F.length(title) >= 10, 0.25).otherwise(0.0) + F.when(doi.isNotNull(), 0.20).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def stem_candidates(word: Column) -> Column:
    """The word and its conservative singulars."""
    n = F.length(word)
    forms = F.array(
        word,
        F.when(word.rlike("ies$") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y"))),
        F.when(word.rlike("(?:ses|xes|zes|ches|shes)$") & (n > 4), F.substring(word, F.lit(1), n - 2)),
        F.when(word.rlike("[^s]s$") & (n > 3), F.substring(word, F.lit(1), n - 1)),
    )
    return F.array_distinct(F.array_compact(forms))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def escape_bibtex(text: Column) -> Column:
    return F.regexp_replace(collapse(text), r"([{}])", r"\\$1")


def author_label(authors: Column) -> Column:
    """Up to three authors joined, else the first and others."""
    names = F.filter(F.transform(F.split(authors, r"\s*(?:;|,|&|\band\b)\s*"), F.trim), lambda a: a != "")
    return F.when(F.size(names) <= 3, F.array_join(names, ", ")).otherwise(F.concat(names[0], F.lit(" et al.")))


def preview(text: Column, limit: int = 90) -> Column:
    """One line, cut at the end of a word."""
    flat = collapse(text)
    head = F.regexp_replace(F.substring(flat, 1, limit + 1), r"\s+\S*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(head, F.lit("…")))


#: Units of file sizes, each 1024 times the one before.
UNITS = ("KB", "MB", "GB", "TB")


def format_bytes(size: Column) -> Column:
    """Bytes, or the largest unit of which there is one, with a decimal below ten, halves rounded up; a dash for null.

    Counted in whole tenths, so that no binary fraction decides a half.
    """
    out = F.when(size.isNull(), "—").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS, 1):
        one = 1 << 10 * k
        tenths, whole = (F.floor((size.cast("decimal(38,0)") * (2 * f) + one) / (2 * one)) for f in (10, 1))
        decimal = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        text = F.concat(F.when(size < 10 * one, decimal).otherwise(whole.cast("string")), F.lit(f" {unit}"))
        out = out.otherwise(text) if k == len(UNITS) else out.when(size < one << 10, text)
    return out


def file_status(exists: Column, has_document: Column, fresh: Column) -> Column:
    return F.when(~exists, "missing").when(~has_document, "new").when(fresh, "ingested").otherwise("changed")


def date_bucket(added: Column, today: Column) -> Column:
    days = F.datediff(today, F.to_date(added))
    return F.when(days <= 0, "today").when(days <= 6, "week").when(days <= 29, "month").otherwise("earlier")


def health(n_chunks: Column, mean_chars: Column, n_pages: Column, section_rate: Column, fmt: Column, reference_rate: Column) -> Column:
    """Struct of score and grade; fixed values: the penalties and the two bounds of the grades."""
    per_page = n_chunks / F.nullif(n_pages, F.lit(0))
    penalty = (
        F.when(n_chunks <= 3, 50).otherwise(0)
        + F.when((per_page < 2) | (per_page > 15), 30).otherwise(0)
        + F.when(mean_chars < 100, 40).when(mean_chars < 300, 25).otherwise(0)
        + F.when((fmt == "pdf") & (F.coalesce(n_pages, F.lit(0)) == 0), 25).otherwise(0)
        + F.when(section_rate < 0.05, 15).otherwise(0)
        + F.when(reference_rate > 0.4, 30).otherwise(0)
    )
    score = F.when(n_chunks <= 1, 0).otherwise(F.greatest(F.lit(0), 100 - penalty))
    grade = F.when(score >= 75, "healthy").when(score >= 40, "marginal").otherwise("broken")
    return F.struct(score.cast("int").alias("score"), grade.alias("grade"))
