"""Text functions of the provision extractor, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that open a provision, in full and in short.
KEYWORDS = ("Article", "Art\\.", "Section", "Principle", "Paragraph", "Pasal", "Bab", "Bagian", "Ayat", "Recommendation", "Rec\\.", "Annex", "Chapter", "Value", "Guideline")
SHORT_KEYWORDS = ("Article", "Principle", "Section", "Paragraph", "Recommendation", "Guideline")
#: For texts without headings: numbered paragraphs.
NUMBERED = r"(\n\n\d+\.\s+)"
# Longest text of a provision, shortest ones that count.
TEXT_CAP, MIN_LENGTH, MIN_LENGTH_EXPLORE = 2000, 30, 50
LABEL_CUT = 45


def strip(c: Column) -> Column:
    """Without any white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def sentence_case(c: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2_147_483_647)))


def normalise_title(c: Column) -> Column:
    """White space collapsed, leading ``Art.`` and ``Rec.`` written out, sentence case."""
    full = F.regexp_replace(F.regexp_replace(collapse(c), r"(?i)^Art\.\s*", "Article "), r"(?i)^Rec\.\s*", "Recommendation ")
    return sentence_case(full)


def heading_pattern(keywords=KEYWORDS, letter: bool = True) -> str:
    """A keyword, white space, digits and, if asked for, perhaps one letter; no word boundary before it."""
    return "((?:" + "|".join(keywords) + r")\s+\d+" + ("[A-Za-z]?)" if letter else ")")


def year_from_name(c: Column, default: int) -> Column:
    """The first four digits in a row, else ``default``."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")).try_cast("int"), F.lit(default))


def base_name(path: Column, suffix: str = ".pdf") -> Column:
    return F.replace(F.regexp_extract(path, r"[^/]+$", 0), F.lit(suffix), F.lit(""))


def shorten(c: Column, limit: int = LABEL_CUT) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def first_match(cases: list[tuple[str, str]], default: str, c: Column) -> Column:
    """The value of the first part that ``c`` contains."""
    chain = reduce(lambda acc, case: F.when(F.contains(c, F.lit(case[0])), case[1]) if acc is None else acc.when(F.contains(c, F.lit(case[0])), case[1]), cases, None)
    return chain.otherwise(default)


# Folder -> class, in order; the first that the path contains wins.
INTL_CLASSES = [
    ("a_binding_international_instrument", "Intl: Binding Law"),
    ("b_global_soft_law", "Intl: Soft Law"),
    ("c_sectoral_international_guidance", "Intl: Sectoral Guidance"),
    ("d_international_technical_standards", "Intl: Technical Standard"),
]
NATL_CLASSES = [
    ("a_binding_national_regulation", "Natl: Binding Law"),
    ("b_national_soft_law_and_strategies", "Natl: Strategy & Soft Law"),
    ("c_sectoral_national_guidance", "Natl: Sectoral/Agency Guidance"),
    ("d_judicial_decisions", "Natl: Judicial Decision"),
]
# Years of documents whose name has none, by side.
DEFAULT_YEAR = {"intl": 2023, "natl": 2020, "inc": 2024}


def class_from_path(path: Column, side: str) -> Column:
    if side == "intl":
        return first_match(INTL_CLASSES, "Intl: General", path)
    return first_match(NATL_CLASSES, "Natl: General", path)


def node_id(doc: Column, title: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), doc, F.lit("_"), F.replace(title, F.lit(" "), F.lit("_")))


def split_provisions(texts: DataFrame, doc: str = "doc", text: str = "text", keywords=KEYWORDS, fallback: str | None = None, min_length: int = MIN_LENGTH, letter: bool = True) -> DataFrame:
    """(doc, ord, title, content): one row for each heading and what follows it.

    A repeated title keeps its first place and its last content; content is cut
    to TEXT_CAP before it is stripped and dropped unless longer than
    ``min_length``.  ``fallback`` is a second pattern for texts without headings.
    A null text has no provisions.
    """
    pattern = "(?i)" + heading_pattern(keywords, letter)

    def parts(p: str) -> Column:
        heads = F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))
        return F.arrays_zip(heads.alias("h"), F.slice(F.split(F.col(text), p, -1), 2, 2_147_483_647).alias("b"))

    found = parts(pattern)
    if fallback:
        found = F.when(F.size(found) > 0, found).otherwise(parts(fallback))
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(found).alias("ord", "p"))
    content = strip(F.substring(F.col("p.b"), 1, TEXT_CAP))
    rows = rows.select("doc", "ord", normalise_title(F.col("p.h")).alias("title"), content.alias("content")).where(F.char_length("content") > min_length)
    return rows.groupBy("doc", "title").agg(F.min("ord").cast("long").alias("ord"), F.max_by("content", "ord").alias("content")).select("doc", "ord", "title", "content")


def explore_provisions(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Provisions by the short keywords, without a letter after the number; texts without any are split at numbered paragraphs."""
    return split_provisions(texts, doc, text, SHORT_KEYWORDS, NUMBERED, MIN_LENGTH_EXPLORE, letter=False)


def distinct_headings(texts: DataFrame, doc: str = "doc", text: str = "text", keywords=KEYWORDS) -> DataFrame:
    """(doc, titles): the distinct titles of each text's provisions, sorted."""
    return split_provisions(texts, doc, text, keywords).groupBy("doc").agg(F.sort_array(F.collect_set("title")).alias("titles"))


def html_escape(c: Column) -> Column:
    """``<`` and ``>`` as entities."""
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fixed(c: Column, places: int) -> Column:
    """A number with that many decimals (8 at most), as C and Python write it; null stays.

    The double's exact value is rounded, ties to even; ``format_string`` rounds
    its shortest decimal form instead, and up.  A product and its rounding error
    (from the factor's two halves) are exact together.
    """
    scale = float(10**places)
    x = F.abs(c.cast("double"))
    up = x * 134_217_729.0
    high = up - (up - x)
    whole = x * scale
    error = (high * scale - whole) + (x - high) * scale
    below = F.floor(whole)
    over = (whole - below) + error
    n = F.when((over > 0.5) | ((over == 0.5) & (below % 2 == 1)), below + 1).otherwise(below)
    text = F.concat(F.floor(n / int(scale)).cast("string"), F.lit("." if places else ""), F.lpad((n % int(scale)).cast("string"), places, "0") if places else F.lit(""))
    return F.concat(F.when(c < 0, "-").otherwise(""), text)
