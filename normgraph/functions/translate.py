"""Dictionary translation in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normgraph.functions.tables import INCIDENT_DICTIONARY, SECTOR_PHRASES

# What is replaced in texts that name an electronic system operator.
OPERATOR_PHRASE = "selaku Penyelenggara Sistem Elektronik / Lembaga Pemerintah."
OPERATOR_PAIRS = [
    (OPERATOR_PHRASE, "as Electronic System Operator / Government Agency."),
    ("Dinas Kesehatan", "Health Agency"),
    ("Dinas Pendidikan", "Education Agency"),
    ("Pengadilan Negeri", "District Court"),
    ("Pemkot", "City Govt"),
    ("Pemkab", "Regency Govt"),
    ("Universitas", "University"),
]
# Overrides at the end.
WHOLE_TEXT = {"Badan Kepegawaian Negara (BKN).": "National Civil Service Agency (BKN)."}
CONTAINED = {"Pengembang Foundation Model": "AI Foundation Model Developers and Social Media Platforms."}


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Every pair replaced in turn; a later pair sees what an earlier one wrote."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
    return F.aggregate(table, c, lambda acc, p: F.replace(acc, p["k"], p["v"])) if pairs else c


def _then(c: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of ``c``, which is computed once however often the step looks at it."""
    return F.get(F.transform(F.array(c), step), F.lit(0))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value of ``c``, or ``c`` itself."""
    if not table:
        return c
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)


def inverse(table: dict[str, str]) -> dict[str, str]:
    """Value to key; of equal values the last wins."""
    return {v: k for k, v in table.items()}


def translate(c: Column, dictionary: list[tuple[str, str]]) -> Column:
    """A whole text in the dictionary gives its value; others get every pair replaced in order, then the operator phrases and the overrides.

    Null and empty texts stay as they are.
    """
    exact = dict(dictionary)
    text = _then(replace_all(c, dictionary), lambda t: F.when(F.contains(t, F.lit(OPERATOR_PHRASE)), replace_all(t, OPERATOR_PAIRS)).otherwise(t))
    text = _then(text, lambda t: lookup(t, WHOLE_TEXT))
    for part, whole in CONTAINED.items():
        text = F.when(F.contains(text, F.lit(part)), F.lit(whole)).otherwise(text)
    done = F.when(F.coalesce(c, F.lit("")) == "", c)
    if exact:
        done = done.when(c.isin(*exact), lookup(c, exact))
    return done.otherwise(text)


def interface_text(c: Column, table: dict[str, str]) -> Column:
    """Texts whose trimmed form is in the table are replaced, others stay."""
    from normgraph.functions.text import strip

    key = strip(c)
    return F.when(key.isin(*table), lookup(key, table)).otherwise(c) if table else c


#: Fields of an incident that the dictionary is applied to, and those of its facts.
FIELDS = ("peristiwa_hukum_kronologi", "kualifikasi_peristiwa")
FACTS, FACT_FIELDS = "pemetaan_fakta_hukum", ("subjek_pelaku", "subjek_pse", "nexus_kausalitas")


def translate_incidents(incidents: DataFrame, dictionary: list[tuple[str, str]] = INCIDENT_DICTIONARY) -> DataFrame:
    """Incidents with their narrative, qualification and three facts in English."""
    facts = F.col(FACTS)
    for f in FACT_FIELDS:
        facts = facts.withField(f, translate(F.col(f"{FACTS}.{f}"), dictionary))
    return incidents.withColumns({f: translate(F.col(f), dictionary) for f in FIELDS} | {FACTS: facts})


def sector_text(c: Column) -> Column:
    """Texts of the sector cards in English, phrase by phrase."""
    return replace_all(c, SECTOR_PHRASES)
