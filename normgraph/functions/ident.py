"""Readable identifiers of incidents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normgraph.functions.text import strip

# Incident type codes.
TYPE_CODES = {"data_breach": "DB", "ransomware": "RW", "ai_fraud": "AF", "ai_misuse": "AM"}
# Institution prefix -> code, in order; the first that fits wins.
INSTITUTIONS = [
    ("Dinas Kesehatan", "DINKES"),
    ("Dinas Pendidikan", "DINDIK"),
    ("Pengadilan Negeri", "PN"),
    ("Pemkot", "PEMKOT"),
    ("Pemkab", "PEMKAB"),
    ("Universitas", "UNIV"),
    ("RSUD", "RSUD"),
    ("BUMD", "BUMD"),
    ("DPRD", "DPRD"),
    ("BPR", "BPR"),
]
# Codes of the listed cities.
CITY_CODES = {
    "Tulungagung": "TLGAGUNG",
    "Sidoarjo": "SIDOARJO",
    "Magetan": "MAGETAN",
    "Tuban": "TUBAN",
    "Bangkalan": "BANGKALAN",
    "Yogyakarta": "YOGYA",
    "Blitar": "BLITAR",
    "Ponorogo": "PONOROGO",
    "Pasuruan": "PASURUAN",
    "Jember": "JEMBER",
    "Trenggalek": "TRENGGALEK",
    "Madiun": "MADIUN",
    "Ngawi": "NGAWI",
    "Pacitan": "PACITAN",
    "Pamekasan": "PAMEKASAN",
    "Probolinggo": "PROBOLINGGO",
    "Bojonegoro": "BOJONGORO",
    "Semarang": "SEMARANG",
    "Lamongan": "LAMONGAN",
    "Nganjuk": "NGANJUK",
    "Malang": "MALANG",
    "Banyuwangi": "BANYUWANGI",
    "Jombang": "JOMBANG",
    "Surabaya": "SURABAYA",
    "Kediri": "KEDIRI",
    "Mojokerto": "MOJOKERTO",
    "Gresik": "GRESIK",
    "Situbondo": "SITUBONDO",
    "Bondowoso": "BONDOWOSO",
    "Lumajang": "LUMAJANG",
    "Sampang": "SAMPANG",
    "Sumenep": "SUMENEP",
    "Bangil": "BANGIL",
}

INSTITUTION_PATTERN = r"(?i)milik instansi\s+(.+?)(?:\.|$)"


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once, however often ``made`` names it."""
    return F.element_at(F.transform(F.array(value), made), 1)


def institution(text: Column) -> Column:
    """What follows the phrase that names an institution, null without it."""
    return F.nullif(F.regexp_replace(strip(F.regexp_extract(text, INSTITUTION_PATTERN, 1)), r"\.+$", ""), F.lit(""))


def city_code(city: Column) -> Column:
    return _once(strip(city), _city_code)


def _city_code(plain: Column) -> Column:
    known = F.create_map(*[F.lit(x) for c, code in CITY_CODES.items() for x in (c.lower(), code)])
    rest = F.when(plain == "", F.lit("UNK")).otherwise(F.substring(F.upper(plain), 1, 8))
    return F.coalesce(F.element_at(known, F.lower(plain)), rest)


def institution_code(name: Column) -> Column:
    """Code of the institution's kind and city; other names give two words' first five letters."""
    return _once(strip(name), _institution_code)


def _institution_code(plain: Column) -> Column:
    words = F.slice(F.split(plain, r"(?U)\s+"), 1, 2)
    other = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 5))), "-")
    cases = reduce(lambda acc, x: F.when(plain.startswith(x[0]), F.concat(F.lit(x[1] + "-"), city_code(F.replace(plain, F.lit(x[0]), F.lit(""))))) if acc is None else acc.when(plain.startswith(x[0]), F.concat(F.lit(x[1] + "-"), city_code(F.replace(plain, F.lit(x[0]), F.lit(""))))), INSTITUTIONS, None)
    return cases.otherwise(other)


def rename_incidents(incidents: DataFrame, id_col: str = "id", text_col: str = "text", year_col: str = "year", ord_col: str = "ord", prefix: str = "incident-auto-") -> DataFrame:
    """Incidents with ``new_id``: generated ids become institution-year, in lower case.

    Rows are taken in order; the second, third, ... one of a name gets -2, -3,
    ..., without names that a fixed id further up already has.  A name may have
    any number of rows: no task takes all of them.
    """
    from normgraph.operators.ranking import running_sums

    auto = F.col(id_col).startswith(prefix)
    code = F.coalesce(institution_code(institution(F.col(text_col))), F.concat(F.lit("AUTO-"), F.element_at(F.split(F.col(id_col), "-"), -1)))
    named = incidents.withColumn("_auto", auto).withColumn("_base", F.when(auto, F.lower(F.concat_ws("-", code, F.coalesce(F.col(year_col), F.lit(2024)).cast("string")))).otherwise(F.col(id_col)))
    # a fixed id takes number 1 of its own name, and number k of the name before a final -k
    tail = F.regexp_extract("_base", r"^(.+)-([1-9]\d{0,8})$", 2).try_cast("int")
    stem = F.regexp_extract("_base", r"^(.+)-([1-9]\d{0,8})$", 1)
    places = F.when(F.col("_auto"), F.array(F.struct(F.col("_base").alias("base"), F.lit(0).alias("k")))).when(tail >= 2, F.array(F.struct(F.col("_base").alias("base"), F.lit(1).alias("k")), F.struct(stem.alias("base"), tail.alias("k")))).otherwise(F.array(F.struct(F.col("_base").alias("base"), F.lit(1).alias("k"))))
    rows = named.select(F.col(ord_col).alias("_at"), F.explode(places).alias("p")).select("_at", "p.base", "p.k")
    counted = running_sums(rows, "base", ("_at", "k"), (F.col("k") == 0).cast("long"), "nth")
    taken = counted.where("k > 0").groupBy("base").agg(F.array_sort(F.collect_set(F.struct("k", "_at", "nth"))).alias("taken"))
    # a number counts as taken unless generated names had reached it before the fixed id came
    none = F.array().cast("array<struct<k:int,_at:bigint,nth:bigint>>")
    in_time = F.aggregate(F.transform("taken", lambda t: F.struct(t["k"].cast("int").alias("k"), t["_at"].cast("long").alias("_at"), t["nth"].cast("long").alias("nth"))), none, lambda acc, t: F.when((t["nth"] + F.size(F.filter(acc, lambda x: x["_at"] < t["_at"])) < t["k"]) & ~F.exists(acc, lambda x: x["k"] == t["k"]), F.concat(acc, F.array(t))).otherwise(acc))
    numbers = counted.where("k = 0").join(taken.select("base", in_time.alias("taken")), "base", "left")
    skipped = F.aggregate(F.coalesce("taken", none), F.col("nth").cast("long"), lambda n, t: F.when((t["_at"] < F.col("_at")) & (t["k"] <= n), n + 1).otherwise(n))
    numbered = numbers.select(F.col("_at").alias("_o"), skipped.alias("_n"))
    out = named.join(numbered, F.col("_auto") & (F.col(ord_col) == F.col("_o")), "left")
    return out.withColumn("new_id", F.when(F.col("_auto") & (F.col("_n") > 1), F.concat_ws("-", "_base", F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_auto", "_base", "_n", "_o")
