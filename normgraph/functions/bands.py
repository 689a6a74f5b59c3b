"""Labels by bands of scores and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normgraph.functions.text import fixed
from normgraph.model import INCIDENT

# Cut-offs of the bands below.
TIER_CUTS = ((0.95, "Identik"), (0.80, "Sangat Kuat"))
TIER_ELSE = "Lemah"
CROSS_FULL, CROSS_PARTIAL, CROSS_DEFAULT = 0.30, 0.10, 0.05
KEY_RANK, SUPPORT_RANK = 0.1, 0.3


def band(value: Column, cuts: list[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """The label of the first cut that ``value`` reaches (exceeds, if strict)."""
    out = None
    for cut, label in cuts:
        test = value > cut if strict else value >= cut
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def below(value: Column, cuts: list[tuple[float, str]], default: str) -> Column:
    """The label of the first cut that ``value`` is below."""
    out = None
    for cut, label in cuts:
        out = F.when(value < cut, label) if out is None else out.when(value < cut, label)
    return out.otherwise(default)


def weight_tier(weight: Column, cuts=TIER_CUTS) -> Column:
    """Tier of an edge by its weight rounded to four places."""
    return band(F.round(weight, 4), list(cuts), TIER_ELSE)


def cross_tier(score: Column, full: float = CROSS_FULL, partial: float = CROSS_PARTIAL) -> Column:
    return band(score, [(full, "full"), (partial, "partial")], "pseudo")


def edge_label(kind: Column, weight: Column, cuts=TIER_CUTS) -> Column:
    """``type (Tier 71.2%)``; a weight of 0 leaves the bracket out."""
    tier = F.concat(F.lit(" ("), weight_tier(weight, cuts), F.lit(" "), fixed(weight * 100, 1), F.lit("%)"))
    return F.concat(F.replace(kind, F.lit("_"), F.lit(" ")), F.when(weight == 0, "").otherwise(tier))


def label_percent(label: Column, default: float, token: str = "Sim") -> Column:
    """The share in a label's ``token NN.N%``, or ``default``."""
    found = F.nullif(F.regexp_extract(label, token + r"\s*([0-9.]+)\s*%", 1), F.lit(""))
    return F.coalesce(found.try_cast("double") / 100, F.lit(default))


def orientation(src: Column, dst: Column, year_src: Column, year_dst: Column, default_year: int = 2020) -> dict[str, Column]:
    """from, to, arrows: older to newer with an arrow; equal years keep their order without one."""
    a, b = F.coalesce(year_src, F.lit(default_year)), F.coalesce(year_dst, F.lit(default_year))
    return {"from": F.when(a <= b, src).otherwise(dst), "to": F.when(a <= b, dst).otherwise(src), "arrows": F.when(a == b, "").otherwise("to")}


def connectivity(degree: Column) -> Column:
    return F.when(degree == 0, "isolated").when(degree <= 2, "low").otherwise("hub")


def sector_band(score: Column) -> Column:
    return below(score, [(30, "low"), (60, "medium")], "high")


def status_icon(status: Column) -> Column:
    return F.when(status == "covered", "✅").when(status == "partial", "⚠️").otherwise("❌")


def modularity_band(q: Column) -> Column:
    return band(q, [(0.4, "Tinggi"), (0.2, "Sedang")], "Rendah")


def density_band(density: Column) -> Column:
    return below(density, [(0.01, "Sangat Jarang"), (0.05, "Jarang")], "Moderat")


def isolated_band(count: Column) -> Column:
    return F.when(count == 0, "none").when(count < 5, "few").otherwise("many")


def average_degree_band(value: Column) -> Column:
    return below(value, [(2.0, "sparse")], "connected")


def dominance(dc: Column) -> Column:
    return band(dc, [(0.15, "LEX GENERALIS DOMINAN"), (0.05, "Hub Sektoral")], "Norma Periferal", strict=True)


def interpretive_role(bc: Column, high: Column, middle: Column) -> Column:
    """Key, supporting or peripheral by the values at two ranks; all are key where the first is 0."""
    return F.when(bc >= high, "KUNCI").when(bc >= middle, "Pendukung").otherwise("Periferal")


def legal_uncertainty(degree: Column, dc: Column, bc: Column) -> Column:
    return F.when(degree == 0, "KRITIS").when((dc > 0.15) & (bc < 0.01), "TINGGI").when((dc < 0.03) & (bc < 0.005), "SEDANG").otherwise("RENDAH")


def policy_flag(degree: Column, classification: Column, dc: Column) -> Column:
    cls = F.coalesce(classification, F.lit(""))
    isolated = F.when(cls.startswith("Intl:"), "GAGAL ADOPSI").when(cls.startswith("Natl:"), "GAGAL KONEKSI").otherwise("Structural Hole")
    return F.when(degree == 0, isolated).when(dc > 0.2, "DOMINASI LEX GENERALIS").otherwise("Normal")


def cluster_status(isolated: Column, size: Column) -> Column:
    return band(isolated / F.greatest(size, F.lit(1)), [(0.7, "KRITIS"), (0.3, "PERHATIAN")], "MODERAT", strict=True)


# What an isolated node means, by the beginning of its class: kind, and effects on remedy, certainty and policy.
HOLES = (
    ("Intl:", "Norma Internasional TIDAK DIADOPSI", "Hakim tidak bisa merujuk norma internasional ini karena tidak ada padanannya di hukum nasional yang mengikat", "Warga & perusahaan AI tidak dapat mengantisipasi kewajiban hukum yang akan berlaku", "GAGAL ADOPSI: Pemerintah tidak menyediakan mekanisme transplantasi norma internasional ke regulasi domestik"),
    ("Natl:", "Norma Nasional TERISOLASI", "Pasal ini tidak memiliki koneksi ke kasus/insiden manapun — existentially irrelevant untuk kasus AI", "Pasal ada namun tidak operasional dalam konteks AI — menciptakan ilusi kepastian hukum", "DESAIN GAGAL: Pasal dirancang terlalu sempit atau tidak memperhitung perkembangan AI"),
    ("", "Insiden Tanpa Warrant Normatif", "Tidak ada norma yang bisa dirujuk hakim untuk menentukan pelanggaran hukum kasus ini", "KEKOSONGAN ABSOLUT: Pelaku tidak dapat ditindak, korban tidak mendapat kepastian ganti rugi", "POLICY GAP KRITIS: Pemerintah belum mengantisipasi tipologi kejahatan AI ini dalam desain regulasi"),
)
# Colours of themes and of tiers.
THEME_COLOURS = (
    ("Transparansi & Eksplainabilitas", "#0ea5e9"),
    ("Manajemen Risiko", "#f59e0b"),
    ("Pengawasan Manusia", "#10b981"),
    ("Tata Kelola Data", "#6366f1"),
    ("Akuntabilitas", "#a855f7"),
    ("Larangan Penggunaan AI Berbahaya", "#f43f5e"),
    ("Kewajiban Penyedia AI", "#ec4899"),
    ("Conformity & Sertifikasi", "#14b8a6"),
    ("Regulatory Sandbox", "#84cc16"),
)
TIER_COLOURS, WEAK_COLOUR, PLAIN_COLOUR = ((95, "#10b981"), (80, "#f59e0b")), "#f43f5e", "rgba(203, 213, 225, 0.35)"


def hole(classification: Column) -> dict[str, Column]:
    """What kind of structural hole an isolated node is and what follows from it: kind, remedy, certainty, policy."""
    cls = F.coalesce(classification, F.lit(""))
    pick = lambda k: F.when(cls.startswith(HOLES[0][0]), HOLES[0][k]).when(cls.startswith(HOLES[1][0]), HOLES[1][k]).otherwise(HOLES[2][k])
    return {name: pick(k) for k, name in enumerate(("kind", "remedy", "certainty", "policy"), 1)}


def hole_kind(classification: Column) -> Column:
    return hole(classification)["kind"]


def edge_colour(graph: str, label: Column) -> Column:
    """Colour of an edge: in the cross graph by the percentage in its label, else (and without one) by the theme that the label names."""
    out = F.lit(PLAIN_COLOUR)
    for theme, colour in reversed(THEME_COLOURS):
        out = F.when(F.contains(label, F.lit(theme)), colour).otherwise(out)
    if graph == "cross":
        tiered = F.nullif(F.regexp_extract(label, r"(?i)(?:Identik|Sangat Kuat|Lemah|Sim)\s*([0-9.]+)%", 1), F.lit("")).try_cast("double")
        out = F.when(tiered.isNotNull(), band(tiered, list(TIER_COLOURS), WEAK_COLOUR)).otherwise(out)
    return out


def type_badge(kind: Column) -> Column:
    known = {"ransomware": "Ransomware", "data_breach": "Data Breach", "ai_misuse": "AI Misuse", "ai_fraud": "AI Fraud"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), kind), F.lit("Other"))


def is_incident(column: Column) -> Column:
    return column == INCIDENT


def prefix_class(classification: Column) -> Column:
    """``Natl`` or ``Intl`` of a classification."""
    return F.substring(classification, 1, 4)
