"""Text, identifiers, translation, readers and writers."""

import json

from pyspark.sql import functions as F

from normgraph import sources
from normgraph.functions import ident, text, translate
from normgraph.operators import registry
from normgraph.sources import sinks
from tests.test_graph import make


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_heading_split_has_no_word_boundary(spark):
    body = "x" * 40
    df = spark.createDataFrame([("d", f"Article 1 {body} sebab 2x {body} ART. 5  {body}"), ("n", None), ("e", "")], "doc string, text string")
    rows = text.split_provisions(df).orderBy("ord").collect()
    assert [(r.doc, r.title) for r in rows] == [("d", "Article 1"), ("d", "Bab 2x"), ("d", "Article 5")]


def test_last_content_of_a_title_wins_at_its_first_place(spark):
    a, b, c = ("a" * 40, "b" * 40, "c" * 40)
    df = spark.createDataFrame([("d", f"Pasal\n 4O {a} Article 2 {b} pasal 4o {c} Article 9 short")], "doc string, text string")
    rows = text.split_provisions(df).orderBy("ord").collect()
    assert [(r.ord, r.title, r.content) for r in rows] == [(0, "Pasal 4o", c), (1, "Article 2", b)]


def test_numbered_paragraphs_where_there_are_no_headings(spark):
    df = spark.createDataFrame([("d", "intro\n\n1. " + "a" * 60 + "\n\n2. " + "b" * 60)], "doc string, text string")
    assert text.split_provisions(df, keywords=text.SHORT_KEYWORDS, fallback=text.NUMBERED, min_length=50).count() == 2


def test_years_and_names(spark):
    names = {"UU_PDP_No27_2022": 2022, "Council_CETS225": 2023, "Stranas_AI_Indonesia_2020-2045_Full": 2020}
    assert {n: one(spark, text.year_from_name(F.lit(n), 2023)) for n in names} == names
    assert one(spark, text.base_name(F.lit("/a/b/c.pdf"))) == "c"
    assert one(spark, text.strip(F.lit(" \n\t x \n"))) == "x"


def test_identifiers(spark):
    story = "Serangan milik instansi Dinas Kesehatan Tulungagung."
    rows = [("incident-auto-1", story, 2023, 0), ("dinkes-tlgagung-2023", "fixed", 2023, 1), ("incident-auto-2", story, 2023, 2), ("incident-auto-7", "nothing", None, 3)]
    df = spark.createDataFrame(rows, "id string, text string, year int, ord long")
    assert [r.new_id for r in ident.rename_incidents(df).orderBy("ord").collect()] == ["dinkes-tlgagung-2023", "dinkes-tlgagung-2023", "dinkes-tlgagung-2023-2", "auto-7-2024"]
    assert one(spark, ident.institution_code(F.lit("Pemkot New Banjarmasin"))) == "PEMKOT-NEW BANJ"


def test_translation(spark):
    pairs = [("satu", "one"), ("one dua", "one two")]
    assert one(spark, translate.translate(F.lit("satu dua"), pairs)) == "one two"
    assert one(spark, translate.translate(F.lit("satu"), pairs)) == "one"
    assert one(spark, translate.translate(F.lit(None).cast("string"), pairs)) is None
    assert one(spark, translate.translate(F.lit("Pemkot X selaku Penyelenggara Sistem Elektronik / Lembaga Pemerintah."), [])) == "City Govt X as Electronic System Operator / Government Agency."
    assert one(spark, translate.interface_text(F.lit("  Cari "), {"Cari": "Search"})) == "Search"
    assert translate.inverse({"a": "x", "b": "x"}) == {"x": "b"}


def test_graph_document_round_trip(spark, tmp_path):
    graph = make(spark, "abc", ["ab", "bc"])
    doc = json.loads(sinks.graph_document(graph).first().value)
    assert [n["id"] for n in doc["nodes"]] == ["a", "b", "c"] and doc["edges"][0]["label"] == "link (Identik 100.0%)"
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc))
    back = sources.read_graph(spark, str(path))
    assert back.nodes.count() == 3 and [(r.src, r.dst) for r in back.edges.orderBy("ord").collect()] == [("a", "b"), ("b", "c")]
    sinks.write_graph(graph, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/edges")).count() == 2


def test_incidents(spark, tmp_path):
    facts = {"subjek_pelaku": "p", "nexus_kausalitas": "n"}
    (tmp_path / "i.json").write_text(json.dumps({"metadata": {}, "incidents": [{"id": "a", "peristiwa_hukum_kronologi": "k", "pemetaan_fakta_hukum": facts}, {"id": "b"}]}))
    rows = sources.read_incidents(spark, str(tmp_path / "i.json"))
    assert rows.count() == 1 and rows.select(sources.incident_text()).first()[0] == "k p n"
    assert sources.read_incidents(spark, str(tmp_path / "none.json")).count() == 0


def test_documents_of_a_folder(spark, tmp_path):
    folder = tmp_path / "x" / "b_global_soft_law"
    folder.mkdir(parents=True)
    (folder / "Doc_2021.pdf").write_text("Article 1 " + "a" * 40 + "\fArticle 2 " + "b" * 40)
    (folder / "Broken.pdf").write_bytes(b"\xff\xfe broken")
    texts = sources.extract_texts(sources.list_files(spark, str(tmp_path)))
    rows = sources.corpus_from_texts(texts, "intl").orderBy("ord").collect()
    assert [(r.id, r.classification, r.year) for r in rows] == [("Doc_2021_Article_1", "Intl: Soft Law", 2021), ("Doc_2021_Article_2", "Intl: Soft Law", 2021)]


def test_csv_markdown_and_logs(spark, tmp_path):
    df = spark.createDataFrame([('a "q"', 1), (None, 2)], "x string, n int")
    lines = list(sinks.csv_report([("S", df)]))
    assert lines[0].startswith(sinks.BOM) and '"a ""q""","1"' in lines and '"","2"' in lines
    assert sinks.markdown_table(df, 1)[-1].startswith("| +1 more |")
    sinks.write_csv_sections([("s", df)], str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv/00-s")).count() == 2
    log = spark.createDataFrame([('{"message":"m","source":"s","lineno":3,"colno":1}',), ("broken",)], "value string")
    assert [r.line for r in sinks.log_lines(sources.parse_log(log), "t").collect()] == ["[t] ERROR: m\n  Location: s:3\n" + "=" * 50 + "\n", "[t] ERROR: Unknown Error\n" + "=" * 50 + "\n"]


def test_registry(spark):
    rules = registry.compliance_rules(spark)
    asked = spark.createDataFrame([(1, "fintech"), (2, "none"), (3, None)], "k int, sector string")
    got = registry.navigate(asked, rules).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {1: 5, 2: 3, 3: 3}
    assert registry.search(asked, "", ("sector",)).count() == 3
    assert registry.thematic_edges(spark).count() == 14


def renamed(rows, prefix="incident-auto-"):
    """New ids one row after the other: the first free name."""
    used, out = set(), []
    for old, base in rows:
        new = old
        if old.startswith(prefix):
            names = (base if k == 1 else f"{base}-{k}" for k in range(1, 10_000))
            new = next(x for x in names if x not in used)
        used.add(new)
        out.append(new)
    return out


def test_renaming_skips_names_already_taken(spark):
    import random

    pick = random.Random(5)
    fixed = ["pemkot-malang-2024", *(f"pemkot-malang-2024-{k}" for k in range(2, 9)), "other-1", "pemkot-malang-2024-02"]
    for _ in range(4):
        rows = [(f"incident-auto-{k}", "Serangan milik instansi Pemkot Malang.", 2024, "pemkot-malang-2024") for k in range(12)] + [(x, "", 2020, x) for x in pick.sample(fixed, 6)]
        pick.shuffle(rows)
        df = spark.createDataFrame([(i, t, y, k) for k, (i, t, y, _) in enumerate(rows)], "id string, text string, year int, ord long")
        assert [r.new_id for r in ident.rename_incidents(df).orderBy("ord").collect()] == renamed([(i, b) for i, _, _, b in rows])


def test_other_extractors(spark, tmp_path):
    import pytest

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 ...")

    def none(content, most):
        raise ImportError("no such library")

    with pytest.raises(Exception, match="no such library"):
        sources.extract_texts(sources.list_files(spark, str(tmp_path)), none).collect()
    pages = lambda content, most: ["one", "", "two", "three"][:most]
    got = sources.extract_texts(sources.list_files(spark, str(tmp_path)), pages).first()
    assert (got.text, got.damaged) == ("one\ntwo\nthree\n", False)
    assert sources.extract_texts(sources.list_files(spark, str(tmp_path)), pages, 3).first().text == "one\ntwo\n"


def test_a_damaged_file_is_marked(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "b.pdf").write_bytes(b"<html>Page not found</html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 ...")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.damaged) for r in sources.extract_texts(sources.list_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": ("", True), "b.pdf": ("<html>Page not found</html>\n", False), "c.pdf": ("", True)}


def test_fixed_decimals_are_those_of_python(spark):
    import random

    pick = random.Random(1)
    values = [0.0, 31.25, 56.25, 31.15, 2.85, 1.15, 0.5, 2.5, 1234567.125, -0.25, 99.95, 0.000004999] + [round(pick.uniform(0, 100), 2) for _ in range(500)] + [pick.uniform(-1e6, 1e6) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 4, 5):
        assert [r[0] for r in df.select(text.fixed(F.col("v"), places)).collect()] == [f"{v:.{places}f}" for v in values]


def test_paths_in_a_language():
    assert sources.localized("/d/legal.json", "en") == "/d/legal_en.json" and sources.localized("/d.x/legal", "en") == "/d.x/legal_en" and sources.localized("/d/a.md") == "/d/a.md"


def test_reports_in_a_language(spark, tmp_path):
    (tmp_path / "r_en.md").write_text("# T\n\n| a |")
    assert [r.line for r in sources.read_report(spark, f"{tmp_path}/r.md", "en").orderBy("ord").collect()] == ["# T", "", "| a |"]


def test_generated_incidents_are_whole_and_can_be_renamed(spark):
    rows = sources.registry_incidents(spark)
    assert rows.count() == 100 and rows.select("ord").distinct().count() == 100
    made = rows.where("id LIKE 'incident-auto-%'")
    assert made.where("year BETWEEN 2021 AND 2025 AND pemetaan_fakta_hukum.subjek_pse LIKE '% selaku Penyelenggara%'").count() == 95
    named = ident.rename_incidents(rows, text_col="peristiwa_hukum_kronologi")
    assert named.select("new_id").distinct().count() == 100 and named.where("new_id LIKE 'incident-auto-%'").count() == 0
    english = translate.translate_incidents(rows)
    assert english.where("pemetaan_fakta_hukum.subjek_pelaku LIKE 'Sindikat%'").count() == 0


def test_too_large_graphs_are_no_document(spark, monkeypatch):
    import pytest

    from normgraph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph

    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 1)
    graph = Graph(spark.createDataFrame([(str(k), k, "l", "g", "c", 2000) for k in range(2)], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
    with pytest.raises(ValueError, match="too many"):
        sinks.graph_document(graph)


def test_sizes_of_outputs(spark, tmp_path):
    (tmp_path / "x").write_text("12345")
    got = [(r.present, r.bytes) for r in sinks.audit_files(spark, [f"{tmp_path}/x", f"{tmp_path}/y"]).collect()]
    assert got == [(True, 5), (False, None)]


def test_running_sums_of_a_key_in_many_ranges(spark):
    from normgraph.operators.ranking import running_sums

    df = spark.range(20_000).selectExpr("if(id % 10 < 8, 'hot', if(id % 10 = 8, concat('k', id % 300), null)) AS key", "(id * 7919) % 20000 AS at", "id % 3 AS v")
    found = running_sums(df, "key", ("at",), F.col("v")).collect()
    upto = {}
    for r in sorted(found, key=lambda r: (r.key or "", r.at)):
        upto[r.key] = upto.get(r.key, 0) + r.v
        assert r.upto == upto[r.key]
    assert len(found) == 20_000


def test_a_name_of_very_many_rows(spark):
    """Numbers stay those of the order, and no task takes a third of the rows' name together."""
    df = spark.range(60_000).selectExpr("concat('incident-auto-', id) AS id", "'Serangan milik instansi Pemkot Malang.' AS text", "2024 AS year", "id AS ord")
    got = ident.rename_incidents(df)
    assert got.where("new_id <> if(ord = 0, 'pemkot-malang-2024', concat('pemkot-malang-2024-', ord + 1))").count() == 0
    counted = got.groupBy("new_id").count()
    assert counted.count() == 60_000


def test_outputs_are_published_together(spark, tmp_path):
    import pytest

    folder = str(tmp_path / "out")
    with sinks.published(spark, folder) as staged:
        spark.range(3).write.json(f"{staged}/a")
        spark.range(2).write.json(f"{staged}/deep/b")
    states = lambda: sorted((r.path.rsplit("/", 1)[0], r.state) for r in sinks.audit_manifest(spark, folder).collect() if ".json" in r.path)
    first = states()
    assert {s for _, s in first} == {"intact"} and {p for p, _ in first} == {"a", "deep/b"}
    for wrong in (ZeroDivisionError, KeyboardInterrupt):
        with pytest.raises(wrong), sinks.published(spark, folder) as staged:
            spark.range(9).write.json(f"{staged}/a")
            raise wrong
        assert states() == first and spark.read.json(f"{folder}/a").count() == 3
    (tmp_path / "out").rename(tmp_path / "out.former")  # a driver that died in the exchange
    with sinks.published(spark, folder) as staged:
        assert states() == first
        spark.range(5).write.json(f"{staged}/c")
    assert {p for p, _ in states()} == {"c"} and sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    part = next((tmp_path / "out" / "c").glob("*.json"))
    part.with_name(f".{part.name}.crc").unlink()
    part.write_text("{}")
    (tmp_path / "out" / "c" / "more.json").write_text("{}")
    assert [s for _, s in states()].count("changed") == 1 and [s for _, s in states()].count("unlisted") == 1


def test_incidents_of_several_documents(spark, tmp_path, monkeypatch):
    """More incidents than one document may hold come back whole and in order."""
    rows = sources.generate_incidents(spark, 23).withColumn("ord", F.col("ord") - 1)
    want = [tuple(r) for r in rows.orderBy("ord").drop("ord").collect()]
    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 10)
    monkeypatch.setattr(sinks, "PART_ROWS", 4)
    sinks.write_incidents(rows, f"{tmp_path}/many")
    back = sources.read_incidents(spark, f"{tmp_path}/many")
    got = back.orderBy("ord").collect()
    assert [tuple(r)[:-1] for r in got] == want and [r.ord for r in got] == list(range(23))
    assert len(list((tmp_path / "many").glob("part-*"))) == 6
