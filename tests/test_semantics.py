"""Handmade cases for what the driver's tables don't hold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import chem, model_json, text, urls
from paperloom.operators import chunking, dedup, extract, graph, metrics, titles, validate
from paperloom.sources import dumps, events, notes, pages

ZNO = (
    "Zinc acetate dihydrate (2.195 g, 10 mmol) was dissolved in 50 mL methanol and heated to 65 °C for 2 hours under reflux. KOH (1.12 g) was added to the solution,"
    " the ZnO precipitate was washed with ethanol and dried in air."
)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("said, value, unit", [("2.195 g", 2.195, "g"), ("1.2e-3 mol", 0.0012, "mol"), ("50 ML", 50.0, "mL"), ("3 mm", 3.0, "mM"), ("65°C", None, None), ("garbage", None, None), ("-5 g", -5.0, "g"), (".5 g", 0.5, "g"), ("+5 MG", 5.0, "mg"), ("-5g", None, None), ("-5 bananas", None, None)])
def test_quantity(spark, said, value, unit):
    got = one(spark, chem.quantity(F.col("t")), t=said)
    assert (got and (got.value, got.unit)) == (value and (value, unit))


def test_extraction(spark):
    row = extract.extracted(spark.createDataFrame([(1, ZNO)], "id int, text string")).first()
    roles = {e.name: e.role for e in row.entities}
    assert roles == {"Methanol": "SOLVENT", "Ethanol": "SOLVENT", "Zinc acetate dihydrate": "REACTANT", "Zinc acetate": "REACTANT", "KOH": "CATALYST", "ZnO": "PRODUCT"}
    zinc = next(e for e in row.entities if e.name == "Zinc acetate dihydrate")
    assert (zinc.quantity.value, zinc.quantity.unit, zinc.moles.value) == (2.195, "g", 10.0)
    assert (row.conditions.temperature_celsius, row.conditions.duration_hours, row.conditions.technique, row.conditions.atmosphere) == (65.0, 2.0, "reflux", "air")
    assert one(spark, text.gate(F.col("t")), t=ZNO) and not one(spark, text.gate(F.col("t")), t="the cat sat on the mat " * 10)
    assert one(spark, text.domain(F.col("t")), t=ZNO) == "chemistry"


QUANTITY = "struct<value:double,unit:string>"
CONDITIONS = "struct<temperature_celsius:double,duration_hours:double,pressure_atm:double,yield_percent:double>"


def recipe(spark, entities, conditions=(50.0, 1.0, 1.0, 90.0)):
    rows = [("r", [(i, n, r, q, m) for i, (n, r, q, m) in enumerate(entities)], conditions)]
    df = spark.createDataFrame(rows, f"recipe_id string, entities array<struct<pos:int,name:string,role:string,quantity:{QUANTITY},moles:{QUANTITY}>>, conditions {CONDITIONS}")
    return validate.summary(validate.with_findings(df)).first()


def test_rules(spark):
    good = ("Zinc", "REACTANT", (1.0, "g"), None)
    assert recipe(spark, [good]).passed
    bad = recipe(spark, [("Aa", "REACTANT", (-2.0, "bananas"), None), ("Bb", "REACTANT", (0.0, "g"), None)], (4000.0, -1.0, 0.0, 101.0))
    assert [f.error_type for f in bad.findings] == ["UNIT_INVALID", "QUANTITY_NEGATIVE", "QUANTITY_NEGATIVE", "TEMPERATURE_OUT_OF_RANGE", "DURATION_OUT_OF_RANGE", "PRESSURE_OUT_OF_RANGE", "YIELD_OUT_OF_RANGE"]
    assert bad.primary_agent == "QUANTITY_AGENT" and not bad.passed
    missing = recipe(spark, [(n, "REACTANT", None, None) for n in ("Aa", "Bb", "Cc")])
    assert [f.field_path for f in missing.findings] == [f"entities[{k}].quantity" for k in range(3)]
    assert [f.error_type for f in recipe(spark, []).findings] == ["NO_ENTITIES"]
    none = recipe(spark, [good], None)
    assert none.passed and [f.error_type for f in none.findings] == ["NO_CONDITIONS"]
    odd = recipe(spark, [("Zinc", "REACTANT", (1.0, "kg"), (0.001, "mmol"))])
    assert [(f.error_type, f.severity) for f in odd.findings] == [("MOLES_MASS_INCONSISTENT", "WARNING")]
    short = recipe(spark, [good, ("X", "REACTANT", (1.0, "g"), None), (" zinc", "SOLVENT", None, None)])
    assert [f.error_type for f in short.findings] == ["DUPLICATE_ENTITY_NAMES", "ENTITY_NAME_TOO_SHORT", "UNIT_MISSING"]


def test_attempts(spark):
    rows = [(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), (3, 2, False), (3, 3, False), (3, 4, True)]
    got = {r.chunk_id: (r.status, r.attempts_used, r.n_corrections) for r in validate.resolve_attempts(spark.createDataFrame(rows, "chunk_id int, attempt int, passed boolean")).collect()}
    assert got == {1: ("PASSED", 1, 0), 2: ("CORRECTED", 2, 1), 3: ("FAILED", 3, 2)}


@pytest.mark.parametrize(
    "raw, names",
    [
        ('```json\n{"entities": [{"name": "ZnO", "role": "PRODUCT"}]}\n```', ["ZnO"]), ('Here: [{"name": "A1", "role": "SOLVENT"}] done', ["A1"]), ('{"chemicals": [{"name": "B", "role": "REACTANT", "quantity": "2 g"},]}', ["B"]),
        ("{'entities': [{name: 'C', 'role': 'CATALYST', 'quantity': None}", ["C"]), ('{"name": "D", "role": "PRODUCT"}', ["D"]), ('{"entities": [{"name": "unknown", "role": "SOLVENT"}]}', None), ("garbage", None), ('{"entities": [{"name": "E", "role": "solvent"}]}', None),
        ('{"entities": [{"name": "F", "role": "x"}, {"name": "G", "role": "SOLVENT", "quantity": 2.84}]}', ["G"]), ('{"note": "[x]"} and [{"name": "H", "role": "SOLVENT"}]', None),
    ],
)
def test_model_json(spark, raw, names):
    good, failed = model_json.typed_and_failed(spark.createDataFrame([(raw,)], "raw string"))
    rows = good.collect()
    assert ([e.name for e in rows[0].entities] if rows else None) == names and failed.count() == (names is None)


def test_ladder_goes_on_until_entities_are_good():
    raw = 'draft {"entities": "none"} final'
    assert model_json.ladder(raw)[1] == 2 and model_json.ladder(raw, model_json.all_good) == (None, 0)
    found, step = model_json.ladder('{"entities": [{"name": "Zn", "role": "REACTANT", "quantity": {"value": "2.50", "unit": " g "}, "moles": "10 mmol"}]}', model_json.all_good)
    assert step == 1 and found[0]["quantity"] == {"value": 2.5, "unit": "g"} and found[0]["moles"] == {"value": 10.0, "unit": "mmol"}
    assert [model_json.spelled(x) for x in ("1", "2.5", "x", "3e2", "")] == [1, 2.5, None, 300.0, None]
    assert model_json.tolerant("{'a': 'it\\'s \"x\"', b: [1, 2,], \"c\": None, d: {e: True") == {"a": 'it\'s "x"', "b": [1, 2], "c": None, "d": {"e": True}}
    for bad in ("{a 1}", "{'a': 'open", "[1 2]", "{} more", "plain"):
        with pytest.raises(ValueError):
            model_json.tolerant(bad)
    assert model_json.payload("x `[1]` y") == "[1]" and model_json.payload('say {"a": "}"} {') == '{"a": "}"}'


def test_file_names_of_formulas(spark):
    assert one(spark, text.file_name(F.col("t")), t="[Zn(OAc)2]·2H2O: a/b?.x ") == "Zn_OAc_2_·2H2O_a_b_x"
    assert len(one(spark, text.file_name(F.col("t")), t="y" * 300)) == 100


def test_sections_of_handmade_documents(spark):
    body = "\n".join(f"line {k} " + "word " * 6 for k in range(9))
    doc = f"Intro\n# Experimental Section\n{body}\n2.1 Synthesis of ZnO\n{body}\n# Results\nshort"
    rows = chunking.experimental_sections(spark.createDataFrame([(1, doc), (2, None), (3, "no heading")], "doc_id long, text string"), "doc_id", "text").collect()
    assert [(r.doc_id, r.section, r.name) for r in rows] == [(1, 0, "Experimental Section"), (1, 1, "2.1 Synthesis of ZnO")] and "Results" not in rows[1].text
    many = "\n".join(f"# Experimental\n" + ("word " * 60 if k in (3, 11) else "few") + "\n1.1 Other" for k in range(13))
    rows = chunking.experimental_sections(spark.createDataFrame([(1, many)], "doc_id long, text string"), "doc_id", "text").collect()
    assert [r.section for r in rows] == [3]  # the first ten count, of these the long one


def test_papers(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<S><PubmedArticle><PMID>7</PMID><ArticleTitle>Zn <i>O</i> x</ArticleTitle><Abstract><AbstractText>One part</AbstractText><AbstractText>was heated.</AbstractText></Abstract><Author><LastName>Doe</LastName><ForeName>Ann</ForeName></Author><PubDate><Year>2020</Year></PubDate><ArticleId IdType='doi'>10.1/A</ArticleId><ArticleId IdType='pmc'>PMC1</ArticleId></PubmedArticle><PubmedArticle><ArticleTitle></ArticleTitle></PubmedArticle></S>")
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.1v2</id><title>On\n  things</title><summary>Was stirred and refluxed.</summary><author><name>B C</name></author><published>2021-01-01</published><link title="doi" href="10.1/b"/></entry></feed>')
    (tmp_path / "o.json").write_text(json.dumps({"results": [{"id": "W1", "display_name": "Work", "doi": "https://doi.org/10.1/C", "open_access": {"is_oa": True}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}, {"title": ""}]}))
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"paperId": "x", "title": "T", "externalIds": {"DOI": "10.1/D"}}]}))
    landed = dumps.land(spark, {"pubmed": str(tmp_path / "p.xml"), "arxiv": str(tmp_path / "a.xml"), "openalex": str(tmp_path / "o.json"), "semantic_scholar": str(tmp_path / "missing.json")})
    rows = {r.source_db: r for r in landed.papers.collect()}
    assert [r.source_db for r in landed.faults.collect()] == ["semantic_scholar"] and len(rows) == 3 and landed.counts == {"pubmed": (1, 0), "arxiv": (1, 0), "openalex": (1, 0), "semantic_scholar": (0, 1)}
    p = rows["pubmed"]
    assert (p.title, p.doi, p.pubmed_central_id, p.authors, p.year, p.abstract, p.open_access, p.has_experimental_section) == ("Zn O x", "10.1/a", "PMC1", ["Ann Doe"], 2020, "One part was heated.", True, True)
    a = rows["arxiv"]
    assert (a.title, a.arxiv_id, a.doi, a.year, a.open_access_url, a.has_experimental_section) == ("On things", "2101.1", "10.1/b", 2021, "https://ar5iv.org/abs/2101.1", True)
    assert (rows["openalex"].title, rows["openalex"].abstract, rows["openalex"].open_access_url, rows["openalex"].doi) == ("Work", "a b a", "W1", "10.1/c")
    assert dumps.semantic_scholar(spark, str(tmp_path / "s.json")).first().open_access_url.endswith("/x")


def test_merge_prefers_the_richer(spark):
    rows = [(1, "T", "10.1/x", "openalex", 0, None, None), (2, "T long", "10.1/x", "semantic_scholar", 5, 2020, "abstract")]
    got = dedup.exact_dedup(spark.createDataFrame(rows, "ord long, title string, doi string, source_db string, citation_count int, year int, abstract string")).first()
    assert (got.title, got.source_db, got.n_merged) == ("T long", "semantic_scholar+openalex", 2)


def test_merge_of_many_records(spark):
    """Hundreds of records of a key, folded one by one in Python; few of them come to the fold."""
    rng = random.Random(6)
    some = lambda *c: rng.choice([None, *c])
    fields = ("title", "doi", "source_db", "citation_count", "year", "abstract")
    rows = [(i, some("", f"t{i}"), f"10.1/{rng.choice([0, 0, 0, 1, 2])}", some("", "a", "b", "c"), some(0, i), some(2000 + i % 9), some(f"abstract {i}", "")) for i in rng.sample(range(5000), 700)]
    want = {}
    empty = lambda x: x is None or x == ""
    for r in sorted(rows):
        new = dict(zip(("ord", *fields), r))
        old = want.get(new["doi"])
        if old is None:
            want[new["doi"]] = {**new, "n": 1}
            continue
        rich = lambda p: sum(not empty(p[f]) for f in fields if f != "doi")
        one, two = (old, new) if rich(old) >= rich(new) else (new, old)
        out = {f: two[f] if empty(one[f]) else one[f] for f in fields}
        if one["source_db"] is not None and two["source_db"] is not None and one["source_db"] != two["source_db"]:
            out["source_db"] = "+".join(dict.fromkeys(f"{one['source_db']}+{two['source_db']}".split("+")))
        want[new["doi"]] = {**out, "ord": old["ord"], "n": old["n"] + 1}
    got = dedup.exact_dedup(spark.createDataFrame(rows, "ord long, title string, doi string, source_db string, citation_count int, year int, abstract string")).collect()
    assert {r.doi: (r.ord, r.n_merged, *(r[f] for f in fields)) for r in got} == {k: (v["ord"], v["n"], *(v[f] for f in fields)) for k, v in want.items()}


def test_uploaded_documents(spark):
    """Sections with enough words, the first ten; long ones in windows; densest paragraphs where there is no section."""
    words = lambda n, w="word": " ".join([w] * n)
    many = "\n".join(f"2.{k} Synthesis of sample\n{words(60) + ' zinc' * (k == 29) if k % 2 else 'short'}" for k in range(1, 31))
    rows = [(1, f"## Experimental\n{words(3200)}\n# Results", "/up/my_file-1.pdf", None), (2, many, "/up/two.pdf", "Hint"), (3, f"{words(60)}\n\n{words(5, 'zinc')} {words(60)}\n\nshort\n\n{words(9, 'zinc')} {words(600)}", "three", None), (4, None, "/x.md", None)]
    got = chunking.uploaded_chunks(spark.createDataFrame(rows, "doc_id long, text string, path string, hint string"), "doc_id", "text", "path", "hint", vocabulary=["zinc"]).collect()
    found = {i: [(r.section, r.n_words, r.title) for r in sorted(got, key=lambda r: r.place) if r.doc_id == i] for i in (1, 2, 3, 4)}
    assert found[1] == [("Experimental", 1500, "my file 1"), ("Experimental_part_2", 1500, "my file 1"), ("Experimental_part_3", 504, "my file 1")]
    assert [s for s, _, _ in found[2]] == [f"2.{k} Synthesis of sample" for k in (29, *range(1, 18, 2))] and {t for _, _, t in found[2]} == {"Hint"}
    assert found[3] == [("paragraph_1", 65, "three"), ("paragraph_3", 609, "three")] and found[4] == []
    assert {(r.source_db, r.open_access, r.completeness, r.method) for r in got} == {("user_upload", True, "FULL_TEXT", "USER_UPLOAD")}


def test_notes_tell_warnings_and_methods(spark):
    schema = f"recipe_id long, validation_status string, title string, source_paper_title string, source_paper_doi string, validation_warnings array<struct<error_type:string,field_path:string,message:string>>, node_extraction_methods map<string,string>, entities array<struct<pos:int,name:string,role:string,quantity:{QUANTITY},moles:{QUANTITY}>>, conditions struct<temperature_celsius:double,duration_hours:double,technique:string,atmosphere:string,pressure_atm:double>"
    row = (7, "PASSED", None, "P" * 70, "10.1/x", [("QUANTITY_MISSING", "entities[0]", "no\n  amount"), (None, None, None)], {"b": "MODEL", "a": "RULES"}, [(0, "Zinc", "REACTANT", (1.5, "g"), (10.0, "mmol")), (1, "Water", "SOLVENT", None, None)], (-5.0, 2.0, "sol gel", None, 1.0))
    note = notes.recipe_notes(spark.createDataFrame([row], schema))
    text = note.first().content
    for line in ("# Reaction 7", "| [[Zinc]] | 1.5 g | 10.0 mmol | REACTANT |", "| [[Water]] | - | - | SOLVENT |", "| Technique | sol gel |", "| Atmosphere | unknown |", "| Pressure | 1.0 atm |", "warning_count: 2", f"**Source:** [[{'P' * 60}]]", "DOI: 10.1/x",
                 "- **QUANTITY_MISSING** (`entities[0]`): no amount", "- **WARNING** (`unknown field`): ", "- a: RULES\n- b: MODEL", "#reaction #sol_gel #unknown"):
        assert f"\n{line}\n" in f"\n{text}\n", line
    for content in (text, text.split("```")[0] + "\n#x"):
        back = notes.parsed_notes(spark.createDataFrame([(content,)], "content string")).first()
        assert [(e.name, e.role, e.quantity and tuple(e.quantity), e.moles and tuple(e.moles)) for e in back.entities] == [("Zinc", "REACTANT", (1.5, "g"), (10.0, "mmol")), ("Water", "SOLVENT", None, None)]
        assert (back.temperature_celsius, back.duration_hours, back.pressure_atm, back.technique, back.atmosphere) == (-5.0, 2.0, 1.0, "sol gel", None)
        assert [w.error_type for w in back.validation_warnings] == ["QUANTITY_MISSING", None if content == text else "WARNING"]
    bare = notes.recipe_notes(spark.createDataFrame([row], schema).select("recipe_id", "validation_status", "entities", "conditions")).first().content
    assert "No validation warnings." in bare and "No extraction method metadata." in bare and "Paper: Unknown source" in bare


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


def test_fuzzy_titles_as_one_by_one(spark):
    rng = random.Random(5)
    stems = ["synthesis of zinc oxide nanoparticles in water", "iron oxide particles by reflux", "on titanium dioxide films", "a"]
    papers = []
    for i in range(60):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcdefg ")
        papers.append((i, "".join(t), f"10.1/{i % 9}" if i % 4 == 0 else None, "s", 0, 2000, None))
    df = spark.createDataFrame(papers, "ord long, title string, doi string, source_db string, citation_count int, year int, abstract string")
    got = {r.ord: r.leader for r in dedup.fuzzy_leaders(df).collect()}
    norm = lambda t: " ".join(t.lower().split())
    groups = {r.ord: norm(r.title) for r in dedup.exact_dedup(df).collect()}
    leaders, want = {}, {o: o for o in groups}
    for o, t, doi, *_ in papers:
        if doi is None:
            t = norm(t)
            lead = next((g for g in sorted(groups) if t and groups[g] and lcs_ratio(t, groups[g]) >= 88), None)
            lead = lead if lead is not None else next((g for g in sorted(leaders) if t and leaders[g] and lcs_ratio(t, leaders[g]) >= 88), None)
            if lead is None:
                leaders[o] = t
            want[o] = o if lead is None else lead
    assert got == want
    assert titles.ratio("abcd", "abxd", 70) == pytest.approx(lcs_ratio("abcd", "abxd"))


def test_urls(spark):
    assert one(spark, urls.doi(F.col("u")), u="https://doi.org/10.1234/abc).") == "10.1234/abc"
    assert one(spark, urls.normalize(F.col("u")), u="https://arxiv.org/abs/2101.00001v3") == "https://ar5iv.org/abs/2101.00001"
    assert one(spark, urls.publisher(F.col("u")), u="https://www.nature.com/x") == "Nature/Springer"
    assert one(spark, urls.link(F.col("u")), u="javascript:alert(1)") == "invalid source URL"
    assert [one(spark, urls.input_error(F.col("u"), F.lit("<p>x</p>"), F.lit(5)), u=u) for u in ("ftp://x", "https://pubs.acs.org/x", "https://x.org")] == ["INVALID_URL", "PAYWALL_DETECTED", "EXTRACTION_FAILED"]


def test_page_article(spark):
    body = "<p>" + "word " * 120 + "</p>"
    html = f"<html><title>T</title><nav>menu</nav><article><h2>Synthesis of ZnO</h2>{body}<script>x</script></article><footer>foot</footer></html>"
    row = pages.articles(spark.createDataFrame([(1, "https://x.org/a", html)], "page_id long, url string, html string")).first()
    assert row.ok and row.title == "T" and "menu" not in row.text and "foot" not in row.text and row.text.startswith("Synthesis of ZnO\n\nword")
    got = pages.page_sections(spark.createDataFrame([(1, row.text)], "page_id long, text string")).collect()
    assert len(got) == 1 and got[0].priority == 4


def test_notes_and_store(spark, tmp_path):
    df = spark.createDataFrame([(7, "PASSED", [(0, "Zinc", "REACTANT", (1.0, "g"), None)], (50.0, 2.0))], f"recipe_id long, validation_status string, entities array<struct<pos:int,name:string,role:string,quantity:{QUANTITY},moles:{QUANTITY}>>, conditions struct<temperature_celsius:double,duration_hours:double>")
    note = notes.recipe_notes(df.withColumn("conditions", F.struct("conditions.*", F.lit(None).cast("double").alias("pressure_atm"))))
    plain = note.withColumn("content", F.regexp_replace("content", "(?s)```.*?```", ""))
    for n in (note, plain):
        back = notes.parsed_notes(n).first()
        assert (back.recipe_id, [(e.name, e.role) for e in back.entities], back.temperature_celsius, back.ok) == ("7", [("Zinc", "REACTANT")], 50.0, True)
    events.write_recipes(df, str(tmp_path / "store"))
    assert events.recipe(spark, str(tmp_path / "store"), 7).count() == 1
    log = spark.createDataFrame([("stored", 1)], "stage string, chunks int")
    events.append_events(log, str(tmp_path / "log"))
    assert events.read_events(spark, str(tmp_path / "log")).first().stage == "stored"


def test_graph_width_counts_writes(spark):
    rows = [(1, 0, "A b", "REACTANT"), (1, 1, "C", "SOLVENT"), (2, 0, "A b", "REACTANT"), (2, 1, "C", "SOLVENT"), (2, 2, "P", "PRODUCT")]
    df = spark.createDataFrame(rows, "recipe_id int, pos int, name string, role string")
    edge = graph.cooccurrence_edges(df).first()
    assert (edge.source, edge.target, edge.weight, edge.width, edge.n_recipes) == ("chem::a_b", "chem::c", 2.0, 1.0, 2)
    assert graph.solvents_for_products(df).first().percentage == 100.0
    assert metrics.snapshot(spark.createDataFrame([], "validation_status string, correction_count int, total_tokens int, cost_usd double, latency_seconds double")).first().total_recipes == 0
