import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import assess, compare, labels, lines, manifest, paragraphs, sampling, scale, variants
from foliospark.sources import files, jats
from foliospark.streaming import resume


def read(spark, pages, normalise=True):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages, 1)], "doc_id string, page int, text string")
    return lines.mark_edges(lines.strip_line_numbers(lines.split_pages(df, normalise)))


def segments(spark, pages):
    return paragraphs.segments(lines.split_references(lines.drop_running(read(spark, pages))))


def as_tuples(df, *cols):
    return [tuple(r) for r in df.orderBy("seg_order").select(*cols).collect()]


def test_paragraphs_fold(spark):
    page = "The adsorp-\ntion was fast.\nFig. 2 shows the flux.\nFig. 3 SEM images of the membrane.\nNext sentence\ncontinues here."
    got = as_tuples(segments(spark, [page]), "text", "first", "last", "kind")
    assert got == [("The adsorption was fast.", 0, 1, "body"), ("Fig. 2 shows the flux.", 2, 2, "body"), ("Fig. 3 SEM images of the membrane.", 3, 3, "caption"), ("Next sentence continues here.", 4, 5, "body")]


def test_headers_references_and_failed_pages(spark):
    body = "The flow was set to {0} in the cell.\nIt stayed there for {0} hours or so."
    pages = [f"Journal of Things\n{body.format(i)}\n{i + 40}" for i in range(1, 4)] + ["Journal of Things\nReferences\nLee, A. Paper 2001.\n44", None]
    got = as_tuples(segments(spark, pages), "kind", "text")
    assert ("heading", "References") in got and ("reference", "Lee, A. Paper 2001.") in got
    assert not any("Journal" in t or t.isdigit() for _, t in got)
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages, 1)], "doc_id string, page int, text string")
    assert lines.failed_pages(df).first().asDict() == {"doc_id": "d", "pages_total": 5, "pages_failed": [5]}


def test_two_pages_have_no_running_lines(spark):
    assert lines.running_keys(read(spark, ["Head\na", "Head\nb"])).count() == 0


def test_line_numbers(spark):
    numbered = "\n".join(f"{i} text of line" for i in range(1, 15))
    table = "\n".join(f"{i * 7} value here" for i in range(1, 15))
    got = read(spark, [numbered, table]).orderBy("page", "line").collect()
    assert {r["text"] for r in got if r["page"] == 1} == {"text of line"}
    assert all(r["text"][0].isdigit() for r in got if r["page"] == 2)


def test_equation_heading_and_traces_once(spark):
    page = "Text with CO₂ and more g⁻¹ was read.\nk₂ = a (7) where the rest holds.\n2.1 Materials\nOf all kinds."
    ls = read(spark, [page], normalise=False)
    seg = paragraphs.segments(lines.split_references(lines.drop_running(ls)))
    got = as_tuples(paragraphs.with_traces(seg, ls), "kind", "text", "traces", "loc")
    assert [(k, t) for k, t, _, _ in got] == [("body", "Text with CO₂ and more g⁻¹ was read."), ("formula", "k₂ = a (7)"), ("body", "where the rest holds."), ("heading", "2.1 Materials"), ("body", "Of all kinds.")]
    assert [t for _, _, t, _ in got] == [{"unicode_subsup": 3}, {"unicode_subsup": 1}, {}, {}, {}]
    source = {r["seg_order"]: r["source"] for r in paragraphs.source_text(seg, ls).collect()}
    assert source[1] == source[2] == "k₂ = a (7) where the rest holds." and got[0][3] == "p1:L0-0"


def test_front_and_back_matter(spark):
    page = "A Great Title\n\nLee and Kim\n\nAbstract\nWe did it well.\n\nAcknowledgments\nWe thank them all.\n\n4. Outlook\nMore to come here.\n\nFunding: none at all.\n\nReferences\nLee 2001."
    got = as_tuples(paragraphs.mark_front_matter(paragraphs.mark_back_matter(segments(spark, [page]))), "kind", "text")
    kinds = {t: k for k, t in got}
    assert kinds["A Great Title"] == kinds["Lee and Kim"] == "front_matter"
    assert kinds["We thank them all."] == kinds["Funding: none at all."] == "back_matter"
    assert kinds["We did it well."] == kinds["More to come here."] == "body" and kinds["Lee 2001."] == "reference"


@pytest.mark.parametrize(
    ("text", "failed", "want"),
    [
        ("the flow of water is in a cell " * 60, [], "completed"), ("the flow of water is in a cell " * 60, [2], "partial"), ("the flow of water", [], "too_short"), ("der und die nicht das " * 90, [], "out_of_scope"), ("12 34", [], "extraction_failed"), ("вода течёт в ячейке the of and " * 90, [], "out_of_scope"),
    ],
)
def test_status(spark, text, failed, want):
    seg = spark.createDataFrame([("d", "body", text)], "doc_id string, kind string, text string")
    docs = spark.createDataFrame([("d", failed)], "doc_id string, pages_failed array<int>")
    assert assess.assess(seg, docs).first()["status"] == want


def test_summaries_hold_no_text(spark):
    seg = spark.createDataFrame([("d", "body", "Water = a (3) flows fast", 1, {"latex": 2}), ("d", "body", "it [FORMULA]", 1, None), ("d", "heading", "Secret", 2, {})], "doc_id string, kind string, text string, page int, traces map<string,int>")
    for df in (assess.summarize(seg), assess.inspect(seg)):
        assert not any(isinstance(v, str) and len(v) > 20 or v == "Secret" for v in df.first())
    r = assess.summarize(seg).first()
    assert (r["body_words"], r["placeholders"], r["n_body"], r["n_heading"], r["body_trace_latex"]) == (5, 1, 2, 1, 2)
    i = assess.inspect(seg).first()
    assert (i["median_words"], i["starting_small"], i["equation_like"], i["with_traces"]) == (4, 1, 1, 1)
    docs = spark.createDataFrame([("d", 3), ("e", 0)], "doc_id string, pages_total int")
    assert {r["doc_id"]: r["pages"] for r in assess.pages_without_body(seg, docs).collect()} == {"d": [2, 3], "e": []}


RECORD = "line_no int, doc_id string, bundle_id string, truth_basis string, rest_basis string, acts array<string>, spans array<struct<act:string,loc:string,lang:string>>, target_present string, stages map<string,string>"


@pytest.mark.parametrize(
    ("basis", "rest", "acts", "want"),
    [
        ("A", None, ["proofreading"], "no no no yes"), ("A", None, ["translation", "rewriting"], "yes yes no no"), ("A", None, ["machine_translation"], "no no yes no"), ("A", None, ["search_ideation"], "no no no no"), ("A", None, [], "no no no no"), ("D", None, [], "no no unknown no"),
        ("C", None, ["unknown"], "unknown unknown unknown unknown"), ("B", None, ["generation"], "yes unknown unknown unknown"), ("A", "D", ["rewriting"], "yes no unknown no"), ("A", None, ["unknown", "generation"], "yes unknown unknown unknown"), (None, None, None, "unknown unknown unknown unknown"),
    ],
)
def test_stage_verdicts(spark, basis, rest, acts, want):
    df = spark.createDataFrame([(1, "d", "b", basis, rest, acts, None, None, None)], RECORD)
    got = labels.with_stages(df).first()["derived"]
    assert " ".join(got[k] for k in ("body", "ai_translation", "machine_translation", "ai_polishing")) == want


def test_label_errors_in_order(spark):
    rows = [
        (1, " ", None, "D", None, ["generation", "generation"], [("mixed", "", "de")], "no", {"body": "no", "other": "yes"}),
        (2, "x", "b", "A", None, [], None, None, None), (3, "x", "b", "Z", None, ["odd"], [], "", {}),
    ]
    got = [(r["line_no"], r["rule_no"]) for r in labels.label_errors(spark.createDataFrame(rows, RECORD)).collect()]
    assert [n for line, n in got if line == 1] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert [n for line, n in got if line == 2] == [] and [n for line, n in got if line == 3] == [10, 11, 12]
    assert labels.label_errors(spark.createDataFrame([], RECORD)).count() == 0


def test_manifest_errors(spark):
    schema = "line_no int, doc_id string, bundle_id string, role string, path string, sha256 string"
    rows = [(1, "a", "b1", "seed", "p1", "h1"), (2, "a", "b1", "variant", "p2", "h2"), (3, "v", "b9", "variant", "p3", "h3"), (4, None, "", "boss", "p1", "h1")]
    fs = spark.createDataFrame([("p1", "h1"), ("p2", "other")], "path string, sha256 string")
    got = sorted((r["line_no"], r["rule"]) for r in manifest.manifest_errors(spark.createDataFrame(rows, schema), fs).collect())
    assert got == [(2, "doc_id_repeated"), (2, "hash_differs"), (3, "bundle_without_seed"), (3, "file_missing"), (4, "id_empty"), (4, "role_value")]


@pytest.mark.parametrize("n", [-1, 0, 1, 7, 10, 33, 100, 101, 500])
def test_quotas(spark, n):
    rows = [("A2017", 3), ("A2018", 50), ("B2018", 47), ("C2021", 1)]
    got = sampling.allocate(spark.createDataFrame(rows, "name string, size long"), n, "name").collect()
    assert sum(r["quota"] for r in got) == max(0, min(n, 101)) and all(0 <= r["quota"] <= r["size"] for r in got)


def test_queues_and_draw_ignore_input_order(spark):
    rows = [(f"p{i:02}", "AB"[i % 2], 2018) for i in range(40)]
    a, b = (spark.createDataFrame(x, "k string, journal string, year int") for x in (rows, rows[::-1]))
    for make in (lambda d: sampling.queues(d, ["journal", "year"], "k", 3), lambda d: sampling.draw(d, ["journal", "year"], "k", 11, 3)):
        assert sorted(map(tuple, make(a).collect())) == sorted(map(tuple, make(b).collect()))
    assert sampling.draw(a, ["journal", "year"], "k", 11, 3).count() == 11


def test_sliced_ranking_against_plain(spark):
    random.seed(6)
    rows = [(i, random.choice("ab") if i % 3 else None, random.random(), random.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, u double, v int").withColumn("q", F.lit(50))
    got = scale.smallest_keys(df, ["g"], "u", ["id"], "q", slices=16).collect()
    for g in ("a", "b", None):
        want = sorted((r[2], r[0]) for r in rows if r[1] == g)[:50]
        assert sorted((r["u"], r["id"]) for r in got if r["g"] == g) == want
    sums = {r["id"]: r["before"] for r in scale.running_totals(df, ["g"], "u", ["id"], F.col("v"), "before", slices=16).collect()}
    for g in ("a", "b", None):
        total = 0
        for _, i, v in sorted((r[2], r[0], r[3]) for r in rows if r[1] == g):
            assert sums[i] == total
            total += v


def test_running_stop(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 5.0), (3, 2.0), (4, 0.1), (5, None)], "n int, cost double")
    assert [r["n"] for r in sampling.running_stop(df, "n", "cost", 10.0).orderBy("n").collect()] == [1, 2]


TARGET = "seed_id string, title string, abstract string, locs array<string>, paragraphs array<string>"


def test_plan_build_and_relabel(spark):
    t = spark.createDataFrame([("s1", "T", None, ["l1", "l2"], ["One. Two. Three.", "Four. Five."]), ("s2", "U", "A", ["l1"], ["Six."])], TARGET)
    plan = variants.plan_tasks(t, ("x", "y"), 1).collect()
    assert len(plan) == 10 and {r["model_family"] for r in plan} == {"x", "y"} and all(len(r["steps"]) == (2 if r["act"] == "translation" else 1) for r in plan)
    mixed = next(r for r in plan if r["act"] == "mixed" and r["seed_id"] == "s1")
    assert mixed["kept_prefix"] == ["One. Two.", "Four."] and "Three" not in mixed["steps"][0]
    tasks = variants.plan_tasks(t, ("x", "y"), 1)
    outs = spark.createDataFrame([(mixed["variant_id"], ["C1.\n\nC2."], "2026-01-01T00:00:00Z"), (mixed["variant_id"], ["old"], "2025-01-01T00:00:00Z")], "variant_id string, step_outputs array<string>, created_at string")
    built = {r["variant_id"]: r for r in variants.build(tasks, outs).collect()}
    assert built[mixed["variant_id"]]["paragraphs"] == ["One. Two. C1.", "Four. C2."]
    assert sum(r["status"] == "no_output" for r in built.values()) == 9
    assert variants.remaining(tasks, outs).count() == 9
    rows = spark.createDataFrame([("proofreading", 1.0, 0), ("proofreading", 0.5, 0), ("proofreading", 0.95, 1), ("rewriting", 0.98, 0), ("mixed", 0.1, 3)], "act string, similarity double, sentence_delta int")
    assert [(r["label_act"], r["changed"]) for r in variants.relabel(rows).collect()] == [("proofreading", False), ("rewriting", True), ("rewriting", True), ("proofreading", True), ("mixed", True)]


def test_targets(spark):
    long = "word " * 60
    rows = [("d", i, "body", "1. Introduction", f"p{i}", long) for i in range(4)] + [("e", i, "body", "Introduction", f"p{i}", long + "[FORMULA]") for i in range(3)] + [("f", 0, "body", "Introduction", "p", long)]
    got = variants.find_targets(spark.createDataFrame(rows, "doc_id string, seg_order int, kind string, section string, loc string, text string")).collect()
    assert [(r["doc_id"], r["locs"]) for r in got] == [("d", ["p0", "p1", "p2"])]


def test_upsert(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, variants.upsert(a, b, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


ARTICLE = """<article><front><article-meta><abstract abstract-type="graphical"><p>No</p></abstract><abstract><p>CO<sub>2</sub> capture <inline-formula>x</inline-formula> works.</p></abstract></article-meta></front>
<body><sec><title>1. Introduction</title><p>First <xref>1</xref> text.<table-wrap><label>T</label></table-wrap> Tail.</p><disp-formula>y</disp-formula><fig><caption><p>Fig text</p></caption></fig><list><list-item><p>Item</p></list-item></list></sec>
<sec><title>Author Contributions</title><p>All did.</p></sec><sec sec-type="glossary"><p>Terms</p></sec></body><back><ref-list><ref><mixed-citation>Lee 2001</mixed-citation></ref></ref-list></back></article>"""


def test_jats(spark):
    fs = spark.createDataFrame([("d", ARTICLE), ("bad", "<a>\n<b></a>"), ("null", None), ("empty", "<article/>")], "doc_id string, content string")
    seg, failed = jats.read_jats(fs)
    got = as_tuples(seg, "kind", "text", "section", "loc")
    assert got == [
        ("body", "CO2 capture [FORMULA] works.", "Abstract", "front[1]/article-meta[1]/abstract[2]/p[1]"), ("heading", "1. Introduction", "1. Introduction", "body[1]/sec[1]/title[1]"), ("body", "First 1 text. Tail.", "1. Introduction", "body[1]/sec[1]/p[1]"), ("table", "T", "1. Introduction", "body[1]/sec[1]/p[1]/table-wrap[1]"),
        ("formula", "[FORMULA]", "1. Introduction", "body[1]/sec[1]/disp-formula[1]"), ("caption", "Fig text", "1. Introduction", "body[1]/sec[1]/fig[1]"), ("body", "Item", "1. Introduction", "body[1]/sec[1]/list[1]/list-item[1]"), ("heading", "Author Contributions", "Author Contributions", "body[1]/sec[2]/title[1]"),
        ("back_matter", "All did.", "Author Contributions", "body[1]/sec[2]/p[1]"), ("back_matter", "Terms", "", "body[1]/sec[3]/p[1]"), ("reference", "Lee 2001", "References", "back[1]/ref-list[1]/ref[1]"),
    ]
    assert {(r["doc_id"], r["broken_line"]) for r in failed.collect()} == {("bad", 2), ("null", 1)}


def test_broken_xml_looks_at_all_texts(spark, tmp_path):
    import xml.etree.ElementTree as ET

    from foliospark.plans import catalog

    rows = [(1, "<article><body/></article>"), (2, "<article><body></article>"), (3, "no markup"), (4, None), (5, ""), (6, "<a>&none;</a>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def broken(text):
        try:
            ET.fromstring(text)
        except ET.ParseError:
            return True

    assert {r["doc_id"] for r in catalog.QUERIES["broken_xml"](spark, str(tmp_path)).collect()} == {i for i, t in rows if t is not None and broken(t)}


def test_json_lines(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "in.jsonl").write_text('{"doc_id": "a", "n": 1}\n\nnot json\n[1]\n{"doc_id": "b", "x": 2}\n{"n": 3}\n', encoding="utf-8")
    ok, bad = files.parse_lines(files.read_json_lines(spark, str(tmp_path / "in.jsonl")), schema, ["doc_id"])
    assert [(r["line_no"], r["doc_id"], r["n"]) for r in ok.collect()] == [(1, "a", 1)]
    assert sorted((r["line_no"], r["code"]) for r in bad.collect()) == [(3, "not_json"), (4, "not_an_object"), (5, "unknown_key"), (6, "missing_key")]
    assert files.read_json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    files.write_json_lines(ok, str(tmp_path / "out"), ["doc_id", "n"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"doc_id":"a","n":1}']
    with pytest.raises(ValueError):
        files.write_json_lines(ok, str(tmp_path / "out"), ["doc_id"], source=str(tmp_path / "out/"))


def test_files(spark, tmp_path):
    for name in ("a.XML", "a.pdf", "b.docx"):
        (tmp_path / name).write_text("x")
    got = {r["path"][-6:]: r for r in files.dispatch(files.read_files(spark, str(tmp_path))).collect()}
    assert got["/a.XML"]["reader"] == "jats" and got["/a.pdf"]["fmt"] == "pdf" and got["b.docx"]["reader"] == "none"
    assert got["/a.pdf"]["sha256"].startswith("2d711642")
    assert files.pairs_by_stem(files.read_files(spark, str(tmp_path), "*.XML"), files.read_files(spark, str(tmp_path), "*.pdf")).count() == 1


def test_compare(spark):
    t = spark.createDataFrame([("d", "alpha beta Fe3O4 gamma", "ref one two three four five six seven eight"), ("e", None, None)], "doc_id string, body string, reference string")
    o = spark.createDataFrame([("d", "alpha beta Fe3O4 delta ref one two three four five six seven eight", None)], "doc_id string, body string, reference string")
    got = {r["doc_id"]: r for r in compare.compare(t, o).collect()}
    assert got["d"]["recall"] == 0.75 and got["d"]["chem"] == 1.0 and got["d"]["ref_leak"] == 1.0 and got["e"]["recall"] == 0.0


def test_resumed_stream(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("variant_id", T.StringType()), T.StructField("text", T.StringType())])
    (tmp_path / "in").mkdir()
    for name, rows in (("1.json", ["a", "b", "a"]), ("2.json", ["b", "c"])):
        (tmp_path / "in" / name).write_text("".join(f'{{"variant_id": "{r}", "text": "t"}}\n' for r in rows))
        q = resume.run_resumed(resume.task_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "log"), str(tmp_path / "cp"), lambda d: d)
        q.awaitTermination(60)
    assert sorted(r["variant_id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["a", "b", "c"]


def test_spanning_forest_connects_what_the_edges_connect(spark):
    from foliospark.operators.components import spanning_forest

    rng = random.Random(4)
    edges = [(f"{rng.randint(0, 80):03}", f"{rng.randint(0, 80):03}") for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(50)]
    labels, forest = spanning_forest(spark.createDataFrame(edges + edges[:5] + [("x", None)], "a string, b string"))
    root, chosen = {r["node"]: r["root"] for r in labels.collect()}, [tuple(r) for r in forest.collect()]

    def groups(pairs):
        of = {}
        for a, b in pairs:
            if a != b:
                merged = of.get(a, {a}) | of.get(b, {b})
                of.update(dict.fromkeys(merged, merged))
        return {frozenset(g) for g in of.values()}

    assert groups(chosen) == groups(edges)
    assert set(chosen) <= {tuple(sorted(e)) for e in edges} and len(chosen) == len(set(chosen)) == len(root) - len(set(root.values()))
    assert {frozenset(n for n in root if root[n] == r) for r in root.values()} == groups(edges)
    empty, none = spanning_forest(spark.createDataFrame([("x", "x")], "a string, b string"))
    assert empty.count() == 0 and none.count() == 0


def test_target_is_in_the_first_introduction(spark):
    long = "word " * 60
    at = lambda sec, what, n: f"body[1]/sec[{sec}]/{what}[{n}]"
    rows = [("a", 0, "heading", "Introduction", at(1, "title", 1), "Introduction")] + [("a", i, "body", "Introduction", at(1, "p", i), long) for i in (1, 2)] + [("a", 3 + i, "body", "Introduction", at(4, "p", i), long) for i in (1, 2, 3)]
    rows += [("b", 0, "body", "1 Introduction", at(2, "list", 1) + "/list-item[1]", long), ("b", 1, "body", "1 Introduction", "body[1]/sec[2]/sec[1]/p[1]", long)] + [("b", 1 + i, "body", "1 Introduction", at(2, "p", i), long) for i in (1, 2, 3, 4)]
    got = variants.find_targets(spark.createDataFrame(rows, "doc_id string, seg_order int, kind string, section string, loc string, text string")).collect()
    assert [(r["doc_id"], r["locs"]) for r in got] == [("b", [at(2, "p", i) for i in (1, 2, 3)])]


def test_labels_are_saved_only_if_all_are_right(spark, tmp_path):
    schema = "doc_id string, bundle_id string, truth_basis string, acts array<string>, spans array<struct<act:string,loc:string,lang:string>>, rest_basis string, target_present string, stages map<string,string>"
    good, bad = ("a", "b-1", "A", ["rewriting"], [("rewriting", "p1:L0-1", "en")], None, None, None), ("c", "", "D", ["rewriting"], [], None, "yes", None)
    with pytest.raises(ValueError, match="c: bundle_id_blank"):
        labels.save_labels(spark.createDataFrame([good, bad], schema), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    labels.save_labels(spark.createDataFrame([good], schema), str(tmp_path / "out"))
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert '"target_present":"yes"' in line and '"ai_polishing":"no"' in line


def test_issues_of_pages(spark):
    frame = lambda n, text: f"Head of all {n}\n{text}\nmore\nand more\n{n + 4}"
    pages = [("a", n, frame(n, "de\ue103ned \ue200 thing" if n == 1 else "plain text")) for n in (1, 2, 3)] + [("a", 4, None), ("b", 1, "References\n1 One."), ("c", 1, None)]
    pages = spark.createDataFrame(pages, "doc_id string, page int, text string")
    seg, marked = paragraphs.read_pages(pages)
    got = {(r["doc_id"], r["code"]): r["n"] for r in lines.line_issues(pages, marked).unionByName(assess.segment_issues(seg, lines.failed_pages(pages))).collect()}
    want = {("a", "glyphs_repaired"): 1, ("a", "glyphs_broken"): 1, ("a", "running_lines"): 2, ("a", "page_numbers"): 1, ("a", "references_not_found"): 1, ("a", "front_not_found"): 1, ("a", "out_of_scope"): 1, ("a", "failed_pages"): 1}
    assert want.items() <= got.items() and ("b", "references_not_found") not in got and got[("c", "no_body")] == 1


def test_json_lines_with_something_behind(spark):
    from pyspark.sql import types as T

    rows = [(i, v) for i, v in enumerate(['{"k": "a"}', '{"k": "a"}}', '{"k": "a"} x', '{"k": "a"}]', '{"k": "a"}, {"k": "b"}', '{"k": "a"'])]
    ok, bad = files.parse_lines(spark.createDataFrame([("f", i, v) for i, v in rows], "file string, line_no int, value string"), T.StructType([T.StructField("k", T.StringType())]), [])
    assert [r["line_no"] for r in ok.collect()] == [0] and {r["line_no"]: r["code"] for r in bad.collect()} == {i: "not_json" for i in range(1, 6)}
