import difflib
import random

import pytest

llm = pytest.importorskip("foliospark.llm")

from foliospark.llm import langmodel, p1_pairs, p2_sample, p3_splits, p4_sentences, p5_forms, p6_markup, p7_encode, p8_leaks, p9_language, textform  # noqa: E402

# ---------------------------------------------------------------- p1

TASKS = "variant_id string, seed_id string, act string, steps array<string>, extra string, `defect` string"
OUTPUTS = "variant_id string, step_outputs array<string>, created_at string, prompt string"
PARAS = ["The flow was set to {0} K in the stirred cell. It stayed there for an hour.", "Heat losses of {0} W were seen at the wall. They fell when the load rose.", "A model of {0} terms fits these data. Its residuals are small."]
WHOLE = "\n\n".join(PARAS)


def pairs(spark, rows):
    tasks = [(v, s, a, st, "x", "y") for v, s, a, st, _ in rows]
    outputs = [(v, o, "2026-02-01T00:00:00+00:00", "z") for v, _, _, _, o in rows]
    got = p1_pairs.defects(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(outputs, OUTPUTS)).collect()
    return {(r["variant_id"], r["step_no"]): r["defect"] for r in got}


def test_defects(spark):
    ask = "Reword this text. Answer with three paragraphs.\n\n" + WHOLE.format(1)
    fine = WHOLE.format(2).replace("flow", "stream").replace("Heat", "Some heat").replace("model", "simple model") + " All of this was to be expected from older work on other cells."
    rows = [(f"r{i}", f"s{i}", "rewriting", [ask], ["I'm sorry, but I can't help with that request."]) for i in range(3)]
    rows += [
        ("empty", "a", "rewriting", [ask], ["​ \n"]), ("null", "a", "rewriting", [ask], [None]), ("short list", "a", "rewriting", [ask, ask], [fine]), ("no list", "a", "rewriting", [ask], None),
        ("copy", "a", "rewriting", [ask], ["Sure, here you go:\n\n" + WHOLE.format(1)]), ("proof", "a", "proofreading", [ask], [WHOLE.format(1)]), ("proof all", "a", "proofreading", [ask], [ask]),
        ("german", "a", "rewriting", [ask], ["\n\n".join(["Die Proben wurden bei hoher Temperatur gemessen und zeigten, dass der Umsatz sinkt."] * 3)]),
        ("korean", "a", "translation", ["Put this into Korean.\n\n" + WHOLE], ["\n\n".join(["본 연구에서는 여과 공정의 수율에 대한 영향을 조사하였다. 이 값은 낮은데, 변화가 주로 막의 상태에 달려 있기 때문이다."] * 3)]),
        ("two", "a", "rewriting", [ask], ["\n\n".join(fine.split("\n\n")[:2])]), ("cut", "a", "rewriting", [ask], [fine[:-25]]), ("fine", "a", "rewriting", [ask], [fine]),
        ("table", "a", "rewriting", [ask], [fine + "\n\n| a | b |\n|---|---|\n| 1 | 2 |"]), ("excuse", "a", "rewriting", [ask], ["I can't check the citations.\n\n" + fine]),
    ]
    got = pairs(spark, rows)
    want = {("r0", 1): "refusal", ("r1", 1): "refusal", ("r2", 1): "refusal", ("empty", 1): "empty", ("null", 1): "empty", ("short list", 2): "empty", ("no list", 1): "empty", ("copy", 1): "copied", ("proof all", 1): "copied", ("german", 1): "wrong_language", ("two", 1): "truncated", ("cut", 1): "truncated"}
    assert got == want


def test_refusals_in_other_wordings_and_of_many_sentences(spark):
    ask = "Reword this text. Answer with three paragraphs.\n\n" + WHOLE.format(1)
    other = "Such a thing lies outside of what may be offered here today."  # no wording of the list
    assert not p1_pairs._DECLINE.search(other.lower())
    ten = "I'm sorry, but I can't help with that request. " + " ".join(f"Please ask the {w} office of your institute for further advice on it." for w in "first second third fourth fifth sixth seventh eighth ninth tenth".split())
    fine = WHOLE.format(2).replace("flow", "stream").replace("Heat", "Some heat").replace("model", "simple model") + " All of this was to be expected from older work on other cells."
    rows = [(f"o{i}", f"s{i}", "rewriting", [ask], [other]) for i in range(3)] + [(f"t{i}", f"s{i}", "rewriting", [ask], [ten]) for i in range(3)]
    rows += [(f"p{i}", f"s{i}", "rewriting", [ask], [f"Here is the revised text you asked for:\n\n{fine if i else fine[:-25]}"]) for i in range(3)]
    assert pairs(spark, rows) == {**{(f"{k}{i}", 1): "refusal" for k in "ot" for i in range(3)}, ("p0", 1): "truncated"}


def test_latest_output_counts_and_empty_tables(spark):
    ask = "Reword.\n\n" + WHOLE
    tasks = spark.createDataFrame([("v", "s", "rewriting", [ask], "", "")] * 2, TASKS)
    outs = spark.createDataFrame([("v", [""], "2026-02-01T10:00:00+00:00", ""), ("v", [WHOLE.format(9).replace("hour", "day").replace("wall", "inlet")], "2026-02-01T11:00:00Z", "")], OUTPUTS)
    assert [r["defect"] for r in p1_pairs.defects(tasks, outs).collect()] in ([], ["copied"])
    assert p1_pairs.defects(tasks.limit(0), outs).count() == 0
    assert p1_pairs.defects(tasks, outs.limit(0)).count() == 0


def test_clusters_against_brute_force(spark):
    random.seed(3)
    base = [" ".join(random.choices("a b c d e f g h i j k l m n".split(), k=24)) for _ in range(12)]
    texts = base + [" ".join(w if j != 23 else "z" for j, w in enumerate(t.split())) for t in base[:6]] + ["tiny", ""]
    got = {r["text"]: r["cluster"] for r in p1_pairs.clusters(spark.createDataFrame([(t,) for t in texts + texts[:3]] + [(None,)], "text string")).collect()}
    assert set(got) == set(texts)
    for a in texts:
        for b in texts:
            x, y = p1_pairs.shingles(a), p1_pairs.shingles(b)
            if len(x & y) >= 0.8 * len(x | y):
                assert got[a] == got[b]


def test_clusters_of_a_band_that_mixes_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(p1_pairs, "_bands", lambda c: F.array(F.lit(7).cast("long")))
    texts = [f"{'abcdef'[i]} " + " ".join(f"{'xyz'[i % 3]}{j}" for j in range(40)) for i in range(6)]
    got = {r["text"]: r["cluster"] for r in p1_pairs.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [got[t] for t in texts] == texts[:3] * 2


# ---------------------------------------------------------------- p2

MANIFEST = "doc_id string, bundle_id string, role string, journal string, pub_year int, subfields array<string>, key string, available string"
PLAN = "plan_id int, dimension string, category string, target_share double, min_rows int, sample_size long, quota string"


def test_shortfalls_and_sample(spark):
    rows = [(f"d{i}", None, "seed", "Ann & Co" if i % 2 else "ann  and CO.", 2020, ["a", "A", None], "", "") for i in range(10)] + [("d1", None, "seed", "ANN AND CO", 2020, None, "", ""), ("v", None, "variant", "Rare", 0, [], "", ""), (None, None, "seed", "Rare", None, None, "", ""), ("r", None, "seed", "Rare", None, None, "", "")]
    plan = [(1, "journal", "Ann and Co", 0.8, 1, 5, ""), (1, "journal", "Rare", 0.2, 2, 5, ""), (1, "journal", "None", 0.0, 1, 5, ""), (2, "subfields", "a", 1.0, 1, 4, ""), (3, "pub_year", "2020", 1.0, 11, 4, "")]
    m, p = spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(plan, PLAN)
    assert {tuple(r) for r in p2_sample.shortfalls(m, p).collect()} == {(1, "Rare"), (1, "None"), (3, "2020")}
    drawn = p2_sample.draw(m, p).collect()
    by = {}
    for r in drawn:
        by.setdefault((r["plan_id"], r["category"]), set()).add(r["doc_id"])
    assert {k: len(v) for k, v in by.items()} == {(1, "Ann and Co"): 4, (1, "Rare"): 1, (2, "a"): 4, (3, "2020"): 10}  # the floor outranks the sample size
    assert {(r["plan_id"], r["category"]): (r["drawn"], r["missing"]) for r in p2_sample.report(m, p).collect()} == {(1, "Ann and Co"): (4, 0), (1, "Rare"): (1, 1), (1, "None"): (0, 1), (2, "a"): (4, 0), (3, "2020"): (10, 1)}
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, p2_sample.draw(m.repartition(3), p).collect()))
    assert p2_sample.draw(m.limit(0), p).count() == 0 and p2_sample.shortfalls(m.limit(0), p).count() == 5


def test_quotas_keep_sum_floor_and_cap(spark):
    random.seed(1)
    rows = []
    for plan in range(25):
        n = random.randint(1, 6)
        w = [random.random() for _ in range(n)]
        rows += [(plan, f"c{i}", w[i] / sum(w), random.randint(0, 4), random.randint(4 * n, 60), random.randint(0, 40)) for i in range(n)]
        size = rows[-1][4]
        rows[-n:] = [(*r[:4], size, r[5]) for r in rows[-n:]]
    rows = [(*r, max(r[3], round(r[2] * r[4]))) for r in rows]
    got = p2_sample.quotas(spark.createDataFrame(rows, "plan_id int, category string, target_share double, min_rows int, sample_size long, available long, wanted long")).collect()
    for plan in range(25):
        rs = [r for r in got if r["plan_id"] == plan]
        assert sum(r["quota"] for r in rs) >= min(rs[0]["sample_size"], sum(r["available"] for r in rs))  # no miss that other seeds could fill
        assert {r["category"] for r in rs if r["unmet"]} == {r["category"] for r in rs if r["available"] < r["wanted"]}
        assert sum(r["quota"] for r in rs) <= max(rs[0]["sample_size"], sum(min(r["min_rows"], r["available"]) for r in rs))
        assert all(min(r["min_rows"], r["available"]) <= r["quota"] <= r["available"] for r in rs)


def most_dealt(wanted, kinds, counts):
    """The most records that can be dealt, one by one, by depth-first search of single records."""
    records = [ks for ks, n in zip(kinds, counts) for _ in range(n)]
    of = {}

    def place(r, seen):
        for c in records[r]:
            if c in seen:
                continue
            seen.add(c)
            mine = of.setdefault(c, [])
            if len(mine) < wanted[c]:
                mine.append(r)
                return True
            for i, other in enumerate(mine):
                if place(other, seen):
                    mine[i] = r
                    return True
        return False

    return sum(place(r, set()) for r in range(len(records)))


def test_dealing_of_records_with_several_categories():
    rng = random.Random(6)
    for _ in range(120):
        n = rng.randint(1, 5)
        kinds = list({tuple(sorted(rng.sample(range(n), rng.randint(1, n)))) for _ in range(rng.randint(1, 7))})
        counts = [rng.randint(1, 6) for _ in kinds]
        total = [sum(k for ks, k in zip(kinds, counts) if c in ks) for c in range(n)]
        wanted = [rng.randint(0, t) for t in total]
        floors = [rng.randint(0, w) for w in wanted]
        got = p2_sample.dealt(floors, wanted, [1.0] * n, kinds, counts)
        have = [sum(g.get(c, 0) for g in got) for c in range(n)]
        assert all(sum(g.values()) <= k and set(g) <= set(ks) and min(g.values(), default=0) >= 0 for g, k, ks in zip(got, counts, kinds))
        assert sum(min(h, f) for h, f in zip(have, floors)) == most_dealt(floors, kinds, counts)
        assert sum(have) == min(sum(counts), sum(wanted))


def test_floors_of_seeds_with_two_categories(spark):
    rows = [(f"d{i}", None, "seed", None, None, ["A", "B"], "", "") for i in range(10)]
    plan = spark.createDataFrame([(1, "subfields", "A", 0.1, 2, 10, ""), (1, "subfields", "B", 0.9, 2, 10, "")], PLAN)
    drawn = p2_sample.draw(spark.createDataFrame(rows, MANIFEST), plan).collect()
    n = {k: sum(r["category"] == k for r in drawn) for k in "AB"}
    assert len({r["doc_id"] for r in drawn}) == len(drawn) == 10 and n["A"] >= 2 and n["B"] >= 2


def test_caps_pass_rows_on(spark):
    rows = [(f"d{i}", None, "seed", "J", None, None, "", "") for i in range(10)]
    plan = spark.createDataFrame([(1, "journal", "J", 0.5, 0, 10, ""), (1, "journal", "K", 0.5, 0, 10, "")], PLAN)
    got = {r["category"]: (r["quota"], r["drawn"], r["missing"]) for r in p2_sample.report(spark.createDataFrame(rows, MANIFEST), plan).collect()}
    assert got == {"J": (10, 10, 0), "K": (0, 0, 5)}


# ---------------------------------------------------------------- p3


def brute_groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_groups_and_splits(spark):
    schema = "doc_id string, bundle_id string, node string, root string"
    m = [("A", "b-1", "", ""), ("A-mixed-x", None, "", ""), ("B", " B-1 ", "", ""), ("C", "unknown", "", ""), ("D", "unknown", "", ""), ("E-mixed-x", "b-", "", ""), ("E-rewriting-y", "-", "", ""), (None, "b-1", "", ""), ("F", "b-7", "", ""), ("F", "b-8", "", "")]
    lr = [("G", "b-7", "", ""), ("H", "b-8", "", ""), ("C", "b-9", "", ""), ("Z", "", "", "")]
    md, ld = spark.createDataFrame(m, schema), spark.createDataFrame(lr, schema)
    got = {r["doc_id"]: r["group_id"] for r in p3_splits.found(md, ld).collect()}
    assert got == {"A": "A", "A-mixed-x": "A", "B": "A", "F": "F", "G": "F", "H": "F"}
    plan = spark.createDataFrame([("train", 0.8, 1), ("test", 0.2, 1)], "split string, share double, hi int")
    out = p3_splits.deal(p3_splits.grouped(md, ld), plan).collect()
    assert len(out) == len({r["doc_id"] for r in out}) == 11
    assert all(len({r["split"] for r in out if r["group_id"] == g}) == 1 for g in {r["group_id"] for r in out})
    assert p3_splits.found(md.limit(0), ld.limit(0)).count() == 0


def test_forest_and_shares_of_splits(spark):
    from foliospark.sources.tables import table

    m, lr = (table(spark, "/root/testdata/sf0.01", t) for t in ("manifest", "label_records"))
    groups = {r["doc_id"]: r["group_id"] for r in p3_splits.found(m, lr).collect()}
    edges = [tuple(r) for r in p3_splits.forest(m, lr).collect()]
    assert brute_groups(edges) == groups and len(edges) == len(groups) - len(set(groups.values()))
    plan = table(spark, "/root/testdata/sf0.01", "split_plan")
    rows = p3_splits.deal(p3_splits.grouped(m, lr), plan).collect()
    largest = max(sum(r["group_id"] == g for r in rows) for g in set(groups.values()))
    for r in plan.collect():
        assert abs(sum(x["split"] == r["split"] for x in rows) - r["share"] * len(rows)) <= 2 * largest + 8
    one = spark.createDataFrame([("S", None), ("S-rewriting-a-b", None), ("S-mixed-x-rewriting-y", None), ("S-mixed-x", None)], "doc_id string, bundle_id string")
    assert {r["group_id"] for r in p3_splits.found(one, one.limit(0)).collect()} == {"S"}


def test_components_against_union_find(spark):
    from foliospark.operators.components import components

    random.seed(4)
    edges = [(f"{random.randint(0, 80):03}", f"{random.randint(0, 80):03}") for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + edges[:5] + [("x", None)], "a string, b string")).collect()}
    want = brute_groups([(a, b) for a, b in edges if a != b])
    assert got == want


# ---------------------------------------------------------------- p4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We saw Fig. 2c. It rose to 3.5 K. Dr. Lee and J. R. Kim agree.", ["We saw Fig. 2c.", "It rose to 3.5 K.", "Dr. Lee and J. R. Kim agree."]),
        ('"Can it run?" asked Lee in 2001. pH was kept at 7, etc. n-Butane was fed.', ['"Can it run?" asked Lee in 2001.', "pH was kept at 7, etc.", "n-Butane was fed."]),
        ("All was bought from Kelmar Inc. With it we began.", ["All was bought from Kelmar Inc.", "With it we began."]),
        ("Made by Kelmar Inc. and used.", ["Made by Kelmar Inc. and used."]),
        ("Die Proben vom 7. März zeigten es, z. B. Zeolith. „Das gelingt!“, schrieb Dr. Lee.", ["Die Proben vom 7. März zeigten es, z. B. Zeolith.", "„Das gelingt!“, schrieb Dr. Lee."]),
        ("文献中写道：“过滤需要粉煤灰。”这一看法一致。能否完成？可以。", ["文献中写道：“过滤需要粉煤灰。”这一看法一致。", "能否完成？", "可以。"]),
        ('"증류 없이는 어렵다."라고 적고 있다. 15.8 kPa에서 측정하였다.', ['"증류 없이는 어렵다."라고 적고 있다.', "15.8 kPa에서 측정하였다."]),
        ("เราทำการทดลองซ้ำ 36 ครั้งและได้ค่า 51.9 ชั่วโมง ดังนั้นการกลั่นจึงควรทำ", ["เราทำการทดลองซ้ำ 36 ครั้งและได้ค่า 51.9 ชั่วโมง", "ดังนั้นการกลั่นจึงควรทำ"]),
        ("डॉ. Lee ने मान पाया। यह कम है।", ["डॉ. Lee ने मान पाया।", "यह कम है।"]),
        ("Used in the autoclave.As shown it is lower.", ["Used in the autoclave.", "As shown it is lower."]),
        ("« Est-ce que cela suffit ? » demande M. Lee. Oui.", ["« Est-ce que cela suffit ? » demande M. Lee.", "Oui."]),
        ("هذا نص أول. وهذا نص ثان؟ نعم هو كذلك.", ["هذا نص أول.", "وهذا نص ثان؟", "نعم هو كذلك."]),
        ("Αυτό είναι κείμενο. Τι είναι αυτό; Είναι δοκιμή.", ["Αυτό είναι κείμενο.", "Τι είναι αυτό;", "Είναι δοκιμή."]),
        ("זה משפט ראשון. וזה השני? כן.", ["זה משפט ראשון.", "וזה השני?", "כן."]),
        ("Սա առաջինն է։ Սա երկրորդն է։", ["Սա առաջինն է։", "Սա երկրորդն է։"]),
        ("ეს პირველია. ეს მეორეა?", ["ეს პირველია.", "ეს მეორეა?"]),
        ("यह पहला है॥ यह दूसरा है॥", ["यह पहला है॥", "यह दूसरा है॥"]),
        ("Das gilt z. B. für ก und bzw. Gl. (3). Es ist so.", ["Das gilt z. B. für ก und bzw. Gl. (3).", "Es ist so."]),
    ],
)
def test_sentences(text, want):
    assert p4_sentences.split_sentences(text) == want
    assert p4_sentences.split_sentences(text, 1) == want[:1]


def test_sentence_table(spark):
    t = spark.createDataFrame([("s", ["One. Two.", None, " "], "x"), ("s", ["One. Two.", None, " "], "x"), (None, ["A."], "x"), ("n", None, "x")], "seed_id string, paragraphs array<string>, field string")
    s = spark.createDataFrame([("d", 0, "body", "A​b c. De f.  ", "x"), ("d", 1, "heading", "No.", "x"), ("d", 2, "body", None, "x"), ("d", 3, "body", "...", "x")], "doc_id string, seg_order int, kind string, text string, ends string")
    got = sorted(tuple(r) for r in p4_sentences.sentences(t, s).collect())
    assert got == [("segment", "d", 0, 6), ("segment", "d", 0, 12), ("target", "s", 1, 4), ("target", "s", 1, 9)]
    assert p4_sentences.sentences(t.limit(0), s.limit(0)).count() == 0
    long = "Word and word again. " * 20_000
    assert len(p4_sentences.sentence_ends(long)) == 20_000


# ---------------------------------------------------------------- p5


def test_look_alikes(spark):
    schema = "doc_id string, seg_order int, kind string, text string, form string"
    base = "The flow of water was set at 25 °C by Åke."
    rows = [
        ("a", 1, "body", base, ""), ("b", 1, "body", base.replace("water", "wаtеr"), ""), ("c", 1, "body", base.replace(" ", " ").replace("°C", "℃"), ""), ("d", 1, "body", base, ""), ("e", 1, "body", base.replace("25", "２５").replace("fl", "ﬂ").replace("Å", "Å") + "​", ""),
        ("f", 1, "body", base.replace("25", "26"), ""), ("g", 1, "body", base.replace("The", "the"), ""), ("h", 1, "body", base + "²", ""), ("i", 1, "body", base + "2", ""), ("j", 1, "heading", base.replace(" ", " "), ""), ("k", 1, "body", None, ""), ("l", 1, "body", " ", ""), ("m", 1, "body", " ", ""), ("a", 1, "body", base, ""),
    ]
    got = {tuple(r) for r in p5_forms.look_alikes(spark.createDataFrame(rows, schema)).collect()}
    alike = {"a": base, "b": 1, "c": 2, "d": base, "e": 3}
    assert got == {(x, 1, y, 1) for x in alike for y in alike if x < y and alike[x] != alike[y]}
    assert p5_forms.look_alikes(spark.createDataFrame([], schema)).count() == 0
    by_class = {r["doc_id"]: (r["class_id"], r["links"]) for r in p5_forms.classes(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v[1] for k, v in by_class.items()} == {"a": 3, "b": 4, "c": 4, "d": 3, "e": 4} and len({v[0] for v in by_class.values()}) == 1
    twice = [("t", 1, "heading", None, ""), ("t", 1, "heading", "a\u00a0b", ""), ("t", 1, "heading", "c", ""), ("u", 1, "table", None, "")]
    one, other = ({(r["doc_id"], r["seg_order"]): r["text"] for r in p5_forms.consistent(spark.createDataFrame(x, schema)).collect()} for x in (rows + twice, twice[::-1] + rows[::-1]))
    assert one == other and one[("t", 1)] in ("a b", "c") and one[("u", 1)] is None  # one delivery, whatever the order
    forms = {r["doc_id"]: r["text"] for r in p5_forms.consistent(spark.createDataFrame(rows, schema)).collect()}
    assert forms["b"] == forms["c"] == forms["e"] == base and forms["k"] is None and forms["l"] == ""


def test_repair_needs_the_word():
    assert textform.repair("the сat sat", {"cat"}) == "the cat sat"
    assert textform.repair("the сat sat", {"dog"}) == "the сat sat"
    assert textform.repair("Это опыт", {"oпыт"}) == "Это опыт"
    assert textform.repair("the Ꭺcid and ϲore and ᴄost", {"acid", "core", "cost"}) == "the Acid and core and cost"
    assert textform.fold("CO₂ m² №5 …") == "CO₂ m² №5 ..."


# ---------------------------------------------------------------- p6


def test_field_on_held_out_pages():
    field = p6_markup.trained()
    right = total = 0
    for fs, ys in p6_markup.labelled_pages(120, 77):
        for f, y, g in zip(fs, ys, field.decode(fs)):
            if f[0] != "words":
                total += 1
                right += y == g
    assert right / total > 0.98


def test_filter_passes_all_that_the_field_calls_markup():
    import re

    field, passes = p6_markup.trained(), re.compile(p6_markup.SUSPECT)
    rng = random.Random(12)
    for kind, snippets in p6_markup._MARKED.items():
        for snippet in snippets:
            text = "some words " + snippet.replace("{{", "{").replace("}}", "}").replace("{w}", rng.choice("abc") + "lpha").replace("{n}", "7").replace("{m}", "3") + " more words"
            assert not p6_markup.notations(text, field) or passes.search(text), (kind, text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("p < 0.05 and |E| > 3 V, $5 million and $6 million, [12], k_app, 3 * 4, [FORMULA] {111} #7", []),
        ("a <b>bold</b> word &nbsp;", ["html"]), ("a **bold** and `code` word", ["markdown"]), ("# Title\n\ntext", ["markdown"]), ("a '''bold''' [[link|x]]", ["wiki"]), ("a $x_{i}$ and \\textbf{b}", ["latex"]), ("A budget of $5 million was $\\alpha$ here", ["latex"]), ("<i>a</i> and \\emph{b}", ["html", "latex"]),
    ],
)
def test_notations(text, want):
    assert p6_markup.notations(text, p6_markup.trained()) == want


def test_filter_passes_digits_in_signs(spark):
    texts = ["**1. Introduction**\nSome words.", "It is *2.5* here", "of *2.5*", "one\n\n***\n\ntwo", "about $10$ of it", "plain words, 3 * 4 * 5 and $10 only"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert {r["i"] for r in d.where(p6_markup.suspect(d["text"])).collect()} == {0, 1, 2, 3, 4}
    assert p6_markup.notations(texts[0], p6_markup.trained()) == ["markdown"]


def test_clean_keeps_structure():
    f = p6_markup.trained()
    # heading levels and fences of code are kept
    assert p6_markup.clean("## Head\n\n* one **two**\n* three\n\n```\nx = 1\n```", f) == "## Head\n\n- one two\n- three\n\n```\nx = 1\n```"
    assert p6_markup.clean("<p>a &lt; b</p><ul><li>c</li></ul>", f) == "a < b\n\n- c"
    assert p6_markup.clean("<h2>Top</h2><ol><li>c</li><li>d</li></ol>", f) == "## Top\n\n1. c\n2. d"
    assert p6_markup.clean("the [[pipe flow|flow]] is ''fast''", f) == "the flow is fast"
    assert p6_markup.clean("\n\n=== Flow ===\n\nIt is {{cvt|5|K|note={{small|cold}}}} here", f) == "### Flow\n\nIt is 5 K cold here"
    assert p6_markup.clean("A word\\footnote{Seen in \\emph{two} runs.} and \\textbf{more}", f) == "A word (Seen in two runs.) and more"
    assert p6_markup.clean(None, f) is None and p6_markup.clean("plain", f) == "plain"


def test_formulas_of_any_length():
    f = p6_markup.trained()
    inline = "$" + " + ".join(f"a_{i} x" for i in range(60)) + "$"
    display = "$$\n" + " + ".join(f"a_{i} x^2" for i in range(120)) + "\n$$"
    for formula in (inline, display):
        text = f"The sum {formula} was kept as it is."
        assert len(formula) > 400 and p6_markup.notations(text, f) == ["latex"] and formula in p6_markup.clean(text, f)
    nested = "See {{cite|a={{b|c}}|d}} for it."
    assert p6_markup.notations(nested, f) == ["wiki"] and p6_markup.clean(nested, f) == "See c d for it."
    assert p6_markup.notations("A " + "very " * 60 + "**" + "long " * 60 + "end** word", f) == ["markdown"]


@pytest.mark.parametrize(
    ("text", "want"),
    [  # written by hand, apart from the generator of the training pages
        ("<!DOCTYPE html>\n<html><body><h1>Drying of peat</h1><p>Peat was dried for 3&nbsp;h.</p></body></html>", ["html"]),
        ("Results\n=======\n\nSee [the data](https://example.org/d.csv) and `run.py`.\n\n1. first\n2. second", ["markdown"]),
        ("{| class=\"wikitable\"\n|-\n! Run !! Yield\n|-\n| 1 || 0.4\n|}\n''Note'': [[Peat]] was wet.", ["wiki"]),
        ("\\section{Drying}\nThe flux $J = k \\Delta p$ follows \\citep{olsen}.\n\\begin{itemize}\n\\item wet\n\\end{itemize}", ["latex"]),
        ("Costs rose from $12 to $15 a tonne [7], i.e. x_1 < x_2 & y > 3 (p < 0.01), at 40 % of A*B and C#3.", []),
        ("The set {a, b} and the interval [0, 1] hold for |x| < 1; f(x) = x^2, see eq. (3) and [FORMULA].", []),
    ],
)
def test_notations_of_pages_written_by_hand(text, want):
    assert p6_markup.notations(text, p6_markup.trained()) == want


def test_residue_table(spark):
    o = spark.createDataFrame([("v", ["a **b** c", None], "2026-01-01T00:00:00Z", ""), ("v", ["plain", "<b>x</b>"], "2026-01-02T00:00:00+00:00", ""), ("n", None, None, "")], "variant_id string, step_outputs array<string>, created_at string, ks string")
    s = spark.createDataFrame([("d", 1, "x <i>y</i> z", ""), ("d", 1, "x <i>y</i> z", ""), ("d", 2, None, ""), ("d", 3, " ", "")], "doc_id string, seg_order int, text string, at string")
    assert {tuple(r) for r in p6_markup.residue(o, s).collect()} == {("output", "v", 2, "html"), ("segment", "d", 1, "html")}
    assert p6_markup.residue(o.limit(0), s.limit(0)).count() == 0


# ---------------------------------------------------------------- p7


def test_ids_equal_whole_encoding(spark):
    random.seed(8)
    alphabet = "ab c  \n' s'll 12 .,;é你好吗。 กขค ครั้ง \t　!😀"
    texts = ["", None, "<|endoftext|>", "word " * 30_000] + ["".join(random.choices(alphabet, k=random.randint(0, 400))) for _ in range(150)]
    enc = p7_encode.Encoder(p7_encode.vocabulary_path())
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts + texts[:5])], "doc_id long, text string, ids string, key string")
    got = {r["doc_id"]: r["ids"] for r in p7_encode.encoded(df, p7_encode.vocabulary_path()).collect()}
    assert all(got[i] == (enc.whole(t) if t else []) for i, t in enumerate(texts + texts[:5]))
    assert p7_encode.encoded(df.limit(0), p7_encode.vocabulary_path()).count() == 0
    reuse = p7_encode.chunk_reuse(spark.createDataFrame([(t,) for t in ["word and word " * 900, None, ""] * 2], "text string"), p7_encode.vocabulary_path()).first()
    assert reuse["bytes"] == 2 * 900 * 14 and reuse["repeated_bytes"] >= 900 * 14 and reuse["chunks"] >= 2 * reuse["distinct_chunks"]
    assert p7_encode.chunk_reuse(df.limit(0), p7_encode.vocabulary_path()).first()["bytes"] == 0
    rough = p7_encode.Encoder(p7_encode.vocabulary_path(), every_blank=1, every_other=1, cache=50)
    for t in texts[4:60]:
        assert list(memoryview(rough.batch([t.encode()])[1]).cast("i")) == enc.whole(t)


# ---------------------------------------------------------------- p8


def test_leaks_against_brute_force(spark):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(random.choices(vocabulary, k=60))) for i in range(4)]
    other = lambda n: " ".join(random.choices([f"x{i}" for i in range(400)], k=n))
    w = items[0][1].split()
    odd = w[5:25].copy()
    odd[10] = "changed"
    docs = [
        ("whole", items[1][1].upper()), ("fifteen", f"{other(9)} {' '.join(w[10:25])} {other(9)}"), ("fourteen", f"{other(9)} {' '.join(w[10:24])} {other(9)}"), ("odd", f"{other(9)} {' '.join(odd)} {other(9)}"),
        ("cited", " ".join([*w[20:28], "[3,4]", *w[28:40]])), ("wrapped", "\n".join([" ".join(w[30:36]), *w[36:50]])), ("none", other(300)), ("null", None), ("empty", ""), ("signs", "... !!!"),
        ("many odd", " ".join(x if j % 7 else "changed" for j, x in enumerate(w))),
    ]
    names = [n for n, _ in docs]
    d = spark.createDataFrame([(i, t, 1) for i, (_, t) in enumerate(docs)], "doc_id long, text string, words int")
    e = spark.createDataFrame(items + [(9, None)], "item_id long, text string")
    got = {(names[r["doc_id"]], r["item_id"]) for r in p8_leaks.leak_spans(d, e).collect()}
    assert got == {("whole", 1), ("fifteen", 0), ("odd", 0), ("cited", 0), ("wrapped", 0)}
    assert p8_leaks.leak_spans(d.limit(0), e).count() == 0 and p8_leaks.leak_spans(d, e.limit(0)).count() == 0
    assert len(p8_leaks.blocks_of(e, 300)) == 4


def test_scripts_without_blanks_and_removal(spark):
    rng = random.Random(3)
    zh = "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动") for _ in range(60)) + "。"
    w = [f"word{i}" for i in range(60)]
    items = spark.createDataFrame([(1, zh), (2, " ".join(w))], "item_id long, text string")
    docs = [(1, f"前面的文字，{zh}后面", ""), (2, "Before it: " + " ".join(w[:10]) + " [3, 4] exam-\nple " + " ".join(w[10:50]).upper() + ". Behind it.", ""), (3, "A note: " + " ".join(w[:16]) + ". It ends.", ""), (4, "nothing", ""), (5, None, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, removed string")
    assert {(r["doc_id"], r["item_id"]) for r in p8_leaks.leak_spans(d, items).collect()} == {(1, 1), (2, 2), (3, 2)}
    got = {r["doc_id"]: (r["removed"], r["text"]) for r in p8_leaks.without_leaks(d, items).collect()}
    assert got == {1: (60, "前面的文字， 。后面"), 2: (len(docs[1][1]) - len("Before it: . Behind it."), "Before it: . Behind it.")}
    assert p8_leaks.without_leaks(d, items.limit(0)).count() == 0


def test_automaton_finds_longest_runs():
    random.seed(2)
    items = [[random.randint(0, 3) for _ in range(30)] for _ in range(3)]
    automaton = p8_leaks.SuffixAutomaton(items)
    doc = [random.randint(0, 3) for _ in range(200)]
    holds = lambda run: {n for n, it in enumerate(items) if any(it[k : k + len(run)] == run for k in range(len(it)))}
    for end, n, found in automaton.runs(doc, 4):
        run = doc[end - n : end]
        assert found == holds(run) != set()
        assert end - n == 0 or not holds(doc[end - n - 1 : end])
        assert end == len(doc) or not holds(doc[end - n : end + 1])


def test_items_that_hold_part_of_a_longer_match():
    w = [f"word{i}" for i in range(60)]
    items = [(1, " ".join(w)), (2, " ".join(["first", *w[:20], "other"])), (3, " ".join(["second", *w[20:38], "other"])), (4, " ".join(["third", *w[44:]]))]
    assert {x[0] for x in p8_leaks.Finder(items).leaks("before " + " ".join(w) + " after")} == {1, 2, 3, 4}


# ---------------------------------------------------------------- p9

GERMAN = "Die Proben wurden in der Kolonne bei hoher Temperatur gemessen. Dabei ist der Umsatz kleiner als erwartet, weil das Harz aufquillt. Wir haben die Filtration mehrfach wiederholt."
ENGLISH = "The samples were measured in the column at high temperature. The conversion was lower than expected because the resin swells. We have repeated the filtration many times."
KOREAN = "본 연구에서는 여과 공정의 수율에 대한 영향을 조사하였다. 이 값은 낮은데, 변화가 주로 막의 상태에 달려 있기 때문이다."


def test_label_problems(spark):
    rows = [(1, ENGLISH, "en_GB", "x"), (2, ENGLISH, "German", "x"), (3, GERMAN, None, "x"), (4, GERMAN, " ", "x"), (5, ENGLISH + " " + GERMAN + " " + ENGLISH, "en", "x"), (6, KOREAN, "kor", "x"), (7, None, "en", "x"), (8, "12 34 %", None, "x"), (9, "", None, "x"), (10, GERMAN, "DE-at", "x"), (11, ENGLISH + ' The title "Die Rektifikation" is old. ' + ENGLISH, "eng", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, problem string")
    got = {tuple(r)[:3] for r in p9_language.label_problems(d, langmodel.fit([])).collect()}
    assert got == {(2, "wrong", "en"), (3, "missing", "de"), (4, "missing", "de"), (5, "mixed", "en"), (5, "mixed", "de")}
    parts = [(r["part_no"], r["lang"]) for r in p9_language.language_parts(d.where("doc_id = 5"), langmodel.fit([])).orderBy("part_no").collect()]
    assert parts == [(1, "en"), (2, "de"), (3, "en")]
    assert p9_language.label_problems(d.limit(0)).count() == 0


def test_short_sentences_of_another_language_in_a_row(spark):
    zh = "在蒸发器中测得的选择性很高，见图四。这一数值偏低，主要取决于膜的状态。"  # each has fewer than 24 letters
    en = "The samples were measured in the column at high temperature. The results show that the yield depends on the flow. This was expected from older work."
    d = spark.createDataFrame([(1, f"{en}\n\n{zh}\n\n{en}", "en"), (2, en, "en")], "doc_id long, text string, lang string")
    assert {tuple(r)[:3] for r in p9_language.label_problems(d, langmodel.fit([])).collect()} == {(1, "mixed", "en"), (1, "mixed", "zh")}
    parts = [(r["doc_id"], r["part_no"], r["lang"]) for r in p9_language.language_parts(d, langmodel.fit([])).orderBy("doc_id", "part_no").collect()]
    assert parts == [(1, 1, "en"), (1, 2, "zh"), (1, 3, "en"), (2, 1, "en")]


FOREIGN = {
    "pl": "Próbki zmierzono w kolumnie w wysokiej temperaturze. Konwersja była niższa niż oczekiwano, ponieważ żywica pęcznieje. Wielokrotnie powtarzaliśmy filtrację przez membranę.",
    "sv": "Proverna mättes i kolonnen vid hög temperatur. Omsättningen var lägre än väntat eftersom hartset sväller. Vi har upprepat filtreringen många gånger.",
    "da": "Prøverne blev målt i kolonnen ved høj temperatur. Omsætningen var lavere end forventet, fordi harpiksen svulmer op. Vi har gentaget filtreringen mange gange.",
    "el": "Τα δείγματα μετρήθηκαν στη στήλη σε υψηλή θερμοκρασία. Η μετατροπή ήταν χαμηλότερη από το αναμενόμενο επειδή η ρητίνη διογκώνεται.",
    "ca": "Les mostres es van mesurar a la columna a alta temperatura. La conversió va ser inferior a l'esperada perquè la resina s'infla.",
    "uk": "Зразки вимірювали в колоні за високої температури. Конверсія була нижчою за очікувану, оскільки смола набухає. Ми багаторазово повторювали фільтрацію.",
}


def test_texts_in_none_of_the_languages(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["lang", "text"]).slice(0, 6000).to_pylist()
    model = langmodel.fit([(langmodel.label_of(r["lang"]), r["text"]) for r in t if r["text"]], 150)
    rows = [(i, x, k) for i, (k, x) in enumerate(FOREIGN.items())] + [(90, "qwrtp zxcvb lkjhg mnbvc trwqp hjklm vbnxz. Plkmn bvcxz qwsdf ghjkl rtyzx cvbnm.", None), (91, ENGLISH, "pl"), (92, GERMAN, "sv")]
    rows += [(100 + i, FOREIGN[k], None) for i, k in enumerate(("pl", "sv", "da", "el"))]
    got = {tuple(r)[:3] for r in p9_language.label_problems(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert got == {(91, "wrong", "en"), (92, "wrong", "de")}
    parts = p9_language.language_parts(spark.createDataFrame([(1, ENGLISH, None)], "doc_id long, text string, lang string"), model).collect()
    assert len(parts) == 1 and 0.9 < parts[0]["confidence"] <= 1
    assert (model.shares[1:] >= model.shares[:-1]).all()


def test_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    known = [(langmodel.label_of(r["lang"]), r["text"]) for r in t if r["text"] and len(r["text"]) > 80 and langmodel.label_of(r["lang"]) in langmodel.LANGUAGES]
    model = langmodel.fit(known[::2], 100)
    lang, _, _, _ = model.classifier().per_text([x for _, x in known[1::2]])
    right = sum(langmodel.LANGUAGES[k] == y for k, (y, _) in zip(lang, known[1::2]))
    assert right / len(lang) > 0.88  # some labels are wrong on purpose


def test_labels():
    assert [langmodel.label_of(x) for x in ("EN", "en-US", "German", "zho", "??", "", None, "und", "n/a", "unknown", "pt_BR", "한국어")] == ["en", "en", "de", "zh", None, None, None, None, None, None, "pt", "ko"]


def test_similarity_is_the_share_of_words_in_order():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 30)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        assert p1_pairs.in_order(a, b) == row[-1]
        assert p1_pairs.in_order(a, b) >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert p1_pairs.similarity(a, a) == 1.0 and p1_pairs.similarity("a b".split(), "c d".split()) == 0.0
    long = [f"w{i % 977}" for i in range(40_000)]
    assert p1_pairs.similarity(long, ["x", *long[:20_000], "y", *long[20_000:]]) > 0.99  # a copy of a very long text


def test_recall_of_links_against_brute_force(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(24, 40))
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            v = base[:]
            for _ in range(rng.randint(1, 2)):
                v[rng.choice((0, -1, rng.randrange(len(v))))] = rng.choice(words)
            texts.append(v)
    texts = list(dict.fromkeys(map(" ".join, texts)))
    got = {r["text"]: r["cluster"] for r in p1_pairs.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    sets = [p1_pairs.shingles(t) for t in texts]
    links = [(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 100 and kept >= 0.95 * len(links)
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in texts for b in texts if got[a] == got[b])  # no link that isn't one


def test_templates_without_a_known_wording_and_words_of_the_prompt(spark):
    ask = "Reword this text. Answer with three paragraphs.\n\n" + WHOLE.format(1)
    said = "This falls outside what I provide. Reach out to your editor for other ways forward."
    assert not p1_pairs._DECLINE.search(said.lower())
    rows = [(f"r{i}", f"s{i}", "rewriting", [ask], [said]) for i in range(6)]
    rows += [(f"t{i}", f"s{i}", "rewriting", [ask], ["Heat losses of 1 W were seen at the wall."]) for i in range(6)]
    got = pairs(spark, rows)
    assert got == {(f"{k}{i}", 1): "refusal" if k == "r" else "truncated" for k in "rt" for i in range(6)}
