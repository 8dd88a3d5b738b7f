"""Assignment, counts, revisions, versions, zones and explained issues."""

import random

import pytest

from platewright.operators import matching, zones

BOX = "page int, id int, x int, y int, w int, h int, cat string"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], BOX)


def test_assignment_equals_all_choices():
    """Against every choice of edges of small graphs, with ties."""
    rng = random.Random(1)

    def best(edges, used, row):
        if row == 5:
            return 0.0
        return max([best(edges, used, row + 1), *(s + best(edges, used | {j}, row + 1) for i, j, s in edges if i == row and j not in used)])

    for _ in range(300):
        graph = {(rng.randrange(5), rng.randrange(6)): rng.choice([1.0, 1.5, 1 + rng.random()]) for _ in range(rng.randint(1, 14))}
        edges = [(i, j, s) for (i, j), s in sorted(graph.items())]
        rows = sorted({i for i, _, _ in edges})
        got = [edges[k] for k in matching.best_pairs([(rows.index(i), j, s) for i, j, s in edges], len(rows), 6)]
        assert len({i for i, _, _ in got}) == len(got) == len({j for _, j, _ in got}) and abs(sum(s for *_, s in got) - best(edges, frozenset(), 0)) < 1e-9


def test_assignment_of_a_large_page(spark):
    """Five thousand boxes in one connected part, where every box would rather have its neighbour's partner."""
    n = 5000
    rows = [(1, i, i, 1.5) for i in range(n)] + [(1, i, i + 1, 1.9) for i in range(n - 1)] + [(2, 0, 0, 1.1), (2, 5, 9, 1.2), (2, 5, 8, 1.0)]
    got = matching.assigned(spark.createDataFrame(rows, "page int, a int, b int, score double")).collect()
    page = [(r.a, r.b) for r in got if r.page == 1]
    assert len({a for a, _ in page}) == len({b for _, b in page}) == len(page)
    # n - 1 neighbours at 1.9, the last and the first alone, or all n at 1.5
    assert sum(r.score for r in got if r.page == 1) == pytest.approx(max(1.9 * (n - 1), 1.5 * n))
    assert {(r.a, r.b) for r in got if r.page == 2} == {(0, 0), (5, 9)}


def test_optimal_beats_greedy(spark):
    # a takes b1 greedily and leaves the other without a partner; the best assignment uses both
    pairs = spark.createDataFrame([(1, 1, 1, 1.9), (1, 1, 2, 1.8), (1, 2, 1, 1.7)], "page int, a int, b int, score double")
    assert {(r.a, r.b) for r in matching.assigned(pairs).collect()} == {(1, 2), (2, 1)}


def test_counts_and_totals(spark):
    found = boxes(spark, (1, 0, 0, 10, 10, "color"), (2, 100, 0, 10, 10, "text"), (3, 200, 0, 10, 10, "font"))
    expected = boxes(spark, (1, 1, 1, 10, 10, "visual"), (2, 300, 0, 10, 10, "text"), (3, 200, 0, 10, 10, "font"))
    counts = matching.case_counts(found, expected, matching.matched(found, expected))
    assert {(r.cat, r.tp, r.fp, r.fn) for r in counts.where("tp + fp + fn > 0").collect()} == {("visual", 1, 0, 0), ("text", 0, 1, 1), ("font", 1, 0, 0)}
    got = {r.category: (r.tp, r.fp, r.fn, r.precision, r.f1) for r in matching.totals(counts).collect()}
    assert got["all"] == (2, 1, 1, 66.7, 66.7) and got["color_visual"] == (1, 0, 0, 100.0, 100.0)


def test_verified_takes_the_first_unused(spark):
    extra = "ignored boolean, status string, review string, comment string"
    row = lambda i, x, status="pending", cat="text", ignored=False: (1, i, x, 0, 10, 10, cat, ignored, status, "none", f"c{i}")
    before = spark.createDataFrame([row(1, 0, "fixed_by_us"), row(2, 1), row(3, 100), row(4, 200, "not_applicable")], f"{BOX}, {extra}")
    after = spark.createDataFrame([row(7, 0), row(8, 2), row(9, 500), row(10, 600, ignored=True)], f"{BOX}, {extra}")
    links = matching.verified(before, after)
    assert {(r.before, r.after, r.state) for r in links.collect()} == {(1, 7, "persists"), (2, 8, "persists"), (3, None, "fixed"), (None, 9, "new")}
    assert {r.id: (r.status, r.comment) for r in matching.carried(after, links, before).collect()}[7] == ("fixed_by_us", "c1")


def test_spans_and_fonts(spark):
    schema = "page int, id int, text string, x double, y double, font string, size double, bold boolean, italic boolean, pos int"
    one = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, "AB+Sans", 10.0, False, False, 1), (1, 2, "a", 50.0, 0.0, "Sans", 10.0, False, False, 2)], schema)
    two = spark.createDataFrame([(1, 1, "a", 49.0, 0.0, "sans", 12.0, True, False, 1), (1, 2, "a", 48.0, 0.0, "Serif", 10.1, False, False, 2)], schema)
    got = {r.r.id: (r.l.id, r.changes) for r in matching.span_changes(matching.span_pairs(one, two), 5.0).collect()}
    assert got == {1: (2, ["size", "style"]), 2: (1, ["font"])}
    assert [(r.font, r["size"], r.spans, r.example) for r in matching.fonts_used(one).collect()] == [("Sans", 10.0, 2, "a")]
    w = spark.createDataFrame([(1, 1, 20.0, h) for h in (26.0, 27.0, 26.0, 20.0)] + [(1, 2, 20.0, 21.0)] * 3 + [(1, 3, 20.0, 40.0)] * 2, "page int, span int, design_h double, client_h double")
    assert {r.span: (r.differs, r.severity) for r in matching.font_sizes(w).collect()} == {1: (True, "medium"), 2: (False, None)}


def test_pages(spark):
    client, design = (spark.createDataFrame([(j, n) for j, k in sizes for n in range(k)], "job string, n int") for sizes in ([("a", 2), ("b", 2)], [("a", 2), ("b", 3)]))
    costs = spark.createDataFrame([("b", c, d, float(abs(2 * c - d) * 10 + 1)) for c in range(2) for d in range(3)], "job string, client int, design int, cost double")
    assert {tuple(r) for r in matching.paired_pages(client, design, costs).collect()} == {("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("b", 1, 2), ("b", None, 1)}


def test_statistics_and_gates(spark):
    cases = spark.createDataFrame([(1, 0, "approved", 0.1, 2.0, {"read": 1.0}), (2, 0, "review", None, 4.0, {"read": 3.0, "compare": 1.0}), (3, 2, "errors", 0.3, 6.0, None)], "page int, n_expected int, status string, cer double, elapsed double, timings map<string,double>")
    counts = spark.createDataFrame([(1, "text", 0, 1, 0), (1, "font", 0, 2, 0)], "page int, cat string, tp int, fp int, fn int")
    r = matching.run_statistics(cases, counts).first()
    assert (r.cases, r.fp_per_case, r.clean, r.clean_approved_pct, r.cer_pct, r.mean_s, r.max_s) == (3, 1.0, 2, 50.0, 20.0, 4.0, 6.0)
    assert matching.run_statistics(cases.limit(0), counts).first().clean_approved_pct is None
    assert {tuple(x) for x in matching.stage_seconds(cases).collect()} == {("read", 2.0), ("compare", 1.0)}
    f1 = "category string, f1 double"
    assert [x.category for x in matching.regressions(spark.createDataFrame([("a", 80.0), ("b", 82.1)], f1), spark.createDataFrame([("a", 84.0), ("b", 84.0)], f1)).collect()] == ["a"]
    run = "id int, cer double, f1 double"
    assert [x.adopted for x in matching.adopted(spark.createDataFrame([(1, 0.2, 90.0), (2, 0.2, 90.0)], run), spark.createDataFrame([(1, 0.1, 90.0), (2, 0.1, 89.0)], run)).orderBy("id").collect()] == [True, False]


def test_scores_of_nothing(spark):
    row = spark.createDataFrame([(1.2, 0, 0, 0.0, 0.0, 0, 0, 0, 0), (0.5, 1, 4, 5.0, 10.0, 1, 2, 2, 2)], "similarity double, text_matched int, text_total int, colour_area double, area double, misspelled int, spelled int, fonts_bad int, fonts int")
    got = matching.scored(row).collect()
    assert got[0].status == "approved" and got[0].total == 100.0 and got[1].font == 0.0 and abs(got[1].total - 36.25) < 0.06


@pytest.mark.parametrize(("others", "texts", "colours", "stays"), [
    ([(1, 0, 0, 50, 100, "changed")], [], [], False), ([(1, 0, 0, 20, 100, "changed"), (2, 10, 0, 25, 100, "changed")], [], [], True), ([], [(1, 0, 0, 70, 100, "t")], [], False), ([], [], [(1, 90, 90, 20, 20, "zone")], False), ([], [], [(1, 90, 90, 20, 20, "text")], True),
    ([(1, 200, 20, 30, 60, "changed")], [(1, 0, 0, 45, 100, "t")], [], False), ([], [(1, 0, 0, 45, 100, "t")], [], True)])
def test_explained_regions(spark, others, texts, colours, stays):
    schema = "page int, id int, x int, y int, w int, h int, subtype string"
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], schema)
    kept, _ = zones.unexplained(frame([(1, 0, 0, 100, 100, "visual_difference")]), frame(others), frame(colours), frame(texts))
    assert kept.count() == int(stays)


def test_zones(spark):
    z = spark.createDataFrame([(1, -0.5, 0.5, 2.0, 0.9, "odd")], "id int, x double, y double, w double, h double, mode string")
    r = zones.clamped(z).first()
    assert (r.x, r.y, r.w, r.h, r["mode"]) == (0.0, 0.5, 1.0, 0.5, "all")
    files = spark.createDataFrame([("Label_Acme.pdf", 100, 50), ("x.pdf", 102, 51), ("y.pdf", None, None)], "file string, width int, height int")
    templates = spark.createDataFrame([("acme", 1000, 1000), ("t2", 100, 50)], "template string, t_width int, t_height int")
    assert {tuple(r) for r in zones.suggested(files, templates).collect()} == {("Label_Acme.pdf", "acme"), ("Label_Acme.pdf", "t2"), ("x.pdf", "t2")}
    box = "page int, id int, x double, y double, w double, h double"
    w = spark.createDataFrame([(1, 1, 110.0, 0.0, 20.0, 10.0), (1, 2, 200.0, 0.0, 20.0, 10.0), (1, 3, 110.0, 8.0, 20.0, 10.0)], box)
    assert {r.word for r in zones.next_to_line(w, spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 10.0)], box)).collect()} == {1}
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 0.0, 10.0, 10.0)], box)
    b = spark.createDataFrame([(1, 1, 5.0, 0.0, 10.0, 10.0), (1, 2, 60.0, 0.0, 10.0, 10.0)], box)
    assert {r.id for r in zones.touched(a, b, 0.4).collect()} == {1} and zones.touched(a, b, 0.5).count() == 0


def test_reread(spark):
    schema = "page int, id int, x int, y int, w int, h int, subtype string"
    issues = spark.createDataFrame([(1, 1, 0, 0, 10, 10, "changed"), (1, 2, 5, 5, 10, 10, "missing"), (1, 3, 50, 50, 10, 10, "missing")], schema)
    assert [r.id for r in zones.reread(issues, issues.where("id = 1")).collect()] == [3]
