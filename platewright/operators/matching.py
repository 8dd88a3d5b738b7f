"""Detected against expected boxes: compatibility, optimal assignment, counts, revisions and pages.

Candidate pairs come from the bucketed range join; only a page's competing candidates meet in one task, for
the assignment, which works part by part.  Counts and scores are relational.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.operators import rules, spatial
from platewright.operators.lines import along

# Categories; colour and visual may be taken for each other; weights of the five scores.
CATEGORIES = ["text", "spelling", "color", "visual", "font"]
WEIGHTS = {"visual": 0.30, "text": 0.35, "color": 0.15, "spelling": 0.10, "font": 0.10}


def compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a.isin("color", "visual") & b.isin("color", "visual"))


def candidates(found: DataFrame, expected: DataFrame, least: float = 0.3) -> DataFrame:
    """Structs `l` (found) and `r` (expected) of compatible boxes, IoU of at least `least` or a centre inside the other, and iou."""
    pairs = spatial.overlaps(found, expected).where(compatible(F.col("l.cat"), F.col("r.cat")))
    return pairs.where((spatial.iou("l", "r") >= least) | spatial.centre_in("l", "r") | spatial.centre_in("r", "l")).withColumn("iou", spatial.iou("l", "r"))


def best_pairs(edges: list[tuple[int, int, float]], rows: int, columns: int) -> list[int]:
    """Edges (row, column, score) of greatest total score, each row and column used once at most, by number.

    Shortest augmenting paths over the edges that there are; every row may also stay alone at no cost.
    """
    out: list[list[tuple[int, float, int]]] = [[] for _ in range(rows)]
    for k, (i, j, score) in enumerate(edges):
        out[i].append((j, -score, k))
    for i in range(rows):
        out[i].append((columns + i, 0.0, -1))
    owner: dict[int, int] = {}
    mate, used = [-1] * rows, [-1] * rows
    u, v = [min(c for _, c, _ in own) for own in out], [0.0] * (columns + rows)
    for start in range(rows):
        far, came, heap, done, end = {}, {}, [], set(), -1
        row, base = start, 0.0
        while True:
            for j, cost, k in out[row]:
                d = base + cost - u[row] - v[j]
                if j not in done and d < far.get(j, float("inf")) - 1e-12:
                    far[j], came[j] = d, (row, k)
                    heapq.heappush(heap, (d, j))
            while heap[0][1] in done:
                heapq.heappop(heap)
            base, end = heapq.heappop(heap)
            done.add(end)
            if end not in owner:
                break
            row = owner[end]
        for j in done:
            if j != end:
                u[owner[j]] += base - far[j]
                v[j] -= base - far[j]
        u[start] += base
        while True:
            row, k = came[end]
            owner[end], used[row], mate[row], end = row, k, end, mate[row]
            if row == start:
                break
    return sorted(k for k in used if k >= 0)


def assigned(pairs: DataFrame, page: str = "page") -> DataFrame:
    """Pairs (page, a, b, score > 0) of greatest total score, each side used once at most.

    A pair whose boxes have no other candidate stands; of the rest each connected part is solved by
    itself, as pairs of different parts never compete.  A task holds a page's candidate pairs, no matrix.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    rows = pairs.select(page, "a", "b", F.col("score").cast("double").alias("score"))
    alone = (F.count("*").over(Window.partitionBy(page, "a")) == 1) & (F.count("*").over(Window.partitionBy(page, "b")) == 1)
    rows = rows.withColumn("_alone", alone)

    def solved(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        score = table.column("score").to_numpy()
        line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        side = lambda name: np.unique(line * (table.num_rows + 1) + table.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        a, b = side("a"), side("b")
        parent = list(range(int(a.max()) + 1 + int(b.max()) + 1))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        shift = int(a.max()) + 1
        for i, j in zip(a.tolist(), (b + shift).tolist(), strict=True):
            parent[root(i)] = root(j)
        part = np.array([root(i) for i in a.tolist()])
        order, chosen = np.argsort(part, kind="stable"), []
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            flip = len(np.unique(a[own])) > len(np.unique(b[own]))
            left, right = (np.unique(x[own], return_inverse=True)[1] for x in ((b, a) if flip else (a, b)))
            best = best_pairs(list(zip(left.tolist(), right.tolist(), score[own].tolist(), strict=True)), int(left.max()) + 1, int(right.max()) + 1)
            chosen += own[best].tolist()
        return table.select([page, "a", "b", "score"]).take(sorted(chosen)).combine_chunks().to_batches()[0]

    rest = along(rows.where(~F.col("_alone")).drop("_alone"), [page], ["a", "b"], solved, f"`{page}` {kinds[page]}, a {kinds['a']}, b {kinds['b']}, score double")
    return rows.where("_alone").drop("_alone").unionByName(rest)


def matched(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(page, a, b, score): the assignment that maximises one plus IoU over all pairs."""
    pairs = candidates(found, expected)
    return assigned(pairs.select(F.col("l.page").alias("page"), F.col("l.id").alias("a"), F.col("r.id").alias("b"), (1 + F.col("iou")).alias("score")))


def case_counts(found: DataFrame, expected: DataFrame, matches: DataFrame, case: str = "page") -> DataFrame:
    """(case, cat, tp, fp, fn): hits and misses by the expected category, false ones by the detected."""
    by = lambda df, side: df.join(matches.select(case, F.col(side).alias("id"), F.lit(1).alias("hit")), [case, "id"], "left").select(case, "cat", F.col("hit").isNotNull().alias("hit"))
    e = by(expected, "b").select(case, "cat", F.col("hit").cast("int").alias("tp"), F.lit(0).alias("fp"), (~F.col("hit")).cast("int").alias("fn"))
    f = by(found, "a").select(case, "cat", F.lit(0).alias("tp"), (~F.col("hit")).cast("int").alias("fp"), F.lit(0).alias("fn"))
    return e.unionByName(f).groupBy(case, "cat").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def totals(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each category, of colour and visual together and of all."""
    groups = F.explode(F.array_compact(F.array(F.col("cat"), F.when(F.col("cat").isin("color", "visual"), "color_visual"), F.lit("all")))).alias("category")
    return rules.prf(counts.select(groups, "tp", "fp", "fn").groupBy("category").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def run_statistics(cases: DataFrame, counts: DataFrame, case: str = "page") -> DataFrame:
    """One row over cases (case, n_expected, status, cer, elapsed, timings map): false ones a case, clean ones approved, error rate, times."""
    false_ = counts.groupBy(case).agg(F.sum("fp").alias("fp"))
    rows = cases.join(false_, case, "left")
    clean = F.col("n_expected") == 0
    share = F.when(F.count_if(clean) > 0, F.round(100.0 * F.count_if(clean & (F.col("status") == "approved")) / F.nullif(F.count_if(clean), F.lit(0)), 1))
    return rows.agg(
        F.count("*").alias("cases"), F.round(F.coalesce(F.sum("fp"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 2).alias("fp_per_case"), F.count_if(clean).alias("clean"), share.alias("clean_approved_pct"),
        F.round(100 * F.avg("cer"), 2).alias("cer_pct"), F.round(F.coalesce(F.avg("elapsed"), F.lit(0.0)), 2).alias("mean_s"), F.round(F.coalesce(F.max("elapsed"), F.lit(0.0)), 2).alias("max_s"))


def stage_seconds(cases: DataFrame) -> DataFrame:
    """Mean time of each stage."""
    return cases.select(F.explode("timings").alias("stage", "seconds")).groupBy("stage").agg(F.round(F.avg("seconds"), 2).alias("seconds"))


def scored(rows: DataFrame, weights: dict[str, float] = WEIGHTS, digits: int | None = 1) -> DataFrame:
    """Adds the five scores in percent, their weighted total (rounded, if there are digits) and the status.

    Needs similarity, text_matched, text_total, colour_area, area, misspelled, spelled, fonts_bad, fonts.
    """
    pct = lambda part, whole: F.when(whole <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * part / F.nullif(whole, F.lit(0)))))
    c = F.col
    parts = {
        "visual": F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("similarity") * 100.0)), "text": pct(c("text_matched"), c("text_total")), "color": pct(c("area") - c("colour_area"), c("area")),
        "spelling": pct(c("spelled") - c("misspelled"), c("spelled")), "font": pct(c("fonts") - c("fonts_bad"), c("fonts"))}
    rows = rows.withColumns({f"_{k}": v for k, v in parts.items()})
    total = sum((c(f"_{k}") * weights.get(k, 0) for k in parts), F.lit(0.0)) / (sum(weights.get(k, 0) for k in parts) or 1.0)
    rows = rows.withColumn("_total", total)
    shown = lambda k: F.col(f"_{k}") if digits is None else F.round(f"_{k}", digits)
    return rows.withColumns({k: shown(k) for k in (*parts, "total")} | {"status": rules.status(c("_total"))}).drop(*(f"_{k}" for k in (*parts, "total")))


# ---------------------------------------------------------------- revisions


def first_unused(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Pairs (group, a, b, order): each a in turn takes its first b of least `order` that no earlier a took."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used, done, keep = set(), set(), []
        for i, a, b in zip(pdf.index, pdf.a, pdf.b, strict=True):
            if a not in done and b not in used:
                used.add(b), done.add(a), keep.append(i)
        return pdf.loc[keep]

    return pairs.groupBy(*group).applyInPandas(lambda pdf: take(pdf.sort_values(["a", "order", "b"], ignore_index=True)), kinds)


def verified(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page, before, after, state): issues that are fixed, persist or are new.

    An old issue takes the first compatible new one in order of id; ignored ones and old ones that were
    set aside take no part.
    """
    old = before.where("not ignored and status <> 'not_applicable' and review <> 'false_positive'")
    new = after.where("not ignored")
    pairs = candidates(old, new).select(F.col("l.page").alias("page"), F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("r.id").alias("order"))
    hits = first_unused(pairs, ["page"]).select("page", "a", "b")
    left = old.select("page", F.col("id").alias("a")).join(hits, ["page", "a"], "left")
    lost = new.select("page", F.col("id").alias("b")).join(hits, ["page", "b"], "left_anti")
    state = F.when(F.col("b").isNull(), "fixed").otherwise("persists").alias("state")
    return left.select("page", F.col("a").alias("before"), F.col("b").alias("after"), state).unionByName(lost.select("page", F.lit(None).cast(old.schema["id"].dataType).alias("before"), F.col("b").alias("after"), F.lit("new").alias("state")))


def carried(after: DataFrame, links: DataFrame, before: DataFrame) -> DataFrame:
    """New issues that persist, with the old one's status and comment."""
    held = links.where("state = 'persists'").join(before.select("page", F.col("id").alias("before"), F.col("status").alias("_s"), F.col("comment").alias("_c")), ["page", "before"]).select("page", F.col("after").alias("id"), "_s", "_c")
    return after.join(held, ["page", "id"], "left").withColumns({"status": F.coalesce("_s", "status"), "comment": F.coalesce("_c", "comment")}).drop("_s", "_c")


def span_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Spans (page, id, text, x, y, ...) of two versions with the same text, the nearest first; each is used once."""
    a, b = two.select("page", "text", F.struct(*two.columns).alias("r")), one.select("page", "text", F.struct(*one.columns).alias("l"))
    pairs = a.join(b, ["page", "text"])
    d = F.pow(F.col("l.x") - F.col("r.x"), F.lit(2)) + F.pow(F.col("l.y") - F.col("r.y"), F.lit(2))
    taken = first_unused(pairs.select("page", "text", F.col("r.id").alias("a"), F.col("l.id").alias("b"), d.alias("order")), ["page", "text"]).select("page", F.col("a").alias("_a"), F.col("b").alias("_b"))
    return pairs.join(taken.withColumnRenamed("page", "_p"), (F.col("page") == F.col("_p")) & (F.col("r.id") == F.col("_a")) & (F.col("l.id") == F.col("_b"))).select("page", "l", "r")


def font_key(font: Column) -> Column:
    """Font name without its subset prefix."""
    return F.lower(F.element_at(F.split(font, r"\+"), -1))


def span_changes(pairs: DataFrame, tolerance_pct: float) -> DataFrame:
    """Adds `changes`: size, font and style of paired spans that differ."""
    l, r = (lambda f: F.col(f"l.{f}")), (lambda f: F.col(f"r.{f}"))  # noqa: E741
    size = F.abs(r("size") - l("size")) > F.greatest(F.lit(0.3), l("size") * tolerance_pct / 100)
    changes = F.array_compact(F.array(F.when(size, "size"), F.when(font_key(l("font")) != font_key(r("font")), "font"), F.when((l("bold") != r("bold")) | (l("italic") != r("italic")), "style")))
    return pairs.withColumn("changes", changes)


def fonts_used(spans: DataFrame) -> DataFrame:
    """Fonts of (font, size, bold, italic, text, pos): number of spans and the first one's text, most used first."""
    rows = spans.withColumns({"font": F.element_at(F.split("font", r"\+"), -1), "size": F.bround("size", 1)})
    by = rows.groupBy("font", "size", "bold", "italic").agg(F.count("*").alias("spans"), F.min_by(F.left("text", F.lit(40)), "pos").alias("example"), F.min("pos").alias("_first"))
    return by.orderBy(F.col("spans").desc(), "_first").drop("_first")


def font_sizes(words: DataFrame, tolerance: float = 0.12, least: int = 3) -> DataFrame:
    """Spans whose words (page, span, design_h, client_h) differ in height: median beyond the tolerance, most words likewise, three pixels."""
    w = words.withColumn("ratio", F.col("client_h") / F.col("design_h"))
    by = w.groupBy("page", "span").agg(F.count("*").alias("n"), F.percentile("ratio", F.lit(0.5)).alias("ratio"), F.percentile(F.col("client_h") - F.col("design_h"), F.lit(0.5)).alias("pixels"), F.avg((F.col("ratio") > 1 + tolerance).cast("int")).alias("over"), F.avg((F.col("ratio") < 1 - tolerance).cast("int")).alias("under"))
    share = F.when(F.col("ratio") > 1, F.col("over")).otherwise(F.col("under"))
    differs = (F.abs(F.col("ratio") - 1) > tolerance) & (share >= 0.7) & (F.abs("pixels") >= 3)
    return by.where(F.col("n") >= least).select("page", "span", "n", "ratio", differs.alias("differs"), F.when(differs, F.when(F.abs(F.col("ratio") - 1) > 2 * tolerance, "medium").otherwise("low")).alias("severity"))


def paired_pages(client: DataFrame, design: DataFrame, costs: DataFrame) -> DataFrame:
    """(job, client, design): by place where both sides of a job have as many pages, else of least total cost; null without a partner.

    Pages are (job, n); costs (job, client, design, cost) are below 1000.
    """
    count = lambda df, name: df.groupBy("job").agg(F.count("*").alias(name))
    sizes = count(client, "nc").join(count(design, "nd"), "job", "full")
    even = sizes.where("nc = nd").select("job")
    rank = lambda df, name: df.select("job", F.col("n").alias(name), F.row_number().over(Window.partitionBy("job").orderBy("n")).alias("k"))
    place = rank(client, "client").join(rank(design, "design"), ["job", "k"]).join(even, "job", "left_semi").select("job", "client", "design")
    scored_ = costs.join(even, "job", "left_anti").select("job", F.col("client").alias("a"), F.col("design").alias("b"), (1000 - F.col("cost")).alias("score"))
    best = assigned(scored_, "job").select("job", F.col("a").alias("client"), F.col("b").alias("design"))
    done = place.unionByName(best)
    kind = client.schema["n"].dataType
    alone = client.select("job", F.col("n").alias("client")).join(done, ["job", "client"], "left_anti").select("job", "client", F.lit(None).cast(kind).alias("design"))
    other = design.select("job", F.col("n").alias("design")).join(done, ["job", "design"], "left_anti").select("job", F.lit(None).cast(kind).alias("client"), "design")
    return done.unionByName(alone).unionByName(other)


def regressions(got: DataFrame, stored: DataFrame, slack: float = 2.0) -> DataFrame:
    """Categories whose f1 is more than `slack` points below the stored one."""
    return got.join(F.broadcast(stored.select("category", F.col("f1").alias("least"))), "category").where(F.col("f1") < F.col("least") - slack)  # one row a category


def adopted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether a change is kept: the error rate (cer) falls and f1 does not; one row on each side, joined by id."""
    a, b = before.select("id", F.col("cer").alias("cer0"), F.col("f1").alias("f0")), after.select("id", F.col("cer").alias("cer1"), F.col("f1").alias("f1"))
    return a.join(b, "id").select("id", "cer0", "cer1", "f0", "f1", ((F.col("cer1") < F.col("cer0")) & (F.col("f1") >= F.col("f0"))).alias("adopted"))
