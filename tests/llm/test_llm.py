"""The training-data operators against brute force, exact round trips and planted cases."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.llm import components, distinct, leaks, packing, subjects, topk, words


# ---- distinct counts


def test_merging_equals_sketching_the_union():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    both, left, right = distinct.Sketch(256), distinct.Sketch(256), distinct.Sketch(256)
    both.add_hashes(np.concatenate([a, b, a]))
    left.add_hashes(a)
    right.add_hashes(b)
    left.merge(right)
    assert np.allclose(left.registers, both.registers)
    back = distinct.Sketch.of(left.bytes(), 256)
    assert back.count() == left.count()


def test_counts_are_unbiased_and_intervals_hold():
    rng = np.random.default_rng(2)
    found, inside = [], 0
    for _ in range(60):
        s = distinct.Sketch(512)
        s.add_hashes(rng.integers(0, 2**63, 4000, dtype=np.uint64))
        n, low, high = s.count()
        found.append(n / 4000)
        inside += low <= 4000 <= high
    assert abs(np.mean(found) - 1) < 0.02 and inside >= 51


def test_registers_hold_over_many_groups_of_every_size(spark):
    """With 32 registers nearly every group leaves the exact list; the finest sketches merge to all levels."""
    rng = np.random.default_rng(3)
    rows = [(f"2024-01-{d + 1:02d}", load, f"s{rng.integers(0, 10 ** (1 + d % 4))}", f"r{rng.integers(0, 3000)}") for d in range(12) for load in range(3) for _ in range(600)]
    df = spark.createDataFrame(rows, "day string, load int, f string, t string").withColumn("day", F.to_date("day"))
    exact: dict = {}
    for day, load, f, t in rows:
        for level, d, b in (("day_load", day, load), ("day", day, None), ("load", None, load), ("all", None, None)):
            for side, v in (("from_hex", {f}), ("to_hex", {t}), ("either", {f, t})):
                exact.setdefault((level, d, b, side), set()).update(v)
    got = distinct.counts(distinct.rolled_up(distinct.sketches(df, "day", "load", {"from_hex": "f", "to_hex": "t"}, m=64), 64), 64).collect()
    errors = [r["n_distinct"] / len(exact[r["level"], r["day_utc"], r["batch_id"], r["side"]]) - 1 for r in got]
    inside = sum(r["low"] <= len(exact[r["level"], r["day_utc"], r["batch_id"], r["side"]]) <= r["high"] for r in got)
    assert len(got) == len(exact) and abs(np.mean(errors)) < 0.05 and np.std(errors) < 1.5 / 8 and inside >= 0.88 * len(got)


def test_small_sets_are_exact_and_levels_add_up(spark):
    rows = [("2024-01-01", 1, "a", "b"), ("2024-01-01", 1, "a", "c"), ("2024-01-01", 2, "b", None), ("2024-01-02", 2, "a", "b"), (None, None, None, "z")]
    df = spark.createDataFrame(rows, "day string, load int, f string, t string").withColumn("day", F.to_date("day"))
    got = {(r["level"], r["day_utc"], r["batch_id"], r["side"]): r["n_distinct"] for r in distinct.counts(distinct.rolled_up(distinct.sketches(df, "day", "load", {"from_hex": "f", "to_hex": "t"}))).collect()}
    assert got["all", None, None, "from_hex"] == 2 and got["all", None, None, "either"] == 4
    assert got["day", "2024-01-01", None, "from_hex"] == 2 and got["day_load", "2024-01-01", 1, "to_hex"] == 2
    assert got["load", None, 2, "either"] == 2 and got["day_load", None, None, "to_hex"] == 1
    none = distinct.sketches(df.limit(0), "day", "load", {"from_hex": "f", "to_hex": "t"})
    assert distinct.counts(distinct.rolled_up(none)).count() == 0


# ---- most frequent values


@pytest.mark.parametrize("k", [1, 3, 50, 1000])
def test_top_k_equals_counting_everything(spark, k):
    rng = random.Random(4)
    values = [f"v{int(rng.paretovariate(0.7)) % 300:03d}" for _ in range(4000)] + [None] * 50
    df = spark.createDataFrame([(v, 1) for v in values], "x string, n int").repartition(6)
    want = sorted(Counter(v for v in values if v).items(), key=lambda p: (-p[1], p[0]))[:k]
    assert [(r["v"], r["n"]) for r in topk.top_k(df, "x", k).collect()] == want


def test_nodes_are_bound_to_the_cores(spark):
    values = [f"v{i % 40:02d}" if i % 3 else f"rare{i:05d}" for i in range(6000)]
    told: dict = {}
    topk.top_k(spark.createDataFrame([(v,) for v in values], "x string").repartition(64), "x", 10, told=told).collect()
    assert told["nodes"] <= spark.sparkContext.defaultParallelism and told["share"] >= 10 and told["fetched"] < told["local_counts"] / 5


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "x string"), "x", 5).count() == 0


# ---- groups


def test_groups_equal_union_find(spark):
    rng = random.Random(6)
    pairs = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(200)]
    pairs += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(90)] + [("hub", f"h{i}") for i in range(60)] + [("self", "self")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(None, "only", "x"), ("only2", None, "x")], "f string, t string, grp string")
    got = components.components(df, "f", "t").collect()
    assert {r["name"]: r["grp"] for r in got} == {x: find(x) for x in list(parent)} and len(got) == len(parent)
    assert components.components(df.limit(0), "f", "t").count() == 0
    loops = spark.createDataFrame([("a", "a"), ("b", "b")], "f string, t string")
    assert sorted(components.components(loops, "f", "t").collect()) == [("a", "a"), ("b", "b")]


# ---- containers


def one_by_one(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if b[0] >= s]
        if fit:
            best = min(fit, key=lambda b: b[0])
            best[0] -= s
        else:
            bins.append([capacity - s])
    return sorted(capacity - b[0] for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_equals_placing_item_by_item(sizes, capacity):
    fill: Counter = Counter()
    left = Counter(sizes)
    runs = packing.plan(dict(left), capacity)
    for s, n in left.items():
        mine = sorted([r for r in runs if r[0] == s], key=lambda r: r[1])
        for rank in range(n):
            run = [r for r in mine if r[1] <= rank][-1]
            fill[run[2] + (rank - run[1]) // run[3]] += s
    assert sorted(fill.values()) == one_by_one(sizes, capacity)


def test_pack_covers_every_item_without_overlap(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 5, 9, 10, 11, 25, 30, 0, -2]), i) for i in range(300)] + [(900, None, 0), (901, 10, 0), (901, 10, 0)]
    got = packing.pack(spark.createDataFrame(rows, "id long, n int, bin int"), "id", "n", 10).collect()
    assert sum(r["size"] for r in got) == sum(max(0, n or 0) for _, n, _ in rows)
    used: dict = {}
    for r in got:
        assert (r["bin"] is None) == (r["size"] == 0)
        for x in range(r["at"] or 0, (r["at"] or 0) + r["size"]):
            assert 0 <= x < 10 and (r["bin"], x) not in used
            used[r["bin"], x] = r["item_id"]
    cut = {r["item_id"] for r in got if r["piece_no"] > 0}
    assert cut == {i for i, n, _ in rows if (n or 0) > 10}
    empty = spark.createDataFrame([], "id long, n int")
    assert packing.pack(empty, "id", "n", 10).count() == 0


def test_check_sees_a_wrong_placement(spark):
    schema = "item_id long, piece_no int, start long, size int, bin long, at int"
    good = [(1, 0, 0, 6, 0, 0), (2, 0, 0, 4, 0, 6), (3, 0, 0, 7, 1, 0), (4, 0, 0, 0, None, None)]
    assert packing.check(spark.createDataFrame(good, schema), 10).collect() == [(4, 17, 2, 0, 0, 2)]
    bad = [(1, 0, 0, 6, 0, 0), (2, 0, 0, 4, 0, 5), (3, 0, 0, 7, 0, 9)]
    assert packing.check(spark.createDataFrame(bad, schema), 10).collect() == [(3, 17, 1, 1, 1, 2)]
    assert packing.check(spark.createDataFrame([], schema), 10).collect() == [(0, 0, 0, 0, 0, 0)]


def test_word_runs(spark):
    texts = ["a  b\tc\n", "", None, "x y z", "\x0b\x0c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(packing.word_runs("t").alias("n")).collect()
    assert [r["n"] for r in got] == [3, 0, 0, 2, 0]


# ---- evaluation texts

ITEM = "Before the bench in Dorby, Halwick swore that 59 riveted mirrors had been lost near Torenby by the old mill keeper. Which is right?"
OTHER = "When Kembach came to Ulham with 12 painted looms, Sorret refused them and named 3,400 crowns on the spot before noon. Which is right?"
THIRD = "On 7 July 1991 Velkan handed 199 twisted trunks to Rosmont of Lanville, who kept only 7 of them. Which is right?"
BODY = "Before the bench in Dorby, Halwick swore that 59 riveted mirrors had been lost near Torenby by the old mill keeper."


def leak_ids(spark, texts):
    docs = spark.createDataFrame([(i, t, "Labour Court Corby", "3 U 7/12", "x") for i, t in enumerate(texts)], "doc_id long, text string, court string, case_no string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, THIRD), (4, None)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text", ["court", "case_no"]).collect()}


def test_leaks_in_all_their_shapes(spark):
    w = BODY.split()
    texts = [
        "Intro words here. " + BODY + " More.",
        "x " + " ".join(w[3:15]) + " y",  # twelve words
        "x " + " ".join(w[3:14]) + " y",  # eleven
        BODY.upper().replace(",", "").replace(" ", "\n "),
        BODY.replace("riveted", "rivetcd").replace("mirrors", "mirors").replace("Halwick", "Halwikc"),
        " ".join(w[:9]) + "\n\nLabour Court Corby, 3 U 7/12, p. 2\n\n[4] " + " ".join(w[9:]),
        BODY.replace("Halwick", "███").replace("Torenby", "███").replace("mirrors", "[…]"),
        BODY.replace("Halwick", "Morrock").replace("59", "871").replace("mirrors", "barrels").replace("Torenby", "Kelham").replace("Dorby", "Ashton").replace("riveted", "gilded"),
        None,
        "",
        "Which is right?",
        BODY.replace("mirrors", "mir­rors").replace("keeper", "kee-\nper"),
        "word " * 30000 + OTHER,
        BODY + " " + BODY + " " + THIRD,
    ]
    got = leak_ids(spark, texts)
    assert got == {(i, 1) for i in (0, 1, 3, 4, 5, 6, 11, 13)} | {(12, 2), (13, 3)}


def test_no_documents_and_no_items(spark):
    assert leak_ids(spark, [None]) == set()
    docs = spark.createDataFrame([(1, BODY)], "doc_id long, text string")
    assert leaks.find_leaks(docs, "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text").count() == 0


@given(st.text(alphabet="abÀé \n\t-,.█…­ 1", max_size=60))
@settings(max_examples=150, deadline=None)
def test_words_survive_any_text(text):
    ws = words.words([text, None, text])
    first, third = [ws.text(i) for i in range(ws.first[1])], [ws.text(i) for i in range(ws.first[2], ws.first[3])]
    assert first == third and (ws.hash[: ws.first[1]] == ws.hash[ws.first[2] :]).all() and all(first)


def test_equal_words_have_equal_hashes():
    ws = words.words(["Éclair, 51,975 O'Neill", "éclair 51975 oneill"])
    assert (ws.hash[:3] == ws.hash[3:]).all()


# ---- subject areas


def court(rng, areas):
    terms = {"sport": ["goal", "referee", "striker"], "farm": ["cattle", "harvest", "barn"]}
    lines = ["Labour Court Corby, 1 U 2/03\nbetween Aldo Barn Ltd (claimant) and Bern (defendant)\n\n"]
    for a in areas:
        lines += [f"The {rng.choice(terms[a])} was examined by the court in detail. " for _ in range(4)]
    lines += ["Costs follow the event. ", "The appeal was lodged in time. "] * 3
    for a in terms:
        if a not in areas and rng.random() < 0.5:
            lines.append(f"Bern, who once dealt with the {rng.choice(terms[a])} elsewhere, was not called. ")
    rng.shuffle(lines[1:])
    return "".join(lines)


def test_areas_are_learned_and_passing_mentions_are_not(spark):
    rng = random.Random(9)
    truth = {i: [a for a in ("sport", "farm") if rng.random() < 0.5] for i in range(400)}
    docs = [(i, court(rng, a), None, "en") for i, a in truth.items()] + [(1000, None, "s", None), (1001, "  ", None, None)]
    labels = [(i, who, a) for i, areas in truth.items() if i < 260 for who in ("x", "y") for a in areas or [None]]
    got = subjects.assign(
        spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"),
        spark.createDataFrame(labels + labels[:5], "doc_id long, annotator string, subject string"),
        spark.createDataFrame([("sport",), ("farm",), ("sport",), (None,)], "subject string"),
    ).collect()
    found = {(r["doc_id"], r["subject"]) for r in got}
    want = {(i, a) for i, areas in truth.items() for a in areas}
    held = {p for p in want if p[0] >= 260}
    hit = len({p for p in found if 260 <= p[0] < 1000} & held)
    assert len(found) == len(got) and not {i for i, _ in found} & {1000, 1001}
    assert hit / len(held) > 0.95 and hit / len({p for p in found if p[0] >= 260}) > 0.95


def test_stated_probabilities_are_seen_frequencies():
    rng = random.Random(10)
    truth = [[a for a in ("farm", "sport") if rng.random() < 0.5] for _ in range(400)]
    texts = [court(rng, a) for a in truth]
    y = np.array([[float(s in a) for s in ("farm", "sport")] for a in truth])
    y[rng.sample(range(400), 40)] = 0.5
    none = [None] * 400
    m = subjects.fit(texts[:260], none[:260], none[:260], y[:260], ["farm", "sport"])
    z = m.logits(m.features(subjects.gathered(texts[260:])), subjects.side_features(none[260:], none[260:]), y[260:])
    assert subjects.reliability(1 / (1 + np.exp(-z)), y[260:]) < 0.05


def test_the_sample_is_bounded_in_documents_and_letters(spark):
    docs = spark.createDataFrame([(i, "word " * 100, None, "en") for i in range(30)] + [(30, None, None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, "x", "sport") for i in range(31)], "doc_id long, annotator string, subject string")
    assert len(subjects.labelled_sample(docs, labels)) == 30
    assert len(subjects.labelled_sample(docs, labels, chars=2600)) == 5
    assert 9 <= len(subjects.labelled_sample(docs, labels, limit=10)) <= 10


def test_no_labels_no_areas(spark):
    docs = spark.createDataFrame([(1, "a text", None, None)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, annotator string, subject string")
    assert subjects.assign(docs, none, spark.createDataFrame([("sport",)], "subject string")).count() == 0
