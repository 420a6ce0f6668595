"""Passages across page headers and changed words."""

import random

import pytest

from ledgerweave.llm import leaks

ITEM = [f"{a}{b}" for a in ("mora", "bel", "tuvi", "sanko", "drel", "opha") for b in ("ne", "rath", "gild", "sum", "vex")]


def find(text, columns=""):
    return [r[:4] for r in leaks.Finder([7], [" ".join(ITEM)]).find([text], [columns])]


@pytest.mark.parametrize("columns", ["Labour Court Oliham", "Labour Court Oliham 1-U-3373/08", "Labour Court Oliham 1U3373/08", ""])
@pytest.mark.parametrize("heading", ["Labour Court Oliham \u2014 1 U 3373/08\nbetween A and B\n\n", ""])
def test_a_page_header_is_known_from_the_text(columns, heading):
    page = "Page 2  Labour Court Oliham  1 U 3373/08"
    text = f"{heading}One two three. {' '.join(ITEM[:10])}\n\n{page}\n\n{' '.join(ITEM[10:20])} four five six."
    assert find(text, columns) == [(0, 7, 20, False)]


def test_words_of_the_body_are_no_header():
    text = f"Labour Court Oliham \u2014 1 U 3373/08\n\n{' '.join(ITEM[:10])} the claim was dismissed {' '.join(ITEM[10:20])} four."
    assert find(text, "Labour Court Oliham") == []


@pytest.mark.parametrize(("kept", "run"), [(8, 21), (17, 17), (15, 15)])
def test_a_changed_word_does_not_hide_what_follows_it(kept, run):
    text = " ".join(["before", *ITEM[:kept], "quite", *ITEM[kept + 1 :], "after"])
    assert find(text) == [(0, 7, run, False)]
    assert find(" ".join(["before", *ITEM[:8], "quite", *ITEM[9:15], "again", *ITEM[16:], "after"])) == [(0, 7, 14, False)]


QUESTIONS = ["Who may claim the boats?", "State who may claim.", "Choose the right outcome.", "Which of the two is bound by it?"]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_a_passage_that_items_share_is_found_for_each(n):
    first, second = " ".join(ITEM[:18]), "Halwick of Dorby had 59 mirrors."
    items = [f"{first}. {second} {q}" for q in QUESTIONS[:n]]
    finder = leaks.Finder(list(range(n)), items)
    assert {r[1] for r in finder.find([f"before {first} after"], [""])} == set(range(n))
    assert finder.find([" ".join(QUESTIONS) + f" {second}"], [""]) == []


def test_questions_before_and_after_are_no_part_of_a_short_passage():
    body = "Halwick of Dorby lost 59 riveted mirrors"
    finder = leaks.Finder([1, 2, 3], [f"Who is right? {body}.", f"{body}. State who may claim.", f"{body}."])
    assert {r[1] for r in finder.find([f"x {body} y"], [""])} == {1, 2, 3}
    assert finder.find([f"x {' '.join(body.split()[:5])} y. State who may claim. Who is right?"], [""]) == []


def slip(rng, word):
    i, letter = rng.randrange(len(word)), rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice([word[:i] + letter + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + word[i + 1 :] or letter, word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :]])


@pytest.mark.parametrize(("length", "slips", "of"), [(3, 1, 0), (4, 1, 0), (5, 2, 0), (8, 2, 0), (11, 2, 0), (20, 2, 12), (20, 4, 12), (30, 6, 0)])
def test_candidates_against_brute_force(length, slips, of):
    """Every planted passage is there by construction; at least nine in ten must be found, and nothing else."""
    rng = random.Random(length * 10 + slips)
    stock = ["the", "of", "and", "to", "his", "with", "that", *("".join(rng.choice("aeioubdkmrst") for _ in range(rng.randrange(3, 9))) for _ in range(600))]
    items = [[rng.choice(stock) for _ in range(length)] for _ in range(150)]
    texts = []
    for w in items:
        part = w[3 : 3 + of] if of else list(w)
        for i in rng.sample(range(len(part)), slips):
            part[i] = slip(rng, part[i])
        rest = [rng.choice(stock) for _ in range(300)]
        texts.append(" ".join([*rest[:150], *part, *rest[150:]]))
    got = {(r[0], r[1]) for r in leaks.Finder(list(range(150)), [" ".join(w) for w in items]).find(texts, [""] * 150)}
    assert sum((k, k) in got for k in range(150)) >= 135
    assert length < 5 or len(got) <= 152


def test_blocks_of_items_give_the_same(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM)), (2, "x " + " ".join(ITEM[5:20])), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(str(i), " ".join(ITEM[i : i + 14])) for i in range(16)] + [("n", None), ("e", "")], "item_id string, text string")
    one = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    many = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text", block_chars=300).collect()
    assert sorted(one) == sorted(many) and len({(r["doc_id"], r["item_id"]) for r in one}) == len(one) > 16
    assert all(r["contained"] == 1.0 for r in one if r["doc_id"] == 1 and r["whole"])
