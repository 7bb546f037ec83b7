"""Defects, packing, leakage, pieces."""

import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebed.llm import defects as D
from sluicebed.llm import leakage
from sluicebed.llm.leakage import K, WINDOW, fingerprints, leaked_items, leaked_spans
from sluicebed.llm.packing import best_fit_decreasing, pack, packing_report, token_sizes
from sluicebed.llm.pieces import boundary_strength, cut_points, split_oversized
from sluicebed.llm.tokens import TOKEN, count_tokens
from sluicebed.llm.words import WordHashes, words

OWN = ["Problem: Nela has 12 red boxes and buys 30 more. How many boxes are there now?", None, "Student: I wrote 12 and 30 next to each other, is that wrong?"]


@pytest.mark.parametrize(
    "text, kind",
    [
        (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("​", "empty"), ("N/A", "empty"), ("...", "empty"), ("[no response]", "empty"), ("(empty)", "empty"),
        ("I can't help with that.", "refusal"), ("Sorry, I'm unable to comment on homework.", "refusal"), ("Thanks. As an AI system, I won't judge this message.", "refusal"), ("My apologies, it is not possible for me to write a hint.", "refusal"), ("I must pass on this one and will not write a hint.", "refusal"), ("No comment from me on this, sorry.", "refusal"),
        ("I can't see all of the page, but what did you try first?", None), ("Sorry for the wait. What comes next?", None), ("Here 'I can't help with that' is open enough.", None),
        ("nela has 12 red boxes and buys 30 more how many boxes are there now", "copy"), ('"You asked: I wrote 12 and 30 next to each other, is it wrong?"', "copy"),
        ("Nela has 12 red boxes. What does the word more tell you about the other 30, and could you draw it?", None),
        ("Lies noch einmal, wo Nela 12 Kisten kauft.", "other_language"), ("¿Qué te dice el número 30 sobre las cajas?", "other_language"), ("Relis la partie où Nela perd 20 boîtes.", "other_language"), ("Сколько коробок у неё теперь?", "other_language"),
        ("What do the 12 and the 30 each tell", "truncated"), ("Count the boxes and then the,", "truncated"), ("Think about the boxes …", "truncated"), ('Imagine 53 square "', "truncated"), ("Use this: ```x = 1", "truncated"), ("Look at the boxes (they are red.", "truncated"),
        ("What do you see? :)", None), ("Try it once more. (Take your time.)", None), ('"What do you see?"', None), ("Steps:\n- count the red boxes\n- add the 30", None), ("Good try, keep going!", None), ("The wording 'it again? (Take your' was fair. It fits.", None),
    ],
)
def test_defect_kinds(text, kind):
    assert D.defect_of(text, OWN) == kind


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Compute y = 2 x plus 5.", None), ("y = 3x + 7, correct?", None), ("Die 3 is red, sum x + y per row.", None), ("Plus 5 y, minus 3 x!", None), ("Total: 5 per son.", None),
        ("I am not sure my earlier answer was right, so let me review it.", None), ("You should not skip steps; show me how you answer part b.", None), ("I think you can't write it that way. Try again.", None), ("I do not think the last answer helps you.", None),
        ("I am not certain, but let us look at it together.", None), ("My tutor does not help me, she says. What does she do?", None),
        ("I will not assess this message.", "refusal"), ("It is not my place to review this.", "refusal"), ("We are not able to discuss the matter here.", "refusal"), ("Since I can't comply, I stop here.", "refusal"),
        ("Do it like this:\n1. Add the numbers.\n2. Subtract the sm", "truncated"), ("Steps:\n1. Add 3\n2. Take 4 and the", "truncated"), ("Steps:\n1. Add 3\n2. Take 4 boxes", None), ("Do this:\n- Add the 3.\n- Take 4.", None), ("- one;\n- two;\n- thr", "truncated"),
        ("This is <b>bold and <i>both.", "truncated"), ("This is <b>bold</b> and <i>slanted</i>.", None), ("<p>Look at it again.</p>", None), ("Look at it again.</p", "truncated"), ("<ul><li>Add 3.</li><li>Take 4.</ul>", None), ("So a < b and c > d here.", None),
        ("\n\n".join("nela has 12 red boxes and buys 30 more how many boxes are there now".split(" ")).replace("\n", " " * 60), "copy"),
        ("See \\(x + 2 for it.", "truncated"), ("See \\(x + 2\\) for it.", None), ("Let $$x = 2$$ be given.", None), ("\\begin{align} x = 2.", "truncated"), ("Use ```x = (1``` for it.", None), ("«Look at (the 3) and [the 4].»", None),
    ],
)
def test_defects_of_sentences_not_used_for_the_rules(text, kind):
    assert D.defect_of(text, OWN) == kind


def slow_tiles(a, b, shortest=2):
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    for n in range(min(len(a), len(b)), shortest - 1, -1):
        i = 0
        while i + n <= len(a):
            j = next((j for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n] and all(free_a[i : i + n]) and all(free_b[j : j + n])), None)
            if j is not None:
                free_a[i : i + n] = free_b[j : j + n] = [False] * n
                covered += n
            i += 1 if j is None else n
    return covered


def test_tiling_equals_brute_force_and_stays_fast():
    rng = random.Random(6)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcdef"
        a, b = rng.choices(letters, k=rng.randint(0, 30)), rng.choices(letters, k=rng.randint(0, 30))
        assert D.tiled_words(a, b) == slow_tiles(a, b)
    began = time.perf_counter()
    for n in (2000, 20_000):
        D.tiled_words(["the", "cat"] * n, ["cat", "the", "the"] * n)
        D.tiled_words(rng.choices("ab", k=n), rng.choices("ab", k=n))
    assert time.perf_counter() - began < 20


def test_tiling_equals_its_definition():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices("abc", k=rng.randint(0, 12)), rng.choices("abc", k=rng.randint(0, 12))
        n = D.tiled_words(a, b)
        assert 0 <= n <= min(len(a), len(b)) and (n == len(a) if a == b and len(a) > 1 else True)
    assert D.tiled_words("the red box is here now".split(), "is here now the red box".split()) == 6


def test_defects_table(spark):
    schema = "id string, problem string, conversation_history array<string>, candidate_message string, verdict string, reasoning string, rewritten_message string, defect string"
    rows = [
        ("1", None, None, "What did you try first, and why?", "adequate", "It asks a question.", None, "x"),
        ("1", None, None, "What did you try first, and why?", "adequate", "It asks a question.", None, "x"),
        ("2", "Find 2 + 2.", [None, ""], "Find 2 + 2.", None, "  ", None, "x"),
        ("3", "", [], "long " * 50_000 + "end.", "vague_unhelpful", "I decline to answer.", "What did you try first and why?", "x"),
        (None, "p", [], None, None, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    args = ("id", D.FIELDS, "problem", "conversation_history", "candidate_message", "verdict")
    got = {(r.id, r.field_name, r.defect) for r in D.find_defects(df, *args).collect()}
    assert got == {("2", "candidate_message", "copy"), ("2", "reasoning", "empty"), ("2", "rewritten_message", "empty"), ("3", "reasoning", "refusal")}
    assert D.find_defects(df.limit(0), *args).count() == 0


@given(st.text() | st.text(st.characters(max_codepoint=255)))
def test_count_tokens(text):
    assert count_tokens(text) == len(TOKEN.findall(text))


def brute_best_fit(sizes, capacity):
    rooms = []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms), sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 100])
def test_best_fit_equals_brute_force(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 5, 300):
        sizes = sorted((rng.randint(0, capacity) for _ in range(n)), reverse=True)
        got = best_fit_decreasing(sizes, capacity)
        load = {}
        for s, k in zip(sizes, got):
            load[k] = load.get(k, 0) + s
        assert (len(load), sorted(capacity - v for v in load.values())) == brute_best_fit(sizes, capacity)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60)) for i in range(300)] + [(900, "w " * 250), (901, None), (902, ""), (None, "w"), (5, "w"), (903, "w " * 200)]
    df = spark.createDataFrame(rows, "doc int, text string").withColumn("id", F.lit("x"))
    packed = pack(token_sizes(df, "doc", "text"), 100, group_items=80)
    got = packed.collect()
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 100 and {r.id for r in got} == {i for i, _ in rows if i is not None}
    assert sorted((r.part, r.n_tokens) for r in got if r.id == 900) == [(0, 100), (1, 100), (2, 50)]
    assert sorted(r.n_tokens for r in got if r.id == 903) == [100, 100]
    assert all(r.n_parts == 1 for r in got if r.id not in (900, 903))
    report = packing_report(packed, 100).first()
    assert report.n_containers == len(load) and report.n_tokens == sum(load.values()) and report.share_filled > 0.9
    assert packed.orderBy("id", "part").collect() == pack(token_sizes(df.repartition(7), "doc", "text"), 100, group_items=80).orderBy("id", "part").collect()
    assert pack(token_sizes(df.limit(0), "doc", "text"), 100).count() == 0


def test_parts_of_one_item_are_spread(spark):
    df = spark.createDataFrame([(1, 100_000), (2, 30), (3, None)], "id int, n_tokens bigint").na.fill(0)
    got = pack(df, 10, group_items=500).collect()
    assert len(got) == 10_004 and sum(r.n_tokens for r in got) == 100_030 and len({r.container_id >> 32 for r in got}) > 15


def test_winnowing_guarantee():
    rng = random.Random(3)
    hashes = WordHashes()
    for _ in range(200):
        shared = [f"s{rng.randrange(9)}" for _ in range(K + WINDOW - 1)]
        a = [f"a{rng.randrange(50)}" for _ in range(rng.randint(0, 30))] + shared + [f"a{rng.randrange(50)}" for _ in range(rng.randint(0, 30))]
        b = [f"b{rng.randrange(50)}" for _ in range(rng.randint(0, 30))] + shared + [f"b{rng.randrange(50)}" for _ in range(rng.randint(0, 30))]
        assert set(fingerprints(a, hashes)[1].tolist()) & set(fingerprints(b, hashes)[1].tolist())


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(f"p{i}", " ".join(rng.choices(vocab, k=rng.randint(5, 30))), None if i % 5 == 0 else " ".join(rng.choices(vocab, k=15)), "") for i in range(20)]
    docs = []
    for i in range(120):
        t = rng.choices(vocab, k=rng.randint(0, 40))
        if i % 2:
            source = words(rng.choice(items)[1])
            n = rng.randint(8, 20)
            at = rng.randrange(max(1, len(source) - n))
            t[len(t) // 2 : len(t) // 2] = source[at : at + n]
        docs.append((i, ", ".join(t).title()))
    docs += [(None, items[0][1]), (500, None), (501, ""), (502, items[1][1] + " " + items[1][1]), (502, items[1][1] + " " + items[1][1])]
    c = spark.createDataFrame(docs, "doc_id int, text string").withColumns({"part": F.lit(1), "pos": F.lit(2), "hash": F.lit(3)})
    p = spark.createDataFrame(items + items[:2] + [(None, items[0][1], None, "")], "id string, problem string, text string, extra string")
    spans = leaked_spans(c, "doc_id", "text", p, "id", ["problem", "text"])
    grams = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs if d is not None for i, *fields, _ in items if any(grams(t) & grams(f) for f in fields)}
    rows = spans.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and min(r.n_words for r in rows) >= 12
    assert {r.item_id: r.n_docs for r in leaked_items(spans).collect()} == {i: len({d for d, j in want if j == i}) for _, i in want}
    assert leaked_spans(c.limit(0), "doc_id", "text", p, "id", ["problem"]).count() == 0
    assert leaked_spans(c, "doc_id", "text", p.limit(0), "id", ["problem"]).count() == 0
    with pytest.raises(ValueError):
        leaked_spans(c, "doc_id", "text", p, "id", ["problem"], span=11)


def text_of(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(["word", "x", "12", "(a)", "is", "it's"]) + rng.choice(["", "", "", "", ".", ",", ";"]))
        out.append(rng.choice([" "] * 30 + ["\n", "\n\n", "  "]))
    return "".join(out)


@pytest.mark.parametrize("limit, overlap", [(512, 64), (50, 0), (50, 49), (7, 3), (1, 0)])
def test_pieces_properties(limit, overlap):
    rng = random.Random(limit)
    for n in (0, 1, 30, 400, 3000):
        text = text_of(rng, n)
        spans = [m.span() for m in TOKEN.finditer(text)]
        cuts = cut_points(text, spans, limit, overlap)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(spans)
        assert all(0 <= e - s <= limit for s, e in cuts)
        assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(cuts, cuts[1:]))


def test_pieces_prefer_boundaries():
    text = " ".join(["word"] * 60 + ["end.\n\n"] + ["word"] * 50)
    spans = [m.span() for m in TOKEN.finditer(text)]
    assert cut_points(text, spans, 80, 0) == [(0, 62), (62, 112)]


def test_pieces_of_a_long_text():
    rng = random.Random(9)
    text = " ".join(" ".join(["word"] * rng.randint(4, 24)) + rng.choice([".", ".", "?", ".\n\n"]) for _ in range(28_000))
    spans = [m.span() for m in TOKEN.finditer(text)]
    cuts = cut_points(text, spans, 512, 64)
    least = -(-(len(spans) - 64) // 448)
    natural = sum(boundary_strength(text, spans, e) >= 3 for _, e in cuts[:-1])
    assert len(spans) > 400_000 and least <= len(cuts) <= least + least // 16 and natural == len(cuts) - 1
    assert all(e - s <= 512 for s, e in cuts)


def test_pieces_table(spark):
    rng = random.Random(5)
    rows = [(i, text_of(rng, n)) for i, n in enumerate([10, 200, 900, 2000, 20_000])] + [(50, None), (51, ""), (None, "a " * 200), (52, "ü" * 5000), (53, "a" + "-" * 300)]
    df = spark.createDataFrame(rows + rows[2:3], "doc_id bigint, body string").withColumns({"id": F.lit("x"), "text": F.lit("y"), "piece_no": F.lit(0)})
    got = split_oversized(df, "doc_id", "body", 100, 10).orderBy("id", "piece_no").collect()
    texts = dict(rows)
    assert {r.id for r in got} == {i for i, t in rows if i is not None and t and len(TOKEN.findall(t)) > 100}
    for i in {r.id for r in got}:
        mine = [r for r in got if r.id == i]
        assert [r.piece_no for r in mine] == list(range(mine[0].n_pieces)) and max(r.n_tokens for r in mine) <= 100
        assert all(len(TOKEN.findall(r.text)) == r.n_tokens and texts[i][r.start_char : r.end_char] == r.text for r in mine)
        joined = mine[0].text + "".join(texts[i][a.end_char : b.end_char] for a, b in zip(mine, mine[1:]))
        assert joined == texts[i]
    assert split_oversized(df.limit(0), "doc_id", "body", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "doc_id", "body", 10, 10)


UNWILLING = "don't|don’t|not|cant|wont|never|cannot|unable to|unwilling to|declining to|refusing to|refraining to|abstaining to|pass on|skipping|avoiding|uncomfortable to|inappropriate to|improper to|barred|forbidden|prohibited|impossible to|reluctant to|hesitant to|outside|beyond|against|rather leave|sit this".split("|")
DECLINING = [f"For me it is {x}, to help." for x in UNWILLING] + [
    "No comment.", "I refuse.", "I must decline.", "I may pass on.", "I abstain.", "As an AI I cannot.", "As a language model I am unable.", "Count me out.", "I'll pass.",
    *(f"The guidelines {x} it." for x in ("do not allow", "may not permit", "forbid", "prohibit", "prevent")),
    "That is outside my role.", "It is beyond our scope.", "This is not part of my job.", "It is beyond what I may say.", "I lack the knowledge here to do so.", "There is risk in discussing it.",
    "Please ask a teacher instead. You may contact support for help.", "Perhaps a teacher knows. Perhaps another tutor knows.", "You can ask them for help. You might consult her for help.", "Please see your book instead. Please turn to her instead.",
]


@pytest.mark.parametrize("text", DECLINING)
@pytest.mark.parametrize("gap", [" ", "\n", "\t", "  ", ' "so it is" '])
def test_no_branch_of_the_grammar_fires_without_a_hint(text, gap):
    assert D.declines(text)
    spread = text.replace(" ", gap).lower()
    assert D.may_decline(spread) or not D._grammar_declines(spread)
    assert D.declines(spread) == D._grammar_declines(spread)
