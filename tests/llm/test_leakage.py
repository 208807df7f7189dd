import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kasane.llm import leakage

DOC, ITEM = "doc_id long, text string, item_id long", "item_id long, text string, doc_id long"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text("abc濾", max_size=70), st.text("abc濾", max_size=70))
@settings(max_examples=200, deadline=None)
def test_bit_vectors_equal_the_table(a, b):
    assert leakage.distance(a, b) == slow_distance(a, b)


def words(rnd, n):
    return [("".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))) for _ in range(n)]


def make(seed):
    rnd = random.Random(seed)
    items = {i: words(rnd, 80) for i in range(12)}
    kana = [chr(c) for c in range(0x30A2, 0x30F3)]
    ja = {i: [rnd.choice(kana) for _ in range(160)] for i in range(20, 26)}
    docs, want = {}, set()
    for d in range(120):
        text = words(rnd, 150)
        if d % 4 == 0:
            i = rnd.choice(list(items))
            share = rnd.choice([0.2, 0.5, 0.7, 1.0])
            at = rnd.randint(0, int(80 * (1 - share)))
            part = items[i][at : at + int(80 * share)]
            for k in range(7, len(part) - 7, 14):
                part[k : k + 1] = rnd.choice([[], words(rnd, 1), [part[k], "zu"]])
            text[60:60] = [w.upper() + rnd.choice(["", ",", "\n", "<b>"]) for w in part]
            if share >= 0.5:
                want.add((d, i))
            docs[d] = " ".join(text)
        elif d % 4 == 1:
            i = rnd.choice(list(ja))
            share = rnd.choice([0.15, 0.6, 1.0])
            part = ja[i][: int(160 * share)]
            for k in range(15, len(part), 30):
                part[k] = "濾"
            docs[d] = " ".join(text[:20]) + " ".join(part[:50]) + "".join(part[50:])
            if share >= 0.5:
                want.add((d, i))
        else:
            docs[d] = " ".join(text)
    held = [(i, "Name the group. " + " ".join(w)) for i, w in items.items()] + [(i, "次の開示を読め。" + "".join(w)) for i, w in ja.items()]
    return held, docs, want


def test_planted_parts(spark):
    held, docs, want = make(5)
    d = spark.createDataFrame([(k, t, 9) for k, t in docs.items()], DOC)
    i = spark.createDataFrame([(k, t, 9) for k, t in held], ITEM)
    assert {tuple(r) for r in leakage.leaked(d, i).collect()} == want
    assert {tuple(r) for r in leakage.leaked(d, i, block=5).collect()} == want


def test_nulls_empty_repeats(spark):
    held, docs, want = make(6)
    d = spark.createDataFrame([(1, None, None), (2, "", None), (3, held[0][1], 1), (3, held[0][1], 1), (4, held[0][1] + " x" * 300_000, 1)], DOC)
    i = spark.createDataFrame([(0, held[0][1], None), (7, held[0][1], None), (8, None, None), (9, "", None), (None, "x", None)], ITEM)
    got = sorted(tuple(r) for r in leakage.leaked(d, i).collect())
    assert got == [(3, 0), (3, 0), (3, 7), (3, 7), (4, 0), (4, 7)]
    none = spark.createDataFrame([], DOC)
    assert leakage.leaked(none, i).count() == 0 and leakage.leaked(d, spark.createDataFrame([], ITEM)).count() == 0


def test_frame_is_cut(spark):
    rnd = random.Random(3)
    rows = [(i, "Read this. " + " ".join(words(rnd, 12)).capitalize() + ". Question: which code is it?", 1) for i in range(8)]
    frames = leakage.frame_sentences(spark.createDataFrame(rows, ITEM), 6)
    assert frames == {(0, "readthis"), (1, "question"), (1, "whichcodeisit")}
    assert all("".join(leakage.passage(t, frames)) == leakage.bare(t)[8:-21] for _, t, _ in rows)


def test_same_passage_is_no_frame(spark):
    """However many items ask about one passage or variants of it, none of its sentences is cut and each item is reported."""
    rnd = random.Random(4)
    sentence = [" ".join(words(rnd, 14)).capitalize() + "." for _ in range(5)]
    for count, vary in ((1, 0), (5, 0), (20, 0), (5, 1), (20, 1)):
        rows = []
        for i in range(count):
            own = sentence[:]
            if vary:
                own[i % 5] = " ".join(["zuzuki", *own[i % 5].split()[1:]])
            rows.append((i, f"{' '.join(words(rnd, 4))}? " + " ".join(own), 1))
        items = spark.createDataFrame(rows, ITEM)
        docs = spark.createDataFrame([(1, " ".join(words(rnd, 60) + sentence + words(rnd, 60)), 1), (2, " ".join(words(rnd, 200)), 1)], DOC)
        for block in (2, 2000):
            assert sorted(tuple(r) for r in leakage.leaked(docs, items, block=block).collect()) == [(1, i) for i in range(count)]


def test_pieces_meet_the_budget():
    """Pigeonhole: however e words of a run change, one whole piece of it stays."""
    rnd = random.Random(9)
    text = words(rnd, 60)
    m = leakage.Matcher([(1, text)], 0.4, (0.13, 0.07))
    borders, budget = m._pieces("".join(text), text, 0.13)
    ends = [0]
    for w in text:
        ends.append(ends[-1] + len(w))
    run = int(m.floor * len(text))
    for at in range(len(text) - run + 1):
        for _ in range(20):
            bad = set(rnd.sample(range(at, at + run), budget))
            whole = [a for a, b in zip(borders, borders[1:]) if ends[at] <= a and b <= ends[at + run] and not any(a <= ends[k] < b for k in bad)]
            assert whole


def test_planted_recall(spark):
    """Random shares, changes and places: recall 0.9 and more, nothing else found."""
    rnd = random.Random(11)
    items = {i: words(rnd, rnd.randint(40, 90)) for i in range(150)}
    stock = [words(rnd, 8) for _ in range(6)]  # phrases all passages and documents share
    for i in items:
        for s in stock[:3]:
            at = rnd.randrange(len(items[i]))
            items[i][at:at] = s
    docs, want = {}, set()
    for d in range(600):
        text = words(rnd, 120) + sum(stock, [])
        if d % 2:
            i = rnd.randrange(150)
            n = int(len(items[i]) * rnd.uniform(0.46, 1.0))
            at = rnd.randint(0, len(items[i]) - n)
            part = items[i][at : at + n]
            for k in rnd.sample(range(n), n // 11):
                part[k] = rnd.choice(["", words(rnd, 1)[0], part[k] + " " + words(rnd, 1)[0]])
            where = rnd.randrange(len(text))
            text[where:where] = part
            want.add((d, i))
        docs[d] = " ".join(text)
    got = {tuple(r) for r in leakage.leaked(spark.createDataFrame([(k, t, 1) for k, t in docs.items()], DOC), spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()], ITEM)).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.01 * len(want)
