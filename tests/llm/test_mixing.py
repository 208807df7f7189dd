from hypothesis import given, settings
from hypothesis import strategies as st

from kasane.llm import mixing

DOC, TARGET = "doc_id long, text string, source string, n_tokens long", "source string, target_share double, max_repeats int, text string"


def reachable(counts, budget):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=5), st.integers(0, 150))
@settings(max_examples=150, deadline=None)
def test_knapsack_is_exact(counts, budget):
    out = mixing.knapsack(counts, budget)
    assert all(k <= counts[n] for n, k in out.items())
    assert sum(n * k for n, k in out.items()) == reachable(counts, budget)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=20), st.integers(0, 5000), st.sampled_from([1, 64, 1 << 14]))
@settings(max_examples=300, deadline=None)
def test_fit_is_the_best_sum(counts, budget, whole):
    out = mixing.fit(counts, budget, whole)
    got = sum(n * k for n, k in out.items())
    assert all(0 < k <= counts[n] for n, k in out.items()) and got <= budget
    total = sum(n * c for n, c in counts.items())
    sums = 1
    for n, c in counts.items():
        for _ in range(c):
            sums |= sums << n
    assert got == (total if budget >= total else (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1)


def test_fit_of_large_and_awkward_budgets():
    big = {n: 1000 + n for n in range(20, 900)}
    assert sum(n * k for n, k in mixing.fit(big, 123_456_789).items()) == 123_456_789
    even = {n: 500 for n in range(20, 400, 2)}
    assert sum(n * k for n, k in mixing.fit(even, 10_000_001).items()) == 10_000_000
    assert sum(n * k for n, k in mixing.fit({300_001: 40, 7: 1}, 900_000).items()) == 600_009


def table(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 17), " Big " if i % 2 else "BIG", 1) for i in range(300)]
    rows += [(1000 + i, f"small text {i} " + "thing " * (i % 5), "small", 1) for i in range(20)] + [(2000 + i, "small text 3 " + "thing " * 3, "small", 1) for i in range(5)]
    rows += [(3000, None, "small", 1), (3001, "", "big", 1), (3002, "no target", "other", 1), (3003, "x", None, 1)]
    return spark.createDataFrame(rows, DOC)


def test_shares_caps_and_repeats(spark):
    targets = spark.createDataFrame([("big", 0.6, 1, "c"), ("Small ", 0.3, 3, "c"), ("absent", 0.1, 2, "c"), (None, 0.5, 1, "c"), ("zero", 0.0, 1, "c")], TARGET)
    made = mixing.Mixture(table(spark), targets)
    report = {r.source: r for r in made.report().collect()}
    assert set(report) == {"big", "small", "absent"} and report["absent"].tokens == 0
    assert abs(report["big"].actual_share - 2 / 3) < 0.01 and abs(report["small"].actual_share - 1 / 3) < 0.01
    assert report["big"].most_copies == 1 and report["small"].most_copies <= 3
    rows = made.mixture().collect()
    assert len({r.doc_id for r in rows}) == len(rows) and not any(r.doc_id >= 2000 for r in rows)
    again = {(r.doc_id, r.copies) for r in mixing.mix(table(spark), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    other = {r.doc_id for r in mixing.mix(table(spark), targets, seed=3, total=500).collect()}
    assert other and sum(r.n_tokens * r.copies for r in mixing.mix(table(spark), targets, total=500).collect()) <= 500


def test_empty(spark):
    targets = spark.createDataFrame([("big", 0.6, 1, "c")], TARGET)
    assert mixing.mix(spark.createDataFrame([], DOC), targets).count() == 0
    assert mixing.mix(table(spark), spark.createDataFrame([], TARGET)).count() == 0
    assert mixing.mix_report(spark.createDataFrame([], DOC), targets).first().tokens == 0


def test_blocks_keep_tokens():
    enc = mixing.token_counter(mixing.TOKENIZER)
    text = "One two  three\n four. " * 9000 + "濾過" * 5000
    parts = list(mixing.blocks(text, 1000))
    assert "".join(parts) == text and len(parts) > 50
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
