import pytest

from kasane.llm import residue

SCHEMA = "doc_id long, text string, reason string"

BAD = [
    "Error 502: Bad Gateway.", "(404) お探しのページは見つかりませんでした。", "This viewer needs JavaScript. Turn on scripts in your browser and reload F16H1/00.",
    "セッションの有効期限が切れました。再度ログインしてください。", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "TBD TBD TBD", "ここに説明文が入ります。",
    "See {{title}} for details.", "[INSERT DATE HERE]の説明。", "The gap is %(width)s wide.", "<html><body><h1>503 Service Unavailable</h1></body></html>", "ＰＬＥＡＳＥ ＥＮＡＢＬＥ ＪＡＶＡＳＣＲＩＰＴ and cookies to continue.",
]
GOOD = [
    "Group F16H1/00 covers servers that return an error page such as 404 Not Found when a gauge resource is missing.",
    "Methods for detecting that JavaScript is disabled in a browser, and for offering a fallback, go to F16H1/00.",
    "Template engines that replace a placeholder like {{title}} by stored text are classified in F16H1/00.",
    "ひな形の差込欄（例：{{title}}）を帳票の本文に置換する装置を含む。", "The set {shaft, wheel} is written in braces; the sum over {i} runs to 51.",
    "スクリプトが無効であることを検出し代替表示を行うものはF16H1/00を参照。", "Ranges above 404 mm are rare.", "伏せ字「○○」を辞書で補完する処理を含む。", "", None,
]


def test_found_and_clean(spark):
    rows = [(i, t, "clash") for i, t in enumerate(BAD)] + [(100 + i, t, "clash") for i, t in enumerate(GOOD)] + [(50, BAD[0], None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in residue.residue_documents(docs).collect()}
    assert got == set(range(len(BAD))) | {50}
    kept = residue.clean_documents(docs)
    assert {r.doc_id for r in kept.collect()} == {100 + i for i in range(len(GOOD))} and kept.columns == docs.columns


def test_empty(spark):
    assert residue.residue_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_weak_notation_needs_a_learned_name(spark):
    learned = [(1, "{{scope}}"), (2, "${scope}"), (3, "[[scope]]"), (4, "The {scope} is empty."), (5, "The sum over {index} runs to 5.")]
    docs = spark.createDataFrame(learned, "doc_id long, text string")
    assert {r.doc_id for r in residue.residue_documents(docs).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("times", [1, 3])
def test_tree_merges_variable_words(times):
    tree = residue.Tree()
    for word in ("a", "b", "c") * times:
        tree.add(residue.mask(f"The blue wheel with the {word} spoke has a rim of 12 teeth."))
    (leaf,) = tree.leaves.values()
    assert len(leaf) == 1 and leaf[0][1] == 3 * times and residue.WILD in leaf[0][0]


def test_templates_are_counted(spark):
    docs = spark.createDataFrame([(i, f"Error {500 + i}: bad gateway. The ramp is {i} m long.", "") for i in range(6)], SCHEMA)
    rows = residue.Residue(docs).templates().collect()
    assert sorted((r.n, r.residue) for r in rows) == [(6, False), (6, True)]


def test_wordings_left_out_of_the_sample():
    """Tenfold cross-validation: sentences the classifier never saw."""
    bad, good = (residue.samples.lines(x) for x in (residue.samples.RESIDUE, residue.samples.ORDINARY))
    hit = wrong = 0
    for k in range(10):
        c = residue.Classifier([s for i, s in enumerate(bad) if i % 10 != k], [s for i, s in enumerate(good) if i % 10 != k])
        hit += sum(c.score(residue.mask(residue.fold(s))) >= residue.LIMIT for s in bad[k::10])
        wrong += sum(c.score(residue.mask(residue.fold(s))) >= residue.LIMIT for s in good[k::10])
    print(hit / len(bad), wrong / len(good))
    assert hit >= 0.8 * len(bad) and hit >= 0.9 * (hit + wrong)


# Wordings in none of the lists, written after the sample.
UNSEEN = [
    "You will need to switch on JavaScript before this site can be used.", "This tool only works when scripts are allowed to run.", "Your browser has scripts blocked, so no list is drawn.",
    "We were unable to find the page you asked for.", "The requested document no longer exists on our server.", "Sorry, you are not permitted to open this record.",
    "You need to log in before you can view this entry.", "Your login has expired, please sign in once more.", "The database server is not responding at the moment.",
    "The application encountered a fatal error and was stopped.", "Our service is down for planned maintenance until 6:00.", "Too many requests, please wait a minute and retry.",
    "スクリプトを許可してから再度お試しください。", "ページの読み込み中にエラーが発生しました。", "ご指定のファイルは見つかりませんでした。", "ログインの有効期限が切れたため表示できません。", "サーバーが混雑しているため接続できません。",
    "Velit esse cillum dolore magna aliqua nostrud.", "Sample text goes here.", "ここに見出しが入ります。",
]


def test_unseen_wordings(spark):
    docs = spark.createDataFrame([(i, s, "") for i, s in enumerate(UNSEEN)], SCHEMA)
    assert residue.residue_documents(docs).count() >= 0.9 * len(UNSEEN)


SLOTS = ["Dear [First Name],", "See <INSERT TITLE> now.", "Item {0} of {1}.", "Hello $name$ again.", "{$title} is short.", "%name% is new.", "Fill @@x@@ in.", "【氏名】は必須。", "Der &lt;name&gt; fehlt.", "__DATE__ it.", "[[title]]"]
FREE = ["[[tanuwick]] is a link.", "x[i] and list[0]", "The set = {0} is small.", "<b>bold</b> and <title>", "a %d and 5 % of it", "{housing, nozzle}", "mail me @ home or @ work"]


def test_slot_grammar(spark):
    docs = spark.createDataFrame([(i, s, "") for i, s in enumerate(SLOTS)] + [(100 + i, s, "") for i, s in enumerate(FREE)], SCHEMA)
    assert {r.doc_id for r in residue.residue_documents(docs).collect()} == set(range(len(SLOTS)))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "濾過 " * 100_000 + "{{title}}")], "doc_id long, text string")
    assert 2 in {r.doc_id for r in residue.residue_documents(docs).collect()}


def test_verdict_does_not_depend_on_other_documents(spark):
    bad = ["Your session has expired.", "Your session has ended.", "This page cannot be displayed.", "This page cannot be shown."]
    good = ["Your session has started.", "This page cannot be folded.", "Your session has 3 parts."]
    rows = [(i, t) for i, t in enumerate(bad + good)]
    for part in (rows, rows[::-1], *([r] for r in rows)):
        docs = spark.createDataFrame(part, "doc_id long, text string").coalesce(1)
        assert {r.doc_id for r in residue.residue_documents(docs).collect()} == {i for i, t in part if t in bad}


def test_merging_tasks_keeps_verdicts():
    for a in ("expired", "ended", "started"):
        for b in ("expired", "ended", "started"):
            tree = residue.Tree()
            for word in (a, b, a):
                tree.add(residue.mask(f"Your session has {word}."))
            assert all(residue.judged(tuple(t)) == verdict for ts in tree.leaves.values() for t, _, verdict in ts)
            assert sum(n for ts in tree.leaves.values() for _, n, _ in ts) == 3


def test_score_is_the_sum_of_the_features():
    c = residue.classifier()
    for s in residue.samples.lines(residue.samples.RESIDUE + residue.samples.ORDINARY) + UNSEEN + SLOTS + ["TBD TBD TBD TBD", "本文 本文 本文 a", ""]:
        tokens = residue.mask(residue.fold(s))
        found = residue.features(tokens)
        assert abs(c.score(tokens) - (sum(c.weight.get(f, 0.0) for f in found) / max(4, len(found)) ** 0.5 + c.bias)) < 1e-9
