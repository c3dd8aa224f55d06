import random

from keystrata.llm import subjects as areas_of
from keystrata.llm.subjects import own_paragraphs, own_text, subject_counts

TERMS = {
    "Law": "verdict notary subpoena plaintiff tort hearsay probate easement affidavit juror".split(),
    "sport": "striker referee marathon scrum hurdles wicket rebound halftime regatta sprinter".split(),
    "music": "violin octave sonata melody cello trumpet metronome arpeggio ballad chorus".split(),
}
SHAPES = ["My {a} broke again, and nobody knows why.", "What would you pick, {a} or {b}?", "No {a}, no {b}.", "The {a} thread says the opposite!", "Half of the {a} talk is about {b}."]


def post(rng, subject, n):
    return " ".join(rng.choice(SHAPES).format(a=rng.choice(TERMS[subject]), b=rng.choice(TERMS[subject])) for _ in range(n))


def test_own_words():
    t = "**bob said:**\n> A quote here.\n> > deeper\n\nMine &amp; yours.\n\n[Last edited by bob on 2025-01-01; reason: typo]\n\n--\nviolin fan since 1990"
    assert own_paragraphs(t) == [["Mine & yours."]]
    assert own_text('<blockquote class="q"><blockquote>x</blockquote>y</blockquote>Own<br />two').split() == ["Own", "two"]
    assert own_text('[quote="a"][quote]x[/quote]y[/quote]Own').strip() == "Own"
    assert own_text("[quote]never closed") == ""
    assert own_text("Text\n[size=1]\nsignature").strip() == "Text"
    assert own_paragraphs("") == [] and own_paragraphs(" \n\n\t") == []
    assert own_paragraphs("One :-) Two. Three? \nFour") == [["One :-)", "Two.", "Three?", "Four"]]


def test_own_words_after_rules_and_unclosed_quotes():
    more = "The violin needs new strings. " * 20
    for rule in ("--", "-----", "~~~", "_____", "*****", "=====", "<hr>", "[size=1]"):
        assert own_text(f"One\n{rule}\n{more}\n{rule}\nviolin fan since 1990").split() == ["One", *more.split()], rule
    assert own_text("One\n--\nfan of\n--\nviolins").strip() == "One"
    assert own_text("[quote]a\n\nMine\n\n[quote]b\n\nc[/quote]Own").split() == ["Mine", "Own"]
    assert own_text("Before <blockquote>a <blockquote>b</blockquote> c\n\nMine").split() == ["Before", "Mine"]


def test_held_out_accuracy_with_dirty_labels(spark):
    rng = random.Random(7)
    docs, truth, labels = [], {}, []
    for i in range(900):
        thread = i // 6
        main = list(TERMS)[thread % 3]
        other = rng.choice([s for s in TERMS if s != main])
        text, subjects = post(rng, main, rng.randint(2, 6)), {main}
        if i % 5 == 0:
            text += "\n\n" + post(rng, other, 3)
            subjects = {main, other}
        if i % 4 == 0:
            text = f"> {post(rng, other, 4)}\n\n" + text
        if i % 3 == 0:
            text += f" It reminds me of my {rng.choice(TERMS[next(s for s in TERMS if s not in subjects)])} somehow."
        if i % 11 == 0:
            text, subjects = "Buy cheap watches now. Visit us before midnight!", set()
        docs.append((i, text, thread, "clash", "clash"))
        truth[i] = subjects
        if i % 3 == 1 and subjects:
            for s in subjects:
                labels.append((i, f" {s.upper()}" if rng.random() < 0.3 else s))
            if rng.random() < 0.08:
                labels.append((i, other))
    docs += [(10_001, None, 1, "", ""), (10_002, "", None, "", ""), (10_003, "  \n", None, "", ""), (10_004, post(rng, "Law", 20_000), None, "", "")]
    labels += [(5, None), (None, "sport"), (6, "astrology"), (99_999, "music")]
    truth |= {10_001: set(), 10_002: set(), 10_003: set(), 10_004: {"Law"}}
    d = spark.createDataFrame(docs, "doc_id long, text string, thread_id long, subject string, section string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    areas = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    got = {i: set() for i in truth}
    for r in subject_counts(d, "doc_id", "text", "thread_id", lab, "doc_id", "subject", areas, "subject").collect():
        got[r.id].add(r.subject)
        assert r.sentences >= 2
    hit = sum(len(got[i] & truth[i]) for i in truth)
    assert hit / sum(map(len, got.values())) > 0.93
    assert hit / sum(map(len, truth.values())) > 0.93


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "Some text. And more.", 1)], "doc_id long, text string, thread_id long")
    no = spark.createDataFrame([], "doc_id long, subject string")
    areas = spark.createDataFrame([("law",)], "subject string")
    assert subject_counts(d, "doc_id", "text", "thread_id", no, "doc_id", "subject", areas, "subject").count() == 0
    assert subject_counts(d.where("false"), "doc_id", "text", "thread_id", no, "doc_id", "subject", areas, "subject").count() == 0
    assert subject_counts(d, "doc_id", "text", "thread_id", no, "doc_id", "subject", areas.where("false"), "subject").count() == 0


def test_thresholds_come_from_all_labelled_documents(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, post(rng, [*TERMS][i % 3], 4), i // 6) for i in range(120)] + [(120, None, 1)]
    labels = [(i, [*TERMS][i % 3]) for i in range(0, 120, 2)] + [(0, " LAW"), (120, "sport"), (1, "astrology"), (None, "Law")]
    seen = []
    whole = getattr(areas_of, "tally", None)
    monkeypatch.setattr(areas_of, "tally", lambda *a: seen.append(whole(*a)) or seen[-1], raising=False)
    args = (spark.createDataFrame(docs, "doc_id long, text string, thread_id long").repartition(3), "doc_id", "text", "thread_id",
        spark.createDataFrame(labels, "doc_id long, subject string"), "doc_id", "subject", spark.createDataFrame([(s,) for s in TERMS], "subject string"), "subject")
    got = subject_counts(*args, hand_docs=12, other_docs=0).collect()
    assert got and seen and (seen[0][:, 2].sum(axis=1) == 60).all()  # five times the documents of the fit
    assert (seen[0][:, 1] <= seen[0][:, 0]).all() and (seen[0][:, 1] <= seen[0][:, 2]).all()


def test_sections_and_whole_texts_of_the_sample(spark):
    docs = [(1, "One. " * 300, None, "Board-A "), (2, "Two. Three.", 7, "board_a"), (3, "Four.", 7, "x"), (4, "Five.", None, " BOARD_a"), (5, "Six.", 8, ""), (6, "Seven. " * 900, 7, None), (7, None, 7, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, thread long, board string")
    labels = spark.createDataFrame([(1, "law"), (2, "music"), (3, "music")], "doc_id long, subject string")
    got = areas_of.sample(d, "doc_id", "text", ["thread", "board"], labels, "doc_id", "subject", hand_docs=9, other_docs=9, fit_chars=5_000).collect()
    by = {r.paragraphs[0][0]: (sum(map(len, r.paragraphs)), r.subjects, r.weight) for r in got}
    assert by == {"One.": (300, ["law"], 1.0), "Two.": (2, ["music"], 1.0), "Four.": (1, ["music"], 1.0), "Five.": (1, [], 0.0), "Six.": (1, [], 0.0)}  # boards don't agree
    labels = spark.createDataFrame([(1, "law"), (3, "music")], "doc_id long, subject string")
    got = areas_of.sample(d, "doc_id", "text", ["thread", "board"], labels, "doc_id", "subject", hand_docs=9, other_docs=9, fit_chars=5_000).collect()
    by = {r.paragraphs[0][0]: (r.subjects, r.weight) for r in got}
    assert by["Five."] == (["law"], 0.5) and by["Two."] == (["music"], 0.5)  # the thread first, then the board


def test_words_that_no_labelled_document_has(spark):
    rng = random.Random(11)
    chat = ["Does anybody know what became of the old page?", "I was there on a Tuesday and it rained.", "Let me know when you find something.", "My neighbour says otherwise, as usual."]
    docs, truth, labels = [], {}, []
    for i in range(360):
        subject = [*TERMS][i % 3]
        known, rest = TERMS[subject][:4], TERMS[subject][4:]
        terms = known if i < 24 else rest if i % 2 else [*rng.sample(known, 2), *rng.sample(rest, 3)]
        said = [rng.choice(SHAPES).format(a=rng.choice(terms), b=rng.choice(terms)) for _ in range(5)] + rng.sample(chat, 2)
        docs.append((i, " ".join(said), None))
        truth[i] = subject
        if i < 24:
            labels.append((i, subject))
    got = subject_counts(
        spark.createDataFrame(docs, "doc_id long, text string, thread string"), "doc_id", "text", ["thread"], spark.createDataFrame(labels, "doc_id long, subject string"),
        "doc_id", "subject", spark.createDataFrame([(s,) for s in TERMS], "subject string"), "subject").collect()
    hit = sum(truth[r.id] == r.subject for r in got)
    assert hit > 0.9 * len(got) and hit > 0.9 * len(truth)
