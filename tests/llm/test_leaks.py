import random

import numpy as np

from keystrata.llm.fmindex import FMIndex, WaveletMatrix
from keystrata.llm.leaks import leaks, reduce_text, reduce_with_offsets, removal_spans

rng = random.Random(6)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4_000)]


def words(n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_index_finds_all_places():
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(50)] + [b"", b"abab" * 30, b"abab" * 30, b"\xc3\xa9" * 9]
    joined = b"\0".join(texts) + b"\0"
    ix = FMIndex(texts, 4)
    pats = [bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    m = np.zeros((len(pats), 8), np.uint8)
    for i, p in enumerate(pats):
        m[i, : len(p)] = np.frombuffer(p, np.uint8)
    lo, hi = ix.search(m, np.array([len(p) for p in pats]))
    for p, a, b in zip(pats, lo, hi):
        assert sorted(ix.locate(np.arange(a, b)).tolist()) == [i for i in range(len(joined)) if joined.startswith(p, i)]


def test_wavelet_ranks():
    s = np.array([rng.randrange(11) for _ in range(700)], dtype=np.uint8)
    w = WaveletMatrix(s, 4)
    for i in (0, 1, 63, 64, 65, 500, 700):
        assert w.rank(np.arange(11), np.full(11, i)).tolist() == [int((s[:i] == c).sum()) for c in range(11)]
    c, r = w.access_rank(np.arange(700))
    assert (c == s).all() and r.tolist() == [int((s[:i] == s[i]).sum()) for i in range(700)]


def test_reduction_keeps_offsets():
    for t in ["Caf&eacute;  <b>Ünï</b>​code-\nd", "[quote=\"x\"]A&B[/quote] &amp; ﬁne ＡＢ", "", "&#233;&bogus;", "&amp;amp;#101;x&amp;lt;b&amp;gt;y", "a [w](https://x.y/z) & 5 < 6 <b <i>", "&" * 9 + "amp;"]:
        b, begin, end = reduce_with_offsets(t)
        assert b == reduce_text(t) and len(b) == len(begin) == len(end)
        assert all(0 <= x < y <= len(t) for x, y in zip(begin, end))


def faulty(ws, kind, at):
    ws = list(ws)
    for i in sorted(at, reverse=True):
        if kind == "altered":
            ws[i] = "qq" + ws[i][::-1] + "zz"
        elif kind == "missing":
            del ws[i]
        else:
            ws[i + 1 : i + 1] = ["oh", "well"]
    return ws


def test_planted_cases(spark):
    passages = [words(30) for _ in range(12)] + [words(8)]
    docs, want = [], set()

    def add(text, *items):
        want.update((len(docs), i) for i in items)
        docs.append((len(docs), text))

    fill = lambda: " ".join(words(40))
    for k in range(12):
        p = passages[k]
        add(f"{fill()} {' '.join(p)} {fill()}", k)
        add(f"{fill()} {' '.join(p[5:25])} {fill()}", k)
        for kind in ("altered", "missing", "added"):
            add(f"{fill()} {' '.join(faulty(p[4:24], kind, [6, 13]))} {fill()}", k)
            add(f"{fill()} {' '.join(faulty(p, kind, [3, 8, 13, 18, 23]))} {fill()}")  # no 20 words with two faults
        add(f"{fill()} {' '.join(p[3:16])} {fill()}")  # too short
        add(f"{fill()}\n> {'! '.join(w.upper() for w in p[:10])}\n> <b>{'&nbsp;'.join(p[10:22])}</b> {fill()}", k)
        add("".join(c + ("\n" if i % 17 == 0 else "​" if i % 5 == 0 else "") for i, c in enumerate(" ".join(p[:21]))), k)
    add(f"{fill()} {' '.join(passages[12])}", 12)
    add(" ".join(passages[12][:7] + ["other"]))
    add(f"{' '.join(passages[0])} {fill()} {' '.join(passages[1])}", 0, 1)
    add(None)
    add("")
    add(">>> ... <br/>")
    add("long " * 300_000 + " ".join(passages[2]), 2)
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)] + [(98, None), (99, "")], "item_id long, passage string")
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    for shard in (20_000, 2_000_000):
        got = leaks(table, "doc_id", "text", items, "item_id", "passage", shard_bytes=shard, items_per_block=5)
        assert {(r.id, r.item_id) for r in got.collect()} == want
    spans = {r.id: r.spans for r in removal_spans(got).collect()}
    text = dict(docs)
    one = spans[0][0]
    assert len(spans[0]) == 1 and text[0][one.start : one.end] == " ".join(passages[0])


def test_added_words_of_any_length(spark):
    p = words(20)
    long = lambda: " ".join(words(300))
    docs = [
        " ".join([*p[:10], long(), *p[10:]]), " ".join([*p[:8], long(), *p[8:10], long(), *p[10:]]), " ".join([*p[:7], long(), *p[8:]]),  # within two faults
        " ".join([*p[:3], long(), *p[3:6], long(), *p[6:]]), " ".join([*p[:14], long(), *p[14:17], long(), *p[17:]]),
        " ".join([*p[:6], long(), *p[6:12], long(), *p[12:16], long(), *p[16:]]), " ".join([*p[:10], long()]), " ".join([*p[10:], long(), *p[:10]])]
    table = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(p))], "item_id long, passage string")
    got = leaks(table, "doc_id", "text", items, "item_id", "passage").collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4]
    assert all((s.start, s.end) == (0, len(docs[r.id])) for r in got if r.id < 2 for s in r.spans)


def test_markup_of_any_length_and_escaped_twice(spark):
    p = words(20)
    head, tail = " ".join(p[:10]), " ".join(p[10:])
    address = lambda n: "https://example.org/" + "ab-cd/" * (n // 6)
    docs = [f'{head} <a class="x" href="{address(n)}" rel=nofollow>{tail}</a>' for n in (500, 5_000, 50_000)]
    docs += [f"{head[:-1]}[url={address(n)}]{head[-1]}[/url] {tail}" for n in (500, 5_000)] + [f"[{head}]({address(900)}) [{tail}]({address(900)})"]
    docs += ["".join(f"&{'amp;' * k}#{ord(c)};" if i % 3 == 0 else c for i, c in enumerate(f"{head} {tail}")) for k in (1, 2, 9)]
    docs += [f"&lt;b&gt;{head}&lt;/b&gt; &amp;lt;i class='q'&amp;gt;{tail}"]
    docs += [f"i <think, {head}\n> {tail}", f"{head} {' '.join(words(40))} {tail}", f"{head} {' '.join(words(400))} {tail}"]
    table = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(p))], "item_id long, passage string")
    got = leaks(table, "doc_id", "text", items, "item_id", "passage").collect()
    assert sorted(r.id for r in got) == [*range(len(docs))]
    assert all(0 <= s.start < s.end <= len(docs[r.id]) for r in got for s in r.spans)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, passage string")
    full = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert leaks(docs, "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leaks(full, "doc_id", "text", items, "item_id", "passage").count() == 0


def test_repeated_rows_and_ids(spark):
    p = " ".join(words(25))
    docs = spark.createDataFrame([(1, p), (1, p), (2, p.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, p), (8, p)], "item_id long, passage string")
    got = sorted((r.id, r.item_id) for r in leaks(docs, "doc_id", "text", items, "item_id", "passage").collect())
    assert got == [(1, 7), (1, 7), (1, 8), (1, 8), (2, 7), (2, 8)]
