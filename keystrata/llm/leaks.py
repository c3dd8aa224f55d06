"""Evaluation texts leaking into training text: an FM-index for each shard of the corpus, searched for pieces of all passages.

Texts and passages are reduced to letters and digits (entities decoded, markup, marks and case removed), written without
blanks, so that spacing, line breaks within words, quoting and punctuation cannot matter. A window of `window` words with at
most `errors` words altered, missing or followed by added ones holds an unaltered run of
(window - errors) // (errors + 1) words; every such run of every passage is searched in the shard's index. Runs that occur
are joined and extended to both sides, over at most `errors` faults, until they prove a window or fail to. What stands in place
of an altered word or after a word may be of any length: it is looked for nearby first, then in the whole text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keystrata.llm.fmindex import FMIndex
from keystrata.session import ship

#: What is not text: a character entity (escaped any number of times), a tag of HTML, a tag of BBCode, the address of a Markdown
#: link. A tag may be of any length if its attributes are well formed; up to 400 characters anything may
#: stand in it, but no blank before its end, where a `>` may begin a quoted line.
MARK = re.compile(
    r"""&(?:amp;)*+(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});
    |</?[A-Za-z][\w:-]*+(?:\s++[\w:.@-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"']*+))?+)*+\s*+/?>
    |</?[A-Za-z][^<>]{0,400}(?<!\s)>
    |\[/?(?:quote|b|i|u|s|url|img|code|size|color|font|center|list|spoiler|\*)(?:=[^\[\]]*+)?\]
    |\]\((?:https?:|www\.|mailto:|[/\#])[^()\s]*+(?:\s++"[^"]*+")?\)""",
    re.IGNORECASE | re.VERBOSE)
_AMP = re.compile("(?:amp;)+", re.IGNORECASE)
DROP = re.compile(r"[\W_]+")
#: Bytes in the place of one altered word, or between a word and the next, within which the next word is first looked for.
GAP = 80


def _mark(m: re.Match) -> str:
    """What a mark stands for: the character of an entity, nothing else."""
    if m[0][0] != "&":
        return ""
    return html.unescape("&" + (_AMP.sub("", m[0][1:], 1) or "amp;"))


def _may_mark(text: str) -> bool:
    return "&" in text or "<" in text or "[" in text or "](" in text


def _unmark(text: str) -> str:
    """`text` without marks. What was escaped may be markup itself, so it goes on until nothing is left to take away."""
    while _may_mark(text):
        less = MARK.sub(_mark, text)
        if len(less) >= len(text):
            return less
        text = less
    return text


_LOWER = bytes(range(128)).lower() + bytes(range(128, 256))
_NEITHER = bytes(i for i in range(128) if not chr(i).isalnum())


def _fold(s: str) -> bytes:
    """Letters and digits alone: compatible forms, marks and case taken away."""
    if not s.isascii():
        s = DROP.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", s).casefold()).lower())
        return s.encode()
    return s.encode().translate(_LOWER, _NEITHER)


def reduce_text(text: str) -> bytes:
    """Letters and digits of a text, folded, without anything between them."""
    return _fold(_unmark(text))


class _Folded(dict):
    """The reduced bytes of single characters."""

    def __missing__(self, c: str) -> bytes:
        b = _fold(c)
        if len(self) < 100_000:
            self[c] = b
        return b


_folded = _Folded()


def reduce_with_offsets(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """As `reduce_text`, with the first and one past the last character of `text` that each byte comes from."""
    begin = np.arange(len(text))
    end = begin + 1
    while _may_mark(text):
        out, lo, hi, at = [], [], [], 0
        for m in MARK.finditer(text):
            said = _mark(m)
            out += [text[at : m.start()], said]
            lo += [begin[at : m.start()], np.repeat(begin[m.start()], len(said))]
            hi += [end[at : m.start()], np.repeat(end[m.end() - 1], len(said))]
            at = m.end()
        if not at:
            break
        less = "".join([*out, text[at:]])
        begin, end = np.concatenate([*lo, begin[at:]]), np.concatenate([*hi, end[at:]])
        done = len(less) >= len(text)
        text = less
        if done:
            break
    each = [_folded[c] for c in text]
    n = np.fromiter(map(len, each), np.int64, len(each))
    return b"".join(each), np.repeat(begin, n), np.repeat(end, n)


class Passages:
    """Passages as reduced words, and the distinct runs of words to search for."""

    def __init__(self, items: list[tuple], window: int, errors: int):
        self.ids = [i for i, _ in items]
        self.words = [[w for w in (_fold(x) for x in _unmark(p or "").split()) if w] for _, p in items]
        self.begin = [np.concatenate([[0], np.cumsum([len(w) for w in ws])]).astype(np.int64) for ws in self.words]
        at: dict[bytes, list[tuple[int, int]]] = {}
        self.need = [min(window, len(ws)) for ws in self.words]
        self.errors = [errors * n // window for n in self.need]
        self.run = [max(1, (n - e) // (e + 1)) for n, e in zip(self.need, self.errors)]
        for k, ws in enumerate(self.words):
            run = self.run[k]
            for j in range(len(ws) - run + 1):
                at.setdefault(b"".join(ws[j : j + run]), []).append((k, j))
        keys = sorted(at)
        self.lengths = np.fromiter((len(k) for k in keys), np.int64, len(keys))
        self.patterns = np.zeros((len(keys), int(self.lengths.max()) if keys else 0), dtype=np.uint8)
        for i, k in enumerate(keys):
            self.patterns[i, : len(k)] = np.frombuffer(k, dtype=np.uint8)
        self.count = np.fromiter((len(at[k]) for k in keys), np.int64, len(keys))
        self.offset = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.item = np.fromiter((k for x in keys for k, _ in at[x]), np.int64)
        self.word = np.fromiter((j for x in keys for _, j in at[x]), np.int64)
        own = np.cumsum([0, *(len(b) for b in self.begin)])
        self.place = np.concatenate([*self.begin, np.zeros(0, np.int64)])[own[self.item] + self.word] if len(keys) else np.zeros(0, np.int64)


def _right(ws: list[bytes], text: bytes, b: int, y: int, left: int) -> tuple[int, int]:
    """From word b at byte y, with `left` faults to spend: the most words passed (faulty ones too), and the byte reached."""
    while b < len(ws) and text.startswith(ws[b], y):
        y += len(ws[b])
        b += 1
    best = (min(len(ws), b + left), y)  # faults that are left are spent on the next words
    if left and b < len(ws):
        for cost in range(1, left + 1):
            for skip in range(0, cost + 1):
                k = b + skip
                if k >= len(ws) or (skip < cost and cost > 1):
                    continue
                at = text.find(ws[k], y, y + GAP * cost + len(ws[k]))
                while at >= 0:
                    got = _right(ws, text, k, at, left - cost)
                    if got[0] > best[0]:
                        best = got
                    at = text.find(ws[k], at + 1, y + GAP * cost + len(ws[k]))
    return best


def _window(ws: list[bytes], text: bytes, b: int, e: int, x: int, y: int, need: int, errors: int) -> tuple[int, int] | None:
    """Bytes [from, to) of a window around words [b, e) that stand at [x, y), or None."""
    back, mirror = [w[::-1] for w in reversed(ws)], None
    for left in range(errors + 1):
        if left == 0:
            lo, before = x, 0
            while before < b and text.endswith(ws[b - 1 - before], 0, lo):
                lo -= len(ws[b - 1 - before])
                before += 1
        else:
            base = max(0, x - need * max(len(w) for w in ws) - GAP * (left + 1))
            mirror = text[base:x][::-1]
            got, used = _right(back, mirror, len(ws) - b, 0, left)
            before, lo = got - (len(ws) - b), x - used
        got, hi = _right(ws, text, e, y, errors - left)
        if before + got - b >= need:
            return lo, hi
    return None


def _far(ws: list[bytes], text: bytes, b: int, y: int, left: int, last: dict[bytes, int]) -> tuple[int, int]:
    """As `_right`, over any distance, with the next fault at word b. `last` keeps where a run of words stands last in the text.

    Of the places of a run the first is taken: what follows it in the text holds what follows the others.
    """
    best = (min(len(ws), b + left), y)
    if left and b < len(ws):
        got = _far(ws, text, b + 1, y, left - 1, last)
        best = max(best, got, key=lambda g: g[0])
        for k in (b, b + 1):
            at, run = y, b""
            for n in range(k, len(ws)):
                run += ws[n]
                if run not in last:
                    last[run] = text.rfind(run)
                if last[run] < at:
                    break
                at = text.find(run, at)
                got = _far(ws, text, n + 1, at + len(run), left - 1, last)
                if got[0] > best[0]:
                    best = got
    return best


class FarText:
    """A text and its mirror image, to look for windows with faults of any length."""

    def __init__(self, text: bytes):
        self.text, self.mirror = text, text[::-1]
        self.last: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}

    def window(self, ws: list[bytes], b: int, e: int, x: int, y: int, need: int, errors: int) -> tuple[int, int] | None:
        """As `_window`."""
        right, back = ws[: b + need], [w[::-1] for w in reversed(ws[max(0, e - need) :])]
        first = len(back) - (b - max(0, e - need))
        for left in range(errors + 1):
            before, used = self._reach(back, self.mirror, first, len(self.text) - x, left, self.last[1])
            got, hi = self._reach(right, self.text, e, y, errors - left, self.last[0])
            if before - first + got - b >= need:
                return len(self.text) - used, hi
        return None

    @staticmethod
    def _reach(ws: list[bytes], text: bytes, b: int, y: int, left: int, last: dict[bytes, int]) -> tuple[int, int]:
        best = _far(ws, text, b, y, left, last)
        while b < len(ws) and text.startswith(ws[b], y):
            y += len(ws[b])
            b += 1
            best = max(best, _far(ws, text, b, y, left, last), key=lambda g: g[0])
        return best


def shard_hits(ids: list, texts: list[str], blocks: list[Passages]) -> Iterator[tuple]:
    """(id, item id, [(from, to), ...]) for the texts of one shard; spans are characters of the text, merged."""
    reduced = [reduce_text(t) for t in texts]
    index = FMIndex(reduced)
    for p in blocks:
        if not len(p.lengths):
            continue
        lo, hi = index.search(p.patterns, p.lengths)
        some = np.flatnonzero(hi > lo)
        n = hi[some] - lo[some]
        if not n.sum():
            continue
        rows = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = index.locate(rows)
        pattern = np.repeat(some, n)
        each = p.count[pattern]
        which = np.repeat(p.offset[pattern] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        at = np.repeat(at, each)
        item, word, place = p.item[which], p.word[which], p.place[which]
        doc = index.text_of(at)
        at = at - index.starts[doc]
        line = at - place
        order = np.lexsort((word, line, item, doc))
        doc, item, word, at, line = (a[order] for a in (doc, item, word, at, line))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (line[1:] != line[:-1]) | (word[1:] != word[:-1] + 1)])
        edges = [*np.flatnonzero(new).tolist(), len(doc)]
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        far, far_doc = None, -1
        for s, e in zip(edges, edges[1:]):
            d, k, b = int(doc[s]), int(item[s]), int(word[s])
            ws, end = p.words[k], int(word[e - 1]) + p.run[k]
            x = int(at[s])
            y = x + int(p.begin[k][end] - p.begin[k][b])
            held = spans.setdefault((d, k), [])
            if any(lo_ <= x and y <= hi_ for lo_, hi_ in held):
                continue
            got = _window(ws, reduced[d], b, end, x, y, p.need[k], p.errors[k])
            if got is None and p.errors[k]:
                if d != far_doc:
                    far, far_doc = FarText(reduced[d]), d
                got = far.window(ws, b, end, x, y, p.need[k], p.errors[k])
            if got:
                held.append(got)
        offsets: dict[int, tuple] = {}
        for (d, k), held in spans.items():
            if held:
                if d not in offsets:
                    offsets[d] = reduce_with_offsets(texts[d])
                _, begin, end_ = offsets[d]
                merged: list[list[int]] = []
                for lo_, hi_ in sorted(held):
                    if merged and lo_ <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi_)
                    else:
                        merged.append([lo_, hi_])
                yield ids[d], p.ids[k], [(int(begin[lo_]), int(end_[hi_ - 1])) for lo_, hi_ in merged]


def leaks(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str,
    *, window: int = 20, errors: int = 2, shard_bytes: int = 2_000_000, items_per_block: int = 2_000,
) -> DataFrame:
    """(id, item_id, spans ARRAY<STRUCT<start, end>>) for every document that holds part of a passage.

    One pass over the corpus without a shuffle; a shard is so many texts of a partition that they reach `shard_bytes` (a
    longer text is a shard by itself). The passages travel with the tasks, in blocks of `items_per_block`; the driver stops
    with an error above 64 MB of passages. Null and empty texts and passages match nothing; a passage shorter than `window` words must occur whole,
    with its share of the errors, rounded down. Ids may repeat: each row is reported.
    """
    spark = docs.sparkSession
    ship(spark)
    held = items.select(F.col(item_col), F.col(passage_col)).where(F.col(passage_col).isNotNull())
    size = held.agg(F.sum(F.octet_length(F.col(passage_col)))).first()[0] or 0
    if size > 64 << 20:
        raise ValueError(f"passages of {size} bytes; at most 64 MB can be searched for in one call")
    rows = [tuple(r) for r in held.sort(item_col).collect()]
    shared = spark.sparkContext.broadcast(rows)
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        blocks = [Passages(rows[i : i + items_per_block], window, errors) for i in range(0, len(rows), items_per_block)]
        ids: list = []
        texts: list[str] = []
        size, schema = 0, None

        def search() -> pa.RecordBatch:
            out = [*shard_hits(ids, texts, blocks)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, _, s in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in out], schema), pa.array([k for _, k, _ in out], item_arrow), spans], names=["id", "item_id", "spans"])

        for b in batches:
            schema = b.schema.field("id").type
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= shard_bytes:
                    yield search()
                    ids, texts, size = [], [], 0
        if ids:
            yield search()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> ''")
    return picked.mapInArrow(run, f"id {id_type}, item_id {item_type}, spans array<struct<start:int,end:int>>")


def removal_spans(found: DataFrame) -> DataFrame:
    """(id, spans): the spans of all items of a document, sorted, overlapping and touching ones merged."""
    merged = F.aggregate(
        F.sort_array(F.flatten(F.collect_list("spans"))), F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    return found.groupBy("id").agg(merged.alias("spans"))
