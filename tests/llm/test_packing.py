import random
from collections import defaultdict

from pyspark.sql import functions as F

import pytest

from keystrata.llm.packing import SumOfSquares, pack, packing_faults, packing_fill

CAP = 1000


def check(rows, got, used=None, cap=CAP):
    """Every placed byte once, nothing over capacity, whole items not divided."""
    placed, load = defaultdict(int), defaultdict(int)
    for r in got:
        placed[r.id] += r.bytes
        if r.bin is not None and r.part != "full":
            load[r.grp, r.bin] += r.bytes
    want = defaultdict(int)
    for i, _, n in rows:
        if n is not None and n >= 0:
            want[i] += n
    assert dict(placed) == dict(want)
    for (g, b), n in load.items():
        assert n + (used or {}).get((g, b), 0) <= cap
    for r in got:
        assert (r.part == "whole") == (r.bytes <= cap and r.part == "whole")


def test_rows_of_every_kind(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([rng.randint(1, 60), rng.randint(200, 700), rng.randint(900, 5_000)])) for i in range(2_000)]
    rows += [(9_001, 0, None), (9_002, 0, -5), (9_003, 0, 0), (9_004, 1, CAP), (9_005, 1, 3 * CAP), (7, 0, 44), (9_006, 2, 10**15)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "rid long, db int, n long, part string, bin string")
    bins = spark.createDataFrame([(0, "a", 400), (0, "a", 350), (0, "b", None), (0, "c", -1), (0, "d", CAP), (1, "e", 999), (None, "f", 0)], "grp int, bin string, used long")
    for how in ({}, {"open_new": "last"}, {"falling": False}):
        packed = pack(df, "rid", F.col("db"), F.col("n"), CAP, open_bins=bins, shard_items=300, **how)
        got = packed.collect()
        check(rows, got, {(0, "a"): 400, (1, "e"): 999})
        assert {r.bin for r in got if r.bin is not None and not r.is_new} <= {"a", "e", "f"}
        if how:  # one id stands in two rows
            assert all((r.overfull, r.shared) == (0, 0) for r in packing_faults(packed, CAP, bins).collect())
    with pytest.raises(ValueError):
        pack(df, "rid", F.col("db"), F.col("n"), CAP, open_new="never")
    over = {r.id for r in got if r.part == "full"}
    assert over == {i for i, _, n in rows if n is not None and n > CAP}
    assert next(r for r in got if r.id == 9_005).blocks == 3
    assert next(r for r in got if r.id == 9_003).bin is None


def test_units_and_empty(spark):
    rows = [(1, 0, 1), (2, 0, 128), (3, 0, 129)]
    df = spark.createDataFrame(rows, "rid long, db int, n long")
    got = pack(df, "rid", F.col("db"), F.col("n"), 300, unit=128).collect()
    check(rows, got, cap=300)
    empty = pack(spark.createDataFrame([], "rid long, db int, n long"), "rid", F.col("db"), F.col("n"), CAP)
    assert empty.count() == 0 and packing_fill(empty, CAP).count() == 0


def test_little_room_is_left():
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 400) for _ in range(5_000)), reverse=True)
    for rule, order in ((True, sizes), (False, sizes), (True, rng.sample(sizes, len(sizes)))):
        ss = SumOfSquares(CAP, rule)
        load = defaultdict(int)
        for s in order:
            load[ss.place(s)] += s
        assert max(load.values()) <= CAP and len(load) == ss.opened
        assert ss.opened <= sum(sizes) / CAP * 1.01 + 2


def sum_of_squares(sizes, units, rule, gaps=()):
    """The rule by trying every choice: gaps of the containers, in the order in which they were opened, after each item."""
    gaps, out = list(gaps), []
    worth = lambda g: sum(g.count(x) ** 2 for x in set(g) if x)
    for s in sizes:
        tries = [(worth(gaps[:i] + [g - s] + gaps[i + 1 :]), g - s, i) for i, g in enumerate(gaps) if g >= s and s]
        best = min(tries, default=None)
        new = worth([*gaps, units - s])
        if best is None or (rule and new < best[0]):
            gaps.append(units - s)
        else:
            gaps[best[2]] -= s
        out.append(sorted(gaps))
    return out


def test_places_are_those_of_the_rule():
    rng = random.Random(8)
    for trial in range(300):
        units = rng.randint(1, 14)
        sizes = [rng.randint(1, units) for _ in range(rng.randint(1, 25))]
        if trial % 2:
            sizes.sort(reverse=True)
        begin = [rng.randint(1, units) for _ in range(rng.randint(0, 3))]
        for rule in (True, False):
            ss, gaps, i, want = SumOfSquares(units, rule), {}, 0, sum_of_squares(sizes, units, rule, begin)
            for k, g in enumerate(begin):
                ss.add(g, -1 - k)
                gaps[-1 - k] = g
            while i < len(sizes):
                j = i
                while j < len(sizes) and sizes[j] == sizes[i]:
                    j += 1
                for b in ss.place_alike(sizes[i], j - i):
                    gaps[b] = gaps.get(b, units) - sizes[i]
                assert sorted(gaps.values()) == want[j - 1], (units, sizes, begin, rule)
                i = j


def test_faults_are_seen(spark):
    packed = spark.createDataFrame([(0, 1, "full", 2000, 2, "new/0/0", True), (0, 2, "whole", 5, 1, "new/0/1", True), (0, 3, "whole", 700, 1, "a", False), (0, 4, "whole", 1, 1, "b", False),
        (0, 4, "whole", 1, 1, "b", False), (None, 5, "whole", 1, 1, "b", False)], "grp int, id long, part string, bytes long, blocks long, bin string, is_new boolean")
    bins = spark.createDataFrame([(0, "a", 400), (0, "a", 10), (0, "b", 1)], "grp int, bin string, used long")
    assert sorted(map(tuple, packing_faults(packed, CAP, bins).collect()), key=str) == [(0, 1, 1, 1), (None, 0, 0, 0)]


def test_the_rule_on_small_cases():
    ss = SumOfSquares(10, rule=False)
    assert ss.place(6) == 0  # gap 4
    assert ss.place(7) == 1  # no room: a new one, gap 3
    assert ss.place(3) == 1  # closes gap 3 rather than making a gap of 1
    assert ss.place(4) == 0
    assert ss.place(1) == 2


def test_fill_counts(spark):
    df = spark.createDataFrame([(1, 0, 600), (2, 0, 400), (3, 0, 2_500)], "rid long, db int, n long")
    r = packing_fill(pack(df, "rid", F.col("db"), F.col("n"), CAP), CAP).first()
    assert (r.items, r.new_bins, r.bytes, r.bound) == (3, 4, 3_500, 4) and abs(r.fill - 0.875) < 1e-9
