"""Filter audit, prefix trie and odd sketches against brute force: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_llm_operators import SCHEMA, corpus, lower, plain_words

from evalmill.llm import filter_audit as fa
from evalmill.llm import odd_sketch as od
from evalmill.llm import prefix_trie as pt
from evalmill.llm.base import Scratch
from evalmill.llm.running import running

# ---------------------------------------------------------------- 11


def failed(text: str | None, copy: bool) -> str:
    t = text or ""
    w = plain_words(t)
    conditions = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), copy)
    return "".join(name for name, fails in zip("ABCDE", conditions, strict=True) if fails)


def audited(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    """By replaying every order document by document."""
    least: dict[str, int] = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[at] == 1} for at in (0, 1))
    docs = [(lang or "", failed(text, i is not None and least[text or ""] < i), i) for i, text, lang in rows]
    out = set()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed[f] += len(gone)
                redundant = sum(f in d[1] for d in own) - len(gone)
                lost = [sum(d[2] in s for d in gone) for s in (good, toxic)]
                lines.append((part, "".join(order), step, f, len(left), len(gone), redundant, sum(d[1] == f for d in own), *lost))
        out |= {(*line, removed[line[3]]) for line in lines}
    return out


AUDIT = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = [(r[0], r[1], r[2]) for r in corpus()]
    for i in range(200, 320):
        words = [rng.choice(["Up", "LOUD", "low", "né"]) + str(rng.randrange(60)) for _ in range(rng.choice([5, 99, 100, 140]))]
        rows.append((i, " ".join(words) + rng.choice(["", " |", " 5%"]), rng.choice(["en", "", None, "x'y"])))
    rows += [(i, rows[-1][1], "en") for i in (150, 400, 401)] + [(200, rows[40][1], "en"), (None, None, None), (None, rows[-1][1], "en"), (401, rows[-1][1], "en")]
    rows.append((500, "Word# " * 400_000, "long"))
    return rows


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 330, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (6, 0, 0), (6, 1, 1), (99999, 1, 1)]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, lang string, n long, mask string").repartition(5)
    got = fa.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3))
    assert {tuple(r[c] for c in AUDIT) for r in got.collect()} == audited(rows, labels)
    assert got.count() == 600 * len({r[2] or "" for r in rows})
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c in AUDIT[4:]} == {"bigint"}
    assert fa.audit_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_parity_sums_give_mask_counts_back(spark):
    rng = random.Random(1)
    rows = [(rng.choice("pq"), rng.randrange(8), rng.randrange(1, 10**12)) for _ in range(60)]
    sums = fa.parity(spark.createDataFrame(rows, "part string, mask long, n long"), ["part"], 3)
    want = {p: [sum(n for q, m, n in rows if (p, x) == (q, m)) for x in range(8)] for p in "pq"}
    assert {r.part: r.cells for r in sums.select("part", fa.inverted("sums", 3).alias("cells")).collect()} == want
    assert all(r.sums[0] == sum(want[r.part]) for r in sums.collect())


def test_audit_of_other_filters_and_labels(spark):
    masks = spark.createDataFrame([("p", True, 0b11, 2), ("p", False, 0b01, 3), ("p", True, 0, 4)], "part string, rare boolean, mask long, n long")
    got = {(r.filter_order, r.step): r for r in fa.audit(masks, "xy", labels=("rare",)).collect()}
    assert [got["yx", 1][c] for c in ("filter", "kept", "removed", "redundant", "unique_fails", "rare_lost", "shapley")] == ["y", 7, 2, 0, 0, 2, 2]
    assert [got["yx", 2][c] for c in ("filter", "kept", "removed", "redundant", "unique_fails", "rare_lost", "shapley")] == ["x", 4, 3, 2, 3, 0, 8]
    for names in ("", "aa", "a,", "abcdefghi"):
        with pytest.raises(ValueError):
            fa.audit(masks, names, labels=("rare",))


# ---------------------------------------------------------------- 12


def conversations() -> list[tuple]:
    rng = random.Random(5)
    rows: list[tuple] = []
    for c in [*range(0, 60), *range(100, 130), *range(201, 215), 777, -5, -100]:
        for t in range(rng.choice([0, 1, 2, 3, 7, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(["hi", "né", ""]) if t else "hello"))
    rows += [(300, None, None, None), (300, 0, "user", None), (300, 0, "user", "tie"), (300, 0, "user", "tie"), (300, None, "user", "x"), (None, 0, "user", "lost"), (301, 5, "a:", "b"), (302, 5, "a", ":b")]
    rows += [(303, t, "user", f"turn {t // 3}") for t in range(70)] + [(400, t, "user", f"turn {t // 3}") for t in range(40)] + [(404, 1, "user", "only one turn")]
    return rows


def owned(rows: list[tuple], shared: bool) -> set[tuple]:
    own: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    if shared:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        base = {c: c - int(np.fmod(c, 100)) for c in own}
        own = {c: own.get(base[c], [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}
    members: dict[tuple, list[int]] = defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, out = Counter(p[:-1] for p in members if p), set()
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(who) if len(own[c]) == len(p)).encode()).hexdigest()
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], sum(not kids[q] for q in below), saved, ends))
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("few", [pt.FEW, 0], ids=["sent to all", "joined"])
@pytest.mark.parametrize("shared", [True, False])
def test_prefix_trie(spark, monkeypatch, shared, few):
    monkeypatch.setattr(pt, "CHUNK", 3)
    monkeypatch.setattr(pt, "FEW", few)
    rows = conversations()
    convs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, place long, key string").repartition(6)
    got = pt.prefix_trie(convs, shared_heads=shared)
    found = [tuple(r[c] for c in TRIE) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == owned(rows, shared)
    assert pt.prefix_trie(convs.limit(0), shared_heads=shared).count() == 0
    assert pt.prefix_trie(convs.where("conv_id is null"), shared_heads=shared).count() == 0


def test_a_conversation_without_turns_ends_at_the_root(spark):
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    got = pt.prefix_trie(spark.createDataFrame([(short, 0, "user", "gone")], "conv_id long, turn long, role string, text string"), shared_heads=True).collect()
    assert [tuple(r[c] for c in TRIE) for r in got] == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_chains_of_chains(spark):
    """Each conversation leaves the path of the one before it a turn later: as deep as there are conversations."""
    rows = [(c, t, "user", f"{t}" if t < n - 1 else f"{t} of {c}") for c, n in ((50 - i, i + 1) for i in range(40)) for t in range(n)]
    got = pt.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {tuple(r[c] for c in TRIE) for r in got.collect()} == owned(rows, False)


def test_running_values_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(40), rng.randrange(-9, 9), rng.randrange(-(1 << 62), 1 << 62)) for g in [1] * 700 + [2] * 3 + [-4] * 200 + list(range(10, 60))]
    df = spark.createDataFrame([(*r, f"{r[1]}") for r in rows], "g long, o long, s long, x long, other string").repartition(7)
    with Scratch(spark, "running") as scratch:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = running(df, "g", ["o", "s", "x"], scratch, adds=("s",), xors=("x",)).collect()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert running(df.limit(0), "g", ["o"], scratch).count() == 0
    want = set()
    for g in {r[0] for r in rows}:
        s, x = 0, 0
        for place, r in enumerate(sorted(r for r in rows if r[0] == g), 1):
            s, x = s + r[2], x ^ r[3]
            want.add((g, r[1], s, x, str(r[1]), place))
    assert {(r.g, r.o, r.s, r.x, r.other, r.place) for r in got} == want and len(got) == len(rows)


# ---------------------------------------------------------------- 13


def near(rows: list[tuple[int | None, str | None]], k: int = 3, percent: int = 85) -> dict[int, int]:
    sets = []
    for i, text in rows:
        w = plain_words(lower(text))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def sizes_of(text: str | None, k: int = 3) -> int:
    w = plain_words(lower(text))
    return len({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}) if w else 0


def copies() -> list[tuple]:
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in corpus()]
    for g in range(6):  # drifting copies: neighbours link, the ends do not
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(90)]
        for i in range(40):
            rows.append((1000 + 100 * g + i, " ".join(words)))
            for _ in range(rng.choice([1, 1, 2])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    for i in range(30):  # one passage in all, none alike
        rows.append((2000 + i, " ".join([f"p{j}" for j in range(30)] + [f"o{rng.randrange(10**6)}" for _ in range(40)])))
    rows += [(1003, "a further text of an id that is there already"), (3000, "a further text of an id that is there already"), (3001, None), (3001, "words " * 9)]
    return rows


@pytest.mark.parametrize("small", [False, True], ids=["production sizes", "many parts and long lists"])
def test_near_duplicates(spark, monkeypatch, small):
    if small:
        from evalmill.llm import jaccard_join

        monkeypatch.setattr(jaccard_join, "UNIT", 5)
    rows = copies()
    docs = spark.createDataFrame([(*r, 1, "clash", True) for r in rows], "doc_id long, text string, n long, h1 string, kept boolean").repartition(5)
    got = od.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = near(rows)
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert found == sorted(((i is None, i or 0), sizes_of(t), want.get(i), None if i is None else want[i] == i) for i, t in rows)
    assert od.near_duplicates(docs.limit(0)).count() == 0
    assert any(want[1000 + 100 * g] == want[1039 + 100 * g] for g in range(6)) and len({want[2000 + i] for i in range(30)}) == 30


def test_odd_bits_tell_high_similarities():
    rng = np.random.default_rng(4)
    for common, extra in ((340, 30), (34, 3), (60, 60)):
        seen, hits = [], 0
        for _ in range(300):
            v = rng.integers(0, 1 << 64, common + 2 * extra, dtype=np.uint64)
            a, b = v[: common + extra], np.concatenate([v[:common], v[common + extra :]])
            samples = od.samples_of(np.concatenate([a, b]), np.array([0, len(a)]))
            bands, maps = od.folded(samples)
            z = od.odd_bits(maps[:1], maps[1:])[0, 0]
            differ = (samples[:, 0] != samples[:, 1]).sum()
            assert z <= 2 * differ and (z - 2 * differ) % 2 == 0
            hits += (bands[0] == bands[1]).sum()
            seen.append(1 + od.BITS / 4 / len(od._SEEDS) * np.log1p(-2 * z / od.BITS))
        similarity = common / (common + 2 * extra)
        assert abs(np.mean(seen) - similarity) < 0.02 and np.std(seen) < 0.05
        assert abs(hits / 300 / od.BANDS - similarity**od.ROWS) < 0.05
    assert od.least_limit(85, 200) < 140 and od.least_limit(100, 200) == 0


def test_long_lists_keep_what_may_link(monkeypatch):
    rng = np.random.default_rng(6)
    values = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in rng.integers(20, 400, 60)]
    values += [np.concatenate([v[:-1], rng.integers(0, 1 << 64, 1, dtype=np.uint64)]) for v in values for _ in range(3)]
    sizes = np.array([len(v) for v in values])
    maps = od.folded(od.samples_of(np.concatenate(values), np.cumsum(sizes) - sizes))[1]
    limit = od.least_limit(85, len(od._SEEDS))
    whole = od.connected(sizes, maps, 85, limit)
    monkeypatch.setattr(od, "MATRIX", 16)
    cut = od.connected(sizes, maps, 85, limit)
    assert len(set(whole.tolist())) == 60 and all(len(set(cut[whole == x].tolist())) == 1 for x in set(whole.tolist()))
    assert od.apart(np.array([10, 11, 20, 23]), 85).tolist() == [0, 2]
