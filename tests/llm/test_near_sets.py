"""The near-copies of the pipeline against exact similarities of all pairs."""

import random
from collections import Counter

import numpy as np

from paleoframe.llm import common, graph, near_sets, simhash

WORDS = [f"w{i}" for i in range(5000)]


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_force(rows):
    own = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(own):
        for j in range(i):
            if not a | own[j] or 5 * len(a & own[j]) >= 4 * len(a | own[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sorted(min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root))


def planted():
    """Texts, copies of them with a few other words, and texts that share one line."""
    rng = random.Random(5)
    line, texts = " ".join(rng.choices(WORDS, k=30)), []
    for n in (12, 40, 60, 150, 400, 900):
        for _ in range(5):
            own = rng.choices(WORDS, k=n)
            texts.append(" ".join(own))
            for share in (0.005, 0.01, 0.02, 0.025, 0.04):
                copy = list(own)
                for at in rng.sample(range(n), max(1, int(n * share))):
                    copy[at] = rng.choice(WORDS)
                texts.append(" ".join(copy))
            texts.append(" ".join(own[: int(n * 0.82)]))
            texts.append(line + " " + " ".join(rng.choices(WORDS, k=n)))
    many = rng.choices(WORDS, k=200)
    for _ in range(60):  # a large group, in part only linked through others
        copy = list(many)
        for at in rng.sample(range(200), rng.randrange(9)):
            copy[at] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    texts += ["", " ", "one two", "one two", "one three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_finds_planted_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == kept_by_force(rows)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(1)
    for k in range(3000):
        n = int(rng.integers(5, 60 if k % 2 else 1500))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        gone = int(rng.integers(0, n // 5 + 1))
        new = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if near_sets.similar(a, b) and not np.array_equal(a, b):
            assert set(near_sets.keys(a).tolist()) & set(near_sets.keys(b).tolist())
            same, part, size = np.zeros(2, np.int64), np.arange(2), np.array([len(a), len(b)])
            prints = np.frombuffer(near_sets.sketch(a) + near_sets.sketch(b), np.uint64).reshape(2, -1)
            least = np.full((2, near_sets.LEAST_KEYS), 1 << 62)
            assert [(i.tolist(), j.tolist()) for i, j in near_sets.open_pairs(same, part, size, prints, least)] == [([0], [1])]
            assert any(len(i) for i, j in near_sets.first_partners(same, size, prints))


def test_pairs_of_several_keys_are_listed_at_the_first():
    """Three nodes share keys 1 and 2, and two of them key 3 too: every pair once, as long as the keys are among the least."""
    key = np.array([1, 1, 1, 2, 2, 2, 3, 3])
    node = np.array([0, 1, 2, 0, 1, 2, 0, 1])
    n, prints = np.full(8, 10), np.zeros((8, near_sets.SKETCH // 64), np.uint64)
    least = np.full((3, near_sets.LEAST_KEYS), np.iinfo(np.int64).max)
    least[:, :2] = [1, 2]
    least[:2, 2] = 3
    found = lambda m: sorted(tuple(sorted(p)) for i, j in near_sets.open_pairs(key, node, n, prints, m[node]) for p in zip(node[i].tolist(), node[j].tolist(), strict=True))
    assert found(least) == [(0, 1), (0, 2), (1, 2)]
    assert set(found(np.full_like(least, np.iinfo(np.int64).max))) == {(0, 1), (0, 2), (1, 2)}


def test_first_partners_are_the_first_of_a_group(monkeypatch):
    """Rows from ``new`` on meet the WINDOW first rows of their key only."""
    monkeypatch.setattr(near_sets, "WINDOW", 2)
    prints = np.zeros((6, near_sets.SKETCH // 64), np.uint64)
    prints[[0, 4]] = np.iinfo(np.uint64).max
    pairs = sorted((int(y), int(x)) for i, j in near_sets.first_partners(np.array([7, 7, 7, 7, 7, 8]), np.full(6, 10), prints, 3) for x, y in zip(i, j, strict=True))
    assert pairs == [(3, 1), (4, 0)]


def test_stage_with_parted_groups(spark, monkeypatch):
    """Groups over several tasks, blocks and Arrow batches give the same; equal texts are told apart by their ids."""
    monkeypatch.setattr(near_sets, "DEAL", 8)
    monkeypatch.setattr(near_sets, "BLOCK", 4)
    monkeypatch.setattr(common, "ARROW_ROWS", 7)
    rows = planted()
    rows += [(1000 + k, rows[k % 7][1]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == kept_by_force(rows)


def test_cells_of_large_groups(spark):
    """Two nodes of a key in different components are in exactly one cell, on different sides of it; nodes of a large
    component never meet; no cell has many rows."""
    parts = [0] * 40 + [1] * 9 + [2, 2, 3, 4, 5, 5, 5]
    rows = [(7, 100 + k, p) for k, p in enumerate(parts)] + [(8, 1, 1), (8, 2, 2), (8, 3, 2)]
    by = {}
    for r in near_sets.cells(spark.createDataFrame(rows, "key long, node long, part long"), 4).collect():
        by.setdefault((r.key, r.cell), []).append((r.node, r.part, r.side))
    met = Counter()
    for (key, _), own in by.items():
        assert len(own) <= 24
        for x in own:
            for y in own:
                if x[0] < y[0] and (x[2] == 0 or x[2] != y[2]):
                    met[key, x[0], y[0]] += 1
                    assert x[1] != y[1] or x[1] not in (0, 1) or key == 8
    want = {(k, a, b): 1 for k, a, p in rows for m, b, q in rows if k == m and a < b and p != q}
    assert {x: met[x] for x in want} == want


def test_dealt_groups_share_their_first_nodes(spark):
    rng = np.random.default_rng(3)
    nodes = rng.integers(-(1 << 63), (1 << 63) - 1, 4000).tolist()
    rows = [(7, v) for v in nodes] + [(8, v) for v in nodes[:5]]
    by = {}
    for r in near_sets.dealt(spark.createDataFrame(rows, "key long, node long"), 1000).collect():
        by.setdefault((r.key, r.cell), set()).add(r.node)
    assert sorted(k for k, _ in by) == [7, 7, 7, 7, 8] and by[8, 8] == set(nodes[:5])
    first = set(sorted(nodes)[: near_sets.WINDOW])
    own = [v for (k, _), v in by.items() if k == 7]
    assert set.union(*own) == set(nodes) and all(first <= v for v in own) and max(map(len, own)) < 2000


def copies_of_one(n=80):
    """Copies of one text, each with two other words: nearly all pairs are similar."""
    rng = random.Random(7)
    own = rng.choices(WORDS, k=200)
    out = []
    for k in range(n):
        copy = list(own)
        for at in rng.sample(range(200), 2):
            copy[at] = rng.choice(WORDS)
        out.append((k, " ".join(copy)))
    return out


def test_few_links_leave_a_group(spark, monkeypatch):
    """Where no partner joins a group before, its links stay far fewer than its similar pairs."""
    none = lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    monkeypatch.setattr(near_sets, "first_partners", lambda *a: ())
    monkeypatch.setattr(near_sets, "print_partners", none, raising=False)
    monkeypatch.setattr(common, "ARROW_ROWS", 50)
    found, components = [], near_sets.connected_components
    monkeypatch.setattr(near_sets, "connected_components", lambda edges: found.append(edges.count()) or components(edges))
    rows = copies_of_one()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()] == kept_by_force(rows) == [0]
    assert found[0] == 0 and len(rows) - 1 <= found[1] < 8 * len(rows)  # of 3,160 pairs


def test_links_join_what_is_similar():
    """A chain of sets and one alone, each its own component: a link fewer than sets in the chain, and none twice."""
    own = [np.arange(k, k + 100, dtype=np.uint64) for k in range(0, 60, 2)] + [np.arange(500, 600, dtype=np.uint64)]
    key, size = np.full(31, 7), np.full(31, 100)
    prints = np.frombuffer(b"".join(near_sets.sketch(s) for s in own), np.uint64).reshape(31, -1)
    part = np.arange(31)
    got = list(near_sets.links(key, part, size, prints, np.full((31, near_sets.LEAST_KEYS), 1 << 62), key, np.zeros(31, int), own.__getitem__))
    assert len(got) == 29 and all(near_sets.similar(own[i], own[j]) for i, j in got)
    assert len(set(part[:30])) == 1 and part[30] == 30


def test_fingerprints_find_near_copies(spark, monkeypatch):
    """Pivot distance tables alone, without the first sets of groups and the exact rest, pair texts that differ in a word."""
    monkeypatch.setattr(near_sets, "first_partners", lambda *a: ())
    monkeypatch.setattr(near_sets, "_open", lambda *a: common.written(spark.createDataFrame([], "src long, dst long"), "t"))
    rng, rows = random.Random(9), []
    for k in range(20):
        own = rng.choices(WORDS, k=300)
        rows.append((k, " ".join(own)))
        rows.append((100 + k, " ".join(own[:150] + ["other"] + own[151:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == kept_by_force(rows) == list(range(20))


def test_fingerprint_partners_against_all_pairs():
    """Of the earlier rows of a key that are near by fingerprint and pass the bound the nearest, then the first."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = base[rng.integers(0, 6, 300)]
    for _ in range(7):
        fp ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    key, n = np.sort(rng.integers(0, 9, 300)), rng.choice([100, 110, 140], 300)
    prints, new = np.zeros((300, near_sets.SKETCH // 64), np.uint64), 40
    want = []
    for j in range(new, 300):
        near = [(int(fp[i] ^ fp[j]).bit_count(), i) for i in range(j) if key[i] == key[j] and 9 * min(n[i], n[j]) >= 4 * (n[i] + n[j])]
        near = [x for x in near if x[0] <= near_sets.BITS_APART]
        want += [(min(near)[1], j)] if near else []
    i, j = near_sets.print_partners(key, n, prints, fp, new)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True), key=lambda x: x[1]) == want and len(want) > 50


def test_cells_of_many_shingles_are_parted():
    """Any two rows of a cell still meet, no piece is over the limit but by one set, and smaller cells stay."""
    import pyarrow as pa

    n = np.array([5, 5, 30, 5, 5, 12, 1, 4, 4, 300, 2])
    cell = np.array([1] * 7 + [2, 2] + [3, 3])
    t = pa.table({"side": np.zeros(11, np.int32), "cell": cell, "n": n, "node": np.arange(11)})
    got = list(near_sets.bounded(t, 20))
    met = {(a, b) for x in got for a in x.column("node").to_pylist() for b in x.column("node").to_pylist() if a < b}
    assert met == {(b, a) for a in range(11) for b in range(a) if cell[a] == cell[b]}
    assert len({x.column("cell")[0].as_py() for x in got}) == len(got) > 3 and all(x.schema == t.schema for x in got)
    assert list(near_sets.bounded(t.slice(0, 0), 20)) == []


def test_fine_sketches_tell_large_sets_apart():
    """Similar sets pass the bound, also with other numbers of classes; large unlike ones do, by 512 classes, but not by fine ones."""
    rng = np.random.default_rng(2)
    prints = lambda s, f: np.frombuffer(f(s), np.uint64)
    for k in range(600):
        n = int(rng.choice([3, 250, 260, 1000, 1030, 4000, 4200]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[: n - k % (n // 9 + 1)], rng.integers(0, 1 << 63, k % (n // 7 + 1), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if near_sets.similar(a, b):
            assert near_sets.fine_close(prints(a, near_sets.fine), prints(b, near_sets.fine), len(a) + len(b))
            assert near_sets.fine_close(prints(b, near_sets.fine), prints(a, near_sets.fine), len(a) + len(b))
        other = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert n < 250 or not near_sets.fine_close(prints(a, near_sets.fine), prints(other, near_sets.fine), len(a) + len(other))
        if n >= 4000:
            two = np.stack([prints(a, near_sets.sketch), prints(other, near_sets.sketch)])
            assert near_sets.close(np.array([len(a), len(other)]), two, np.array([0]), np.array([1])).all()


def test_sets_of_unlike_large_texts_stay(spark, monkeypatch):
    """Texts of 2,000 words that share 800 meet in groups; their sets are not moved to be compared."""
    rng, written, rows = random.Random(11), common.written, {}
    monkeypatch.setattr(common, "written", lambda df, what, small=False: rows.update({what: rows.get(what, 0) + (out := written(df, what, small)).count()}) or out)
    line = rng.choices(WORDS, k=800)
    texts = [(k, " ".join(line + rng.choices(WORDS, k=1200))) for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == kept_by_force(texts) == list(range(12))
    assert rows["near-open"] > 12 and rows["near-cells"] == 0


def test_a_round_of_components_writes_few_files(spark, monkeypatch):
    """A file for some thousands of edges, however many tasks a shuffle has; a smaller number gives more files and the same."""
    written, files = common.written, []
    monkeypatch.setattr(common, "written", lambda df, what, small=False: files.append(len((out := written(df, what, small)).inputFiles())) or out)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 300) if k % 100], "src long, dst long")
    try:
        for k, v in zip(was, ("24", "false"), strict=True):
            spark.conf.set(k, v)
        for most, fewest in ((common.FILE_ROWS, 1), (50, 2)):
            files.clear()
            monkeypatch.setattr(common, "FILE_ROWS", most)
            got = {(r.node, r.component) for r in graph.connected_components(common.few(edges, edges.count())).collect()}
            assert got == {(k, k // 100 * 100) for k in range(300)}
            assert all(fewest <= f <= 300 // most + 1 for f in files[most < 300 :]) and len(files) > 2
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
