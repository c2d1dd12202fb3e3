"""Exact and near duplicates and components, against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from eventloom.llm import _base, components, exact_dedup, near_dedup
from eventloom.llm.components import connected_components

DOCS = "doc_id long, text string, kept string, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)


def union_find(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_cuckoo_filter_inserts_deletes_and_overflows():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    small = exact_dedup.CuckooFilter(64)
    placed = [d for d in digests if small.insert(d)]
    assert 200 < len(placed) < 300  # 256 slots: later ones overflow
    large = exact_dedup.CuckooFilter(2048)
    assert all(large.insert(d) for d in digests) and all(d in large for d in digests)
    assert all(large.delete(d) for d in digests[:1000]) and all(d in large for d in digests[1000:])
    assert sum(d in large for d in digests[:1000]) < 20


def test_cuckoo_index_resizes_and_verifies():
    index = exact_dedup.CuckooIndex(buckets=2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(2000)]
    for i, d in enumerate(digests):
        index.add(d, i)
    index.add(digests[5], 9999, 3)
    index.add(digests[6], None, 1)
    assert index.resized and index.size == 2000
    found = {d: (i, n) for d, i, n in index.items()}
    assert found[digests[5]] == (9999, 4) and found[digests[6]] == (6, 2)
    assert index.remove(digests[7]) and not index.remove(digests[7])
    assert len(list(index.items())) == 1999


def exact_rows():
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["Hello", "hello", "HELLO", "ÉA", "éa", "Éa", "", None, "x" * 20000])) for i in range(200)]
    return rows + [(500 + i, "hot") for i in range(150)] + [(7, "twice"), (7, "twice"), (None, "only null"), (None, "hot")]


def test_exact_duplicates(spark):
    rows = exact_rows()
    norm = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    expected = []
    for i, t in rows:
        ids = groups[norm(t)]
        best = max((x for x in ids if x is not None), default=None)
        expected.append((i, best, len(ids), best is None or i == best, hashlib.sha256(norm(t)).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()]
    # a null id is never the largest: equality with it is unknown, and the row goes
    assert sorted(map(str, got)) == sorted(map(str, expected))
    stays = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert stays.columns == ["doc_id", "text", "kept", "rep"]
    assert sorted(map(str, {(e[0], e[4]) for e in expected if e[3]})) == sorted(str((r["doc_id"], hashlib.sha256(norm(r["text"])).hexdigest())) for r in stays.collect())
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_shards_grow_with_the_table(spark, monkeypatch):
    rows = exact_rows()
    expected = sorted(map(str, exact_dedup.exact_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 25)
    digests = exact_dedup.text_digests(frame(spark, rows)).cache()
    assert exact_dedup.build_index(digests).rdd.getNumPartitions() == -(-len(rows) // 25)
    assert sorted(map(str, exact_dedup.exact_duplicates(frame(spark, rows)).collect())) == expected


def test_one_row_stays_of_each_text(spark):
    rows = [(7, "twice"), (7, "TWICE"), (None, "lost"), (None, "lost"), (None, "Lost"), (1, None), (1, ""), (3, "single"), (3, "other")]
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in left) == [("1", ""), ("3", "other"), ("3", "single"), ("7", "twice"), ("None", "lost")]


def test_index_updates(spark):
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    index = exact_dedup.build_index(exact_dedup.text_digests(frame(spark, [(1, "a"), (2, "b"), (3, "a")])))
    gone = spark.createDataFrame([(bytearray(digest("b")),)], "digest binary")
    new = exact_dedup.text_digests(frame(spark, [(9, "A"), (10, "c")]))
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.update_index(index, gone, new).collect()}
    assert got == {digest("a"): (9, 3), digest("c"): (10, 1)}


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(70)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    edges = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == union_find([x for x in links if x[0] != x[1]], nodes)
    assert connected_components(edges.limit(0)).count() == 0


def near_rows():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choices(words, k=120) for _ in range(6)]
    rows = []
    for i in range(240):  # copies with none to six words replaced: links of all kinds near the threshold
        copy = list(base[i % 6 if i % 3 else 0])
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        rows.append((i, " ".join(copy) if i % 5 else "\n".join(copy).upper()))
    rows += [(1000, ""), (1001, None), (1002, "   "), (1003, "one two"), (1004, "One\ttwo"), (1005, "one two three four five"), (1006, "w " * 5000), (1007, "w " * 40), (300, rows[0][1])]
    return rows


def brute_near(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, union_find(links, ids)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = near_rows()
    sizes, components = brute_near(rows, percent)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, rows), percent).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == components
    assert all(r["kept"] == (i == components[i]) for i, r in got.items())


def test_near_duplicates_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FIRST_TESTS", 0)
    monkeypatch.setattr(near_dedup, "PER_ROUND", 0)
    rows = near_rows()
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), 85).collect()}
    assert got == brute_near(rows, 85)[1]


def alike_rows(n, rnd):
    """Texts of one family, nearly all of them less alike than the threshold, and chains of closer ones among them."""
    core = [f"c{i}" for i in range(60)]
    rows = [(i, core + [f"o{i}x{j}" for j in range(rnd.randint(15, 21))]) for i in range(n)]
    for i in range(0, n, 9):
        rows[i] = (i, rows[i // 3][1][:-2] + [f"z{i}"])
    return [(i, " ".join(w)) for i, w in rows]


@pytest.mark.parametrize("percent", [80, 85])
def test_large_group_below_the_threshold(spark, percent):
    import numpy as np

    rows = alike_rows(2000, random.Random(8))
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in words]
    places = {s: k for k, s in enumerate({s for x in sets for s in x})}
    table = np.zeros((len(rows), len(places)), np.float32)
    for i, x in enumerate(sets):
        table[i, [places[s] for s in x]] = 1
    both = (table @ table.T).round().astype(int)
    size = np.diag(both)
    links = [(a, b) for a, b in np.argwhere(100 * both >= percent * (size[:, None] + size - both)).tolist() if a < b]
    components = union_find(links, range(len(rows)))
    assert 2 < len(set(components.values())) < len(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), percent).collect()}
    assert got == components


def test_rows_that_share_an_id(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black")
    rows = [(1, b), (5, b), (5, a), (9, a), (5, ""), (20, ""), (20, c), (15, c), (30, None), (30, ""), (7, a), (7, a)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, 1, True), (5, 1, False), (9, 1, False), (7, 1, False), (20, 15, False), (15, 15, True), (30, 30, True)}


def test_row_repeated_many_times(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(base))] * 400 + [(4, " ".join(base[:-1]))] * 300 + [(i, " ".join(base[1:])) for i in range(10, 40)]
    got = [r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()]
    assert got == [3] * 730


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    text = "a b c d e f g"
    got = near_dedup.near_duplicates(frame(spark, [(None, text), (None, text), (4, text), (4, text), (5, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("4", "4", True)] * 2 + [("5", "5", True)] + [("None", "None", True)] * 2
    left = near_dedup.drop_near_duplicates(frame(spark, [(1, text), (2, text), (3, "q")]))
    assert left.columns == ["doc_id", "text", "kept", "rep"] and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_parity_sketch_never_exceeds_the_difference():
    import numpy as np

    rng, shingler = np.random.default_rng(1), near_dedup.Shingler(85)
    for _ in range(50):
        both = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
        x, y = both[: rng.integers(150, 300)], both[rng.integers(0, 60) :]
        a, b = shingler.features(x)[1], shingler.features(y)[1]
        odd = sum(int(v).bit_count() for v in (a[4:] ^ b[4:]).view(np.uint64))
        assert odd <= len(np.setxor1d(x, y))


def test_files_follow_rows_not_partitions(spark, monkeypatch):
    """Tables of a few hundred rows, which shuffles deal over 40 partitions, take a file a core at most."""
    files = defaultdict(int)

    def counted(df, name, *more):
        out = _base.written(df, name, *more)
        files[name] = max(files[name], len(out.inputFiles()))
        return out

    for module in (components, exact_dedup, near_dedup):
        monkeypatch.setattr(module, "written", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        near = counted(near_dedup.near_duplicates(frame(spark, near_rows()), 80), "near").collect()
        exact = counted(exact_dedup.exact_duplicates(frame(spark, exact_rows())), "exact").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in near} == brute_near(near_rows(), 80)[1]
    assert len(exact) == len(exact_rows())
    del files["sets"]  # whose tasks read texts
    assert files.keys() >= {"reps", "classes", "crowded", "links", "edges", "near", "exact"}
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files
