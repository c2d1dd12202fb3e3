"""Decontamination and line deduplication against brute force, and the pipeline's stages."""

import random
from collections import defaultdict

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, line_dedup, queries

ITEM = "A train leaves Paris at 9 in the morning and travels 120 km to Lyon while Anna walks 5 miles along the river and then waits for it."


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=5)) for _ in range(n))


def test_items_in_documents(spark):
    rnd = random.Random(1)
    other = words(rnd, 40)
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, other, "x"), (3, None, "x"), (4, "too short", "x"), (5, ITEM.replace("120", "77"), "y")], "item_id long, text string, slots string")
    moved = ITEM.replace("120", "350").replace("Anna", "Bella").replace("9", "11").replace("miles", "km")
    clash = "walks 5 miles along the river and then waits for it . walks 6 miles along the river and then waits"
    rows = [
        (10, words(rnd, 50) + " " + ITEM + " " + words(rnd, 30)), (11, words(rnd, 20) + " " + moved), (12, other.upper()), (13, words(rnd, 500)), (14, None), (15, ""),
        (16, " ".join(ITEM.split()[:10])), (17, "it is too short here"), (18, "too short"), (None, other), (12, other.upper()), (19, words(rnd, 20000) + " " + other), (20, clash),
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, window string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_items(docs, bench).collect()}
    assert set(got) == {(10, 1), (10, 5), (11, 1), (11, 5), (12, 2), (17, 4), (18, 4), (None, 2), (19, 2)}
    assert not got[10, 1]["reparameterised"] and got[10, 5]["reparameterised"] and got[11, 1]["reparameterised"]
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [13, 14, 15, 16, 20]
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0 and decontaminate.find_items(docs, bench.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "take 5 red apples from box 5 and put those 5 apples into the 5 green bags near the old door")], "item_id long, text string")
    same = "take 8 red apples from box 8 and put those 8 apples into the 8 green bags near the old door"
    mixed = "take 8 red apples from box 7 and put those 6 apples into the 4 green bags near the old door"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_items(docs, bench).collect()] == [1]


def test_covered_tokens_are_counted_as_a_union(spark):
    rnd = random.Random(8)
    text = words(rnd, 60).split()
    bench = spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")
    cut = lambda a, b: " ".join(text[a:b])
    rows = [(1, cut(5, 18)), (2, cut(5, 17)), (3, cut(5, 13) + " so " + cut(14, 22)), (4, cut(5, 13) + " so " + cut(10, 17)), (5, cut(5, 13))]
    docs = spark.createDataFrame([(i, words(rnd, 20) + " " + t + " " + words(rnd, 20)) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["covered"] for r in decontaminate.find_items(docs, bench).collect()}
    assert got == {1: 13, 3: 16}


def test_random_templates_against_plain_alignment(spark):
    """Copies with other values, held against a word-by-word comparison of each copy with its item."""
    rnd = random.Random(12)
    literal = [w for w in words(rnd, 300).split()]
    items = {}
    for i in range(25):
        count = rnd.randint(9, 30)
        items[i] = [rnd.choice(literal) if rnd.random() < 0.8 else str(rnd.randint(1, 4)) for _ in range(count)]
    rows, expected = [], set()
    for d in range(200):
        i = rnd.randrange(25)
        mapping, copy = {}, []
        steady = rnd.random() < 0.5
        for w in items[i]:
            copy.append((mapping.setdefault(w, str(rnd.randint(10, 99))) if steady else str(rnd.randint(1, 9))) if w.isdigit() else w)
        rows.append((d, " ".join([*rnd.sample(literal, 5), "STOPS.", *copy, "ENDS.", *rnd.sample(literal, 5)])))
        # word by word: windows of eight with five literals, where values map one to one, or equal in all words
        n = len(copy)
        rich = [s for s in range(n - 7) if sum(not w.isdigit() for w in items[i][s : s + 8]) >= 5]
        same = [s for s in range(n - 7) if items[i][s : s + 8] == copy[s : s + 8]]
        tokens = lambda starts: {s + k for s in starts for k in range(8)}
        pairs = {(items[i][k], copy[k]) for k in tokens(rich) if copy[k].isdigit()}
        clash = len(pairs) > len({a for a, _ in pairs})
        counting = [s for s in rich if not clash or s in same]
        if len(tokens(counting + same)) >= min(13, n) or len(tokens(counting)) >= min(13, len(tokens(rich)) or n):
            expected.add((d, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert got == expected and 50 < len(expected) < 190


def test_short_items_inside_longer_texts(spark):
    rnd = random.Random(2)
    bench = spark.createDataFrame([(1, "who wrote the old song"), (2, "name the seven seas of old"), (3, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, words(rnd, 40) + " who wrote the old song? " + words(rnd, 9)), (2, "name the seven seas of old"), (3, "it is too short here"), (4, words(rnd, 40) + " who wrote the new song")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_slots_are_consistent_within_an_occurrence(spark):
    text = "take 5 red apples from box 5 and put those 5 apples into the 5 green bags near the old door"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    eight, nine = text.replace("5", "8"), text.replace("5", "9")
    longer = [t.replace("apples into", "apples then into") for t in (eight, nine)]
    mixed = "take 8 red apples from box 7 and put those 6 apples into the 4 green bags near the old door"
    rows = [(1, eight + " " + nine), (2, eight + " so then we take 3 red apples from box 3 and put those"), (3, " ".join(longer)), (4, mixed + " " + mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.find_items(docs, bench).where("reparameterised").collect()) == [1, 2, 3]


def test_items_with_few_literals(spark):
    rnd = random.Random(4)
    mixed = "add the numbers 1 2 3 4 5 6 7 8 9 10 11 12"
    bench = spark.createDataFrame([(1, "12 + 7 * 3 - 45 / 9"), (2, "costs 5 km"), (3, mixed), (4, "one, Anna Bella Carla Dora 5 km 6")], "item_id long, text string")
    around = lambda text: words(rnd, 20) + " " + text + " " + words(rnd, 20)
    rows = [(1, around("12 + 7 * 3 - 45 / 9")), (2, around("costs 5 km")), (3, around(mixed)), (4, around("one, Anna Bella Carla Dora 5 km 6")), (5, around("12 + 8 * 3 - 45 / 9")), (6, around("12 + 7 - 3 * 45 / 9")), (7, around("costs 6 km"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, bench).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_letter_case_and_untyped_values(spark):
    german = "Der alte Bauer sah den Hund und die Katze neben dem Haus mit dem Garten hinter der Kirche."
    glued = "the runner went 5km today and then rested near his house"
    names = "Anna went up the hill for the water. Anna came down and her friend Anna laughed."
    bench = spark.createDataFrame([(1, german), (2, glued), (3, names)], "item_id long, text string")
    rows = [(1, german.lower()), (2, german.upper()), (3, glued.replace("5km", "12km")), (4, names.replace("Anna", "Bella")), (5, german), (6, glued), (7, glued.replace("5km", "slowly"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert got == {(1, 1, False), (2, 1, False), (3, 2, True), (4, 3, True), (5, 1, False), (6, 2, False)}


def test_the_joined_way_finds_the_same(spark, sf_dir, monkeypatch):
    found = lambda: sorted(map(str, queries.op9_decontamination(spark, sf_dir).collect()))
    quick = found()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert quick and found() == quick


def test_whole_items_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    whole = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, sf_dir).collect()}
    assert whole and whole <= got


@pytest.mark.parametrize("sites", [2, 5])
def test_boilerplate_lines(spark, sites):
    rnd = random.Random(3)
    shared = [f"shared line {k}" for k in range(12)]
    rows = []
    for i in range(150):
        lines = [f"own {i}", "", *(s for k, s in enumerate(shared) if rnd.random() < 0.5 and int(f"{i}") % 12 <= k)]
        rows.append((i, "\n".join(lines), f"s{i % 12}" if i % 12 else None))
    rows += [(500, None, "s1"), (501, "", "s1"), (502, "shared line 11\n" * 3000, "s2"), (None, "shared line 11\nx", "s3"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id long, text string, source string, pos string")
    spread = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            spread[line].add(s)
    gone = {line for line, s in spread.items() if line and len(s - {None}) >= sites}
    expected = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        expected.append((i, None if t is None else "\n".join(x for x in lines if x not in gone), sum(x != "" for x in lines), sum(x in gone for x in lines)))
    got = [tuple(r) for r in line_dedup.remove_boilerplate(docs, sites=sites).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and gone
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def test_thresholds_within_the_sketches_error(spark, monkeypatch):
    """With 256 registers an estimate is a few per cent off; counts around the threshold still decide exactly."""
    monkeypatch.setattr(line_dedup, "LOG_REGISTERS", 8)
    spread = {f"line {n}": n for n in (150, 260, 285, 297, 299, 300, 301, 303, 330, 480, 600)}
    rows = [(site, "\n".join([f"own {site}", *(line for line, n in spread.items() if site < n)]), f"s{site}") for site in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = line_dedup._lines(docs, "source")
    estimates = {r["h1"]: r["e"] for r in lines.groupBy("h1").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", 8)).alias("e")).collect()}
    names = {r["h"]: r["line"] for r in spark.createDataFrame([(x,) for x in spread], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    assert any(estimates[h] != spread[x] for h, x in names.items())  # the sketches do err
    gone = {x for x, n in spread.items() if n >= 300}
    for r in line_dedup.remove_boilerplate(docs, sites=300).collect():
        assert r["text"].split("\n") == [f"own {r['doc_id']}", *(x for x, n in spread.items() if r["doc_id"] < n and x not in gone)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'" if __import__("os").path.isdir(f"{sf_dir}/{t}.parquet") else f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    reply = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in reply.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in reply.fetchall())


def test_pipeline(spark, sf_dir):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == start.columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(kept[0]) > len(kept[1]) >= len(kept[2]) > len(kept[3])
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept[0] for i in good) >= 0.98 * len(good)
    assert len({t.encode().lower() for t in kept[1].values()}) == len(kept[1])
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in t for t in kept[3].values() for b in items)
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == set(kept[3])


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
    assert docs.count() == 0


def test_pipeline_of_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, shared ids and clashing columns through all stages in turn."""
    rnd = random.Random(21)
    vocabulary = [w.capitalize() if i % 9 == 0 else w for i, w in enumerate(words(rnd, 400).split())]

    def prose(n):
        return "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(12)) + "." for _ in range(n))

    base, item = prose(12), spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(i, prose(rnd.randint(5, 9))) for i in range(60)]
    rows += [(100, base), (101, base), (101, base), (None, base), (102, base.upper().lower()), (103, base + " tail."), (104, None), (104, ""), (None, None), (105, "  "), (106, prose(3000))]
    rows += [(200, prose(6)), (200, prose(6)), (None, rows[0][1] + " more words here."), (300, prose(4) + "\n" + item + "\n" + prose(4)), (301, "BUY!! NOW!! $$$ ### " * 30), (302, "BUY!! NOW!! $$$ ### " * 31)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, _sha string, h long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, True, "clash", "clash", 3) for i, t in rows], kinds)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == kinds.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    good = {i for i, _ in seen[0]}
    assert all(t and t.strip() for _, t in seen[0]) and {301, 302}.isdisjoint(good) and set(range(60)) <= good and {100, 101, 106, 200, 300} <= good
    texts = [t.lower() for _, t in seen[1]]
    assert len(texts) == len(set(texts)) and [i for i, t in seen[1] if t.lower() == base.lower()] == [102]
    left = [i for i, _ in seen[2]]
    assert 102 in left and 103 not in left and left.count(200) == 2 and None in left
    assert 300 not in [i for i, _ in seen[3]] and len(seen[3]) == len(seen[2]) - 1
    out = corpus_pipeline.encoding(spark, docs, sf_dir).collect()
    assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(i) for i, _ in seen[3])
