import random

import numpy as np
from pyspark.sql import functions as F

from loomspec.llm import graph, near_dedup, passages
from loomspec.llm.graph import components, relabelled


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(rows, size, percent):
    sets = sets_of(rows, size)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def varied(prose):
    r, rows = random.Random(3), []
    for g in range(12):
        base = prose(r.randint(8, 200), g).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randint(0, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = prose(1, r.random())
            rows.append((len(rows), " ".join(copy)))
            if r.random() < 0.4:
                base = copy  # chains: far ends are linked through what lies between
    order = list(range(len(rows)))
    r.shuffle(order)
    return [(order[i], t) for i, t in rows] + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "  one\n")]


def test_components_against_brute_force(documents, prose):
    rows = varied(prose)
    for size, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(documents(rows), size, percent).collect()}
        assert got == brute(rows, size, percent)


def near_group(prose):
    """Many copies of a text that is itself not there: some pairs are links, most are not, and no star links them all."""
    r, base, rows = random.Random(9), prose(150, 77).split(), []
    other = [w if k % 7 else "variant" for k, w in enumerate(base)]  # a second family, near the first but not linked with it
    for i in range(240):
        copy = list(base if i % 3 else other)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = prose(1, r.random())
        rows.append((i, " ".join(copy)))
    return rows


def test_large_group_against_brute_force(documents, prose):
    rows = near_group(prose)
    wanted = brute(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == wanted and 20 < len({c for _, c in wanted.values()}) < 220


def test_one_bucket_loses_no_link(spark, documents, prose):
    """A and B are linked, the hub of their only bucket is linked with neither."""
    from loomspec.llm.common import id_text

    a = prose(100, 1).split()
    rows = [(1, " ".join([*a, *prose(400, 5).split()])), (2, " ".join(a)), (3, " ".join([*a[:50], "x", *a[51:]]))]
    texts = id_text(documents(rows), "doc_id", "text")
    for hub in (1, 2, 3):
        signed = near_dedup.signatures(texts, 3).withColumnsRenamed({"__id": "first"})
        nodes = signed.select((F.col("first") + F.when(F.col("first") == hub, 0).otherwise(10)).alias("node"), "first", "s1", "s2", "n", "parity", F.lit(1).alias("m"), F.array(F.lit(7).cast("bigint")).alias("bands"))
        found = {r["node"]: r["component"] for r in near_dedup._labels(nodes, texts, 3, 85).collect()}
        two, three = (i + (0 if i == hub else 10) for i in (2, 3))
        assert found.get(two) is not None and found.get(two) == found.get(three) and found.get(1 if hub == 1 else 11) is None


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 3, 85).items()}


def test_sketches_never_rule_out_a_link():
    rng, parity = np.random.default_rng(4), near_dedup.Parity()
    for n in (3, 40, 700):
        x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        for shared in (n, n - 1, n // 2):
            a, b = x[:n], np.concatenate([x[:shared], x[n : 2 * n - shared]])
            apart = sum(int(v).bit_count() for v in (parity(a) ^ parity(b)).view(np.uint64))
            assert apart <= 2 * (n - shared) and (apart > 0) == (shared < n)


def test_rows_of_one_id_with_different_texts(documents, prose):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(5, a), (5, b), (3, a), (9, b), (7, prose(60, 3))]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}


def test_odd_rows(documents, odd_rows):
    got = near_dedup.near_duplicates(documents(odd_rows).withColumn("node", F.lit(0)), 3, 85).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(odd_rows) and by[4]["component_id"] == -8 and by[1]["kept"] and by[2]["n_shingles"] == 0 and by[None]["kept"]
    assert near_dedup.near_duplicates(documents(odd_rows).limit(0)).count() == 0
    assert near_dedup.keep_one(documents(odd_rows), 3, 85).count() == len(odd_rows) - 2


def test_signatures_estimate_likeness():
    rng, sign = np.random.default_rng(0), near_dedup.Signer()
    for n, shared in ((400, 360), (30, 27), (6, 5)):
        same = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            same.append((sign.bins(x[:n]) == sign.bins(np.concatenate([x[:shared], x[n : 2 * n - shared]]))).mean())
        assert abs(np.mean(same) - shared / (2 * n - shared)) < 0.07


def test_chain_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100


def test_components_across_tasks(spark, monkeypatch):
    """More edges than a task joins at once: chains, hubs, loops and repeats against brute force."""
    monkeypatch.setattr(graph, "AT_ONCE", 40)
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(150)] + [(5000, 4000 + i) for i in range(150)] + [(3000, 6000 + i) for i in range(100)] + [(r.randrange(10**6, 10**6 + 300), r.randrange(10**6, 10**6 + 300)) for _ in range(140)]
    least: dict[int, int] = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            least[b] = a
    r.shuffle(pairs)
    got = components(spark.createDataFrame(pairs + pairs[:50], "a bigint, b bigint").repartition(7)).collect()
    assert len(got) == len({x["node"] for x in got}) and {x["node"]: x["component"] for x in got} == {x: root(x) for x in least}


def test_labels_are_not_multiplied(spark):
    """No row is copied for each task that might ask for it, and what is small is settled in one look at its edges."""
    seen = []
    kept, graph.saved = graph.saved, lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, name)
    try:
        components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")).collect()
    finally:
        graph.saved = kept
    assert [name for name, _ in seen] == ["edges", "labels"] and not any("Generate" in plan for _, plan in seen)


def test_more_edges_between_components(spark):
    labels = components(spark.createDataFrame([(1, 2), (3, 4), (3, 5), (8, 9)], "a bigint, b bigint"))
    got = {r["node"]: r["component"] for r in relabelled(labels, spark.createDataFrame([(5, 2), (4, 3), (20, 21), (9, 30)], "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 30: 8, 20: 20, 21: 20}


def test_windows_against_brute_force():
    rng = np.random.default_rng(1)
    old = passages.LEAST
    for n in (46, 60, 300):
        values = rng.permutation(n).astype(np.uint64) << np.uint64(24) | np.arange(n, dtype=np.uint64)
        kept = passages.least_positions(values, np.array([n]), old)
        want = sorted({int(np.argmin(values[i : i + old])) + i for i in range(n - old + 1)})
        assert kept.tolist() == want
        left, right = passages.compact_windows(kept, values, np.zeros(len(kept), int), np.full(len(kept), n))
        for c, l, r in zip(kept, left, right):
            assert values[l : r + 1].min() == values[c] and (l == 0 or values[l - 1] < values[c]) and (r == n - 1 or values[r + 1] < values[c])


def test_planted_passages(documents, prose):
    rows = [(i, prose(120, 500 + i)) for i in range(30)]
    shared, near = prose(55, 7).split(), prose(80, 8).split()
    for i in (3, 11, 19, 27):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[: 10 * i % 90] + shared + w[10 * i % 90 :]))
    for k, i in enumerate((5, 21)):
        w, own = rows[i][1].split(), list(near)
        if k:
            own[40] = "changed"
        rows[i] = (i, " ".join(w[:30] + own + w[30:]).upper())
    rows += [(40, rows[8][1]), (41, None), (42, ""), (None, rows[9][1]), (43, "junk " * 200), (44, "junk " * 300)]
    got = passages.repeated_passages(documents(rows, 5).withColumn("key", F.lit(1))).collect()
    assert {r["doc_id"] for r in got} == {3, 11, 19, 27, 5, 21, 8, 40, 43, 44}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 11, 19, 27)} == {3}
    for r in got:
        if r["doc_id"] in (3, 11, 19, 27):
            text = dict(rows)[r["doc_id"]].split()
            assert text[r["start_word"] : r["start_word"] + r["n_words"]] == shared
    assert passages.repeated_passages(documents(rows).limit(0)).count() == 0


def test_very_frequent_key_in_several_rounds(documents, prose, monkeypatch):
    """Windows of one key beyond what is linked at a time."""
    monkeypatch.setattr(passages, "AT_ONCE", 40)
    monkeypatch.setattr(passages, "BLOCK", 500)
    shared = prose(60, 1)
    rows = [(i, prose(30, 100 + i) + " " + shared + " " + prose(30, 900 + i)) for i in range(150)]
    got = passages.repeated_passages(documents(rows, 1)).collect()
    assert {r["component_id"] for r in got} == {0} and len({r["doc_id"] for r in got}) == 150


def test_windows_of_a_frequent_key_lose_no_link(monkeypatch, spark):
    """Far more kinds of surroundings than are linked at a time: the links are those of one look at all windows."""
    rng = np.random.default_rng(4)
    n, low, high = 6000, sum(passages.NEAR_BITS), 1 << 32
    around = rng.integers(0, high, n, dtype=np.uint64) << np.uint64(low) | rng.integers(0, high, n, dtype=np.uint64)
    # each has a partner with the same surroundings on one side, thousands of windows later
    around[n // 2 :] = around[: n // 2] & np.uint64((high - 1) << 32) | rng.integers(0, high, n // 2, dtype=np.uint64)
    key = np.where(np.arange(n) < 40, 8, np.where(np.arange(n) < n - 30, 16, 24)) + 0
    doc, place = np.arange(n), rng.integers(0, 1 << 40, n)
    rows = [(int(k), int(d), int(p), int(x), None, None) for k, d, p, x in zip(key, doc, place, around.view(np.int64))]
    frame = spark.createDataFrame(rows, ", ".join(f"{x} bigint" for x in passages._NAMES)).coalesce(1)
    monkeypatch.setattr(passages, "AT_ONCE", 200)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "90")
    try:
        got = {tuple(r) for r in passages.links(frame).collect()}
    finally:
        spark.conf.unset(batch)
    i, j = passages._linked(key, doc, around.view(np.int64))
    want = {(int(key[a]), int(doc[a]), int(place[a]), int(doc[b]), int(place[b])) for a, b in zip(i, j)}
    assert got == want and len({x[1] for x in want}) >= n // 2 - 100


def test_recall_of_changed_passages(documents, prose):
    """Passages of 60 to 120 words, every 30th word or so changed: nearly all pairs are found."""
    r, rows = random.Random(5), []
    for g in range(60):
        passage = prose(r.randint(60, 120), 10_000 + g).split()
        for side in range(2):
            own = list(passage)
            if side:
                own[r.randrange(20, len(own) - 20)] = "changed"
            rows.append((2 * g + side, prose(40, 20_000 + 2 * g + side) + " " + " ".join(own) + " " + prose(40, 30_000 + 2 * g + side)))
    got = {(x["doc_id"], x["partner_id"]) for x in passages.repeated_passages(documents(rows, 4)).collect()}
    assert got <= {(i, i ^ 1) for i in range(120)} and len(got) >= 0.95 * 120


def test_hot_passage_is_linked_as_a_star(documents, prose):
    shared = prose(60, 1)
    rows = [(i, prose(20, 100 + i) + " " + shared + " " + prose(20, 900 + i)) for i in range(120)]
    got = passages.repeated_passages(documents(rows, 6)).collect()
    assert {r["component_id"] for r in got} == {0} and len({r["doc_id"] for r in got}) == 120 and len(got) < 120 * 12


def test_passages_around_a_frequent_phrase_are_found(documents, prose):
    phrase = prose(40, 1)
    rows = [(i, prose(60, 100 + i) + " " + phrase + " " + prose(60, 900 + i)) for i in range(150)]
    for g in range(20):  # two texts share six words on both sides of the phrase, too
        passage = prose(6, 5000 + g) + " " + phrase + " " + prose(6, 6000 + g)
        rows += [(1000 + 100 * side + g, prose(50, 7000 + 100 * side + g) + " " + passage + " " + prose(50, 8000 + 100 * side + g)) for side in range(2)]
    got = {(r["doc_id"], r["partner_id"]) for r in passages.repeated_passages(documents(rows, 6)).collect()}
    assert got == {x for g in range(20) for x in ((1000 + g, 1100 + g), (1100 + g, 1000 + g))}
