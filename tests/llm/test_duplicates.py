"""Near duplicates, shared passages, decontamination and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import catalog, components, decontamination, near_dedup, substring_dedup
from tests.llm.frames import documents, odd, prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(rows, percent):
    """Smallest id that each row reaches over links between full sets; rows are (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(h[0], j) if len(h) > 50 else (i, j) for h in holders.values() for n, i in enumerate(h[:-1]) for j in h[n + 1 :]}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(x for x in (key, least.get(find(i))) if x is not None)
    return [(key, least[find(i)], len(sets[i])) for i, (key, _) in enumerate(rows)]


def edited(text, r, share):
    w = text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(1, 41), 1) | dict.fromkeys(range(100, 160), 100) | dict.fromkeys((200, 201, 202), 200)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_the_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in catalog.documents(spark, folder).collect()]
    got = catalog.QUERIES["op4_near_dedup"](spark, folder).collect()
    assert Counter((r.doc_id, r.component_id, r.n_shingles) for r in got) == Counter(brute_components(rows, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_near_copies_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 20)  # many blocks, so that links across them are needed
    r = random.Random(8)
    base, rows = prose(20, 120), []
    for i in range(120):
        rows.append((i, edited(base, r, r.choice([0, 0.01, 0.02, 0.04]))))
    rows += [(200 + i, prose(100 + i, 60)) for i in range(40)] + [(300, rows[7][1].upper())]
    df = documents(spark, rows)
    for percent, minhashes in ((85, 5), (80, 4)):
        got = near_dedup.near_duplicates(df, percent=percent, rows=minhashes).collect()
        assert Counter((x.doc_id, x.component_id, x.n_shingles) for x in got) == Counter(brute_components(rows, percent))


def test_near_duplicates_of_odd_documents(spark):
    df = odd(spark).withColumn("component_id", F.lit("clash")).withColumn("n_shingles", F.lit("clash"))
    got = Counter((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in near_dedup.near_duplicates(df).collect())
    n = len(shingles(prose(2, 80)))
    assert got[(4, 4, n, True)] == 2 and got[(5, 4, n, False)] == 1 and got[(1, 1, 0, True)] == 1 and got[(2, 2, 0, True)] == 1
    assert got[(None, None, 3 - 2, False)] == 1 and got[(None, None, 0, False)] == 1 and got[(6, 6, 1, True)] == 1
    assert sum(got.values()) == df.count()
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_wholly_equal_short_texts_are_linked(spark):
    got = near_dedup.near_duplicates(documents(spark, [(1, "Two words"), (2, "two  WORDS\n"), (3, "two words more")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_keys_of_clusters_cross_once_and_only_shared_hashes_are_combined(spark):
    r = random.Random(4)
    rows = [(i, [r.randrange(30) for _ in range(3)], [r.randrange(30) for _ in range(3)]) for i in range(60)]
    classes = spark.createDataFrame([(bytes([i]), u, v) for i, u, v in rows], "digest binary, u array<long>, v array<long>")
    found = {x.digest[0]: x.cluster for x in near_dedup.clusters(classes, 3).collect()}
    root = {i: i for i, _, _ in rows}
    for i, u, v in rows:
        for j, w, x in rows[:i]:
            if any(a == b for a, b in zip(u, w)) and any(a == b for a, b in zip(v, x)):
                old, new = root[i], root[j]
                root = {k: new if c == old else c for k, c in root.items()}
    groups = [tuple(sorted(k for k in root if root[k] == c)) for c in set(root.values())]
    assert {g for g in groups if len(g) > 1} == {tuple(sorted(k for k in found if found[k] == c)) for c in set(found.values())}
    common = {x.node: (len(x.u), len(x.v)) for x in near_dedup._common(classes.withColumn("node", F.hex("digest")), 3).collect()}
    places = Counter((side, n, x) for row in rows for side in (1, 2) for n, x in enumerate(row[side]))
    shares = {f"{row[0]:02X}": tuple(sum(places[side, n, x] > 1 for n, x in enumerate(row[side])) for side in (1, 2)) for row in rows}
    assert common == {k: c for k, c in shares.items() if all(c)}
    plan = near_dedup._meeting(spark.range(9).selectExpr("id AS node", "id % 3 AS k"))._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan


def covered(text, spans):
    starts, ends = substring_dedup.word_edges(text.encode())
    return {i for i in range(len(starts)) if any(a <= starts[i] and ends[i] <= b for a, b in spans)}


def test_shared_passages(spark):
    r = random.Random(4)
    exact, fuzzy, short = prose(50, 70), prose(51, 90), prose(52, 40)
    near = edited(fuzzy, r, 0.06)
    inserted = " ".join(fuzzy.split()[:40] + ["new", "words", "here"] + fuzzy.split()[40:])
    rows = [(1, prose(1, 90) + " " + exact + " " + prose(2, 60)), (2, prose(3, 55) + "\n" + fuzzy), (3, prose(4, 20) + " " + short)]
    rows += [(4, exact.upper() + "\n" + prose(5, 70)), (5, prose(6, 70) + " é " + near + " " + prose(7, 80)), (6, inserted), (7, short + " " + prose(8, 60)), (8, prose(9, 200))]
    rows += [(9, rows[7][1]), (10, "of " * 200), (11, "of " * 130)]
    texts = dict(rows)
    found = substring_dedup.shared_passages(documents(spark, rows).withColumn("row", F.lit("clash"))).collect()
    spans = defaultdict(list)
    for x in found:
        assert x.first_doc_id < x.doc_id and x.n_words >= 50 and x.similarity >= 0.8
        spans[x.doc_id].append((x.start_byte, x.end_byte))
    assert set(spans) == {4, 5, 6, 9, 11}
    assert covered(texts[4], spans[4]) == set(range(70))
    assert set(range(75, 155)) <= covered(texts[5], spans[5]) <= set(range(66, 166))
    assert len(covered(texts[6], spans[6])) >= 90 and covered(texts[9], spans[9]) == set(range(200))
    left = {x.doc_id: x["text"] for x in substring_dedup.remove_passages(documents(spark, rows), substring_dedup.shared_passages(documents(spark, rows))).collect()}
    assert left[4] == prose(5, 70) and left[9] == "" and left[1] == texts[1] and left[8] == texts[8]


def test_passages_are_all_stretches_long_and_alike_enough():
    import numpy as np

    for parts in ((45, 3, 11), (40, 5, 15), (48, 2, 8)):
        equal = np.repeat([True, False, True], parts)
        assert substring_dedup.passages(np.arange(len(equal)), equal) == [(0, len(equal) - 1, equal.mean())]
    rng = np.random.default_rng(5)
    for case in range(300):
        n = int(rng.integers(1, 60))
        equal = rng.random(n) < rng.choice([0.6, 0.8, 0.95])
        lone = ~equal & (rng.random(n) < 0.3)
        places = np.where(lone, -1, np.cumsum(~lone) - 1)
        at = {int(x): i for i, x in enumerate(places) if x >= 0}
        found = substring_dedup.passages(places, equal, 10, 0.8)
        free = np.ones(n, bool)
        for x, y, share in found:
            assert y - x + 1 >= 10 and share >= 0.8 - 1e-9 and free[at[x] : at[y] + 1].all()
            free[at[x] : at[y] + 1] = False
        whole = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if (places[i:j] >= 0).sum() >= 10 and equal[i:j].mean() >= 0.8]
        assert bool(whole) == bool(found), case
        assert not any(free[i:j].all() for i, j in whole), case


def spans_of(spark, rows):
    spans = defaultdict(list)
    for x in substring_dedup.shared_passages(documents(spark, rows)).collect():
        spans[x.doc_id].append((x.start_byte, x.end_byte))
    return spans


def test_runs_whose_parts_earlier_documents_have(spark):
    rows, n = [], 20
    for i in range(n):
        w = prose(1000 + i, 60).split()
        parts = [w[:40], w[:30], w[30:], w, w]
        rows += [(100 * k + i, " ".join([prose(2000 + 10 * i + k, 30), *x, prose(3000 + 10 * i + k, 30)])) for k, x in enumerate(parts)]
    spans, texts = spans_of(spark, rows), dict(rows)
    for i in range(n):
        assert set(range(30, 90)) <= covered(texts[400 + i], spans[400 + i])


def test_every_copy_inside_a_document_is_found(spark):
    passage = prose(70, 60)
    w = passage.split()
    rows = [(1, prose(1, 30) + " " + passage), (2, " ".join([passage, prose(2, 30), passage, prose(3, 30), passage]))]
    rows += [(3, " ".join([*w[:30], prose(4, 20), *w[20:50], prose(5, 20), passage])), (4, "of " * 200), (5, prose(6, 20) + " of" * 300)]
    near = edited(passage, random.Random(9), 0.05)
    rows += [(6, near + " " + prose(7, 30) + " " + near)]
    spans, texts = spans_of(spark, rows), dict(rows)
    assert {*range(60), *range(90, 150), *range(180, 240)} <= covered(texts[2], spans[2])
    assert set(range(100, 160)) <= covered(texts[3], spans[3]) and set(range(20, 320)) <= covered(texts[5], spans[5])
    assert len(covered(texts[6], spans[6]) & {*range(60), *range(90, 150)}) >= 110


def test_recall_of_near_passages(spark):
    rng, rows, planted, wanted = random.Random(2), [], 0, {}
    for share, least in ((0.05, 0.99), (0.1, 0.99), (0.15, 0.97), (0.2, 0.9)):
        for size in (50, 60, 80, 100):
            for _ in range(50):
                planted += 1
                w = prose(5000 + planted, size).split()
                near = list(w)
                for k in rng.sample(range(size), int(share * size)):
                    near[k] = f"edit{rng.randrange(10**6)}"
                rows += [(planted, " ".join([prose(7000 + planted, 20), *w, prose(9000 + planted, 20)]))]
                rows += [(10_000 + planted, " ".join([prose(11_000 + planted, 20), *near, prose(13_000 + planted, 20)]))]
                wanted.setdefault((share, least), []).append(10_000 + planted)
    found = {x.doc_id for x in substring_dedup.shared_passages(documents(spark, rows)).collect()}
    recall = {share: sum(k in found for k in keys) / len(keys) for (share, _), keys in wanted.items()}
    print("recall", recall)
    assert all(recall[share] >= least for share, least in wanted), recall


def test_documents_that_quote_parts_hide_no_passage(spark):
    """Earlier documents hold overlapping parts of a passage, one has it whole; a near copy of it is found by its words."""
    rng, rows, n, wanted = random.Random(5), [], 60, {}
    for i in range(n):
        w = prose(20_000 + i, 60).split()
        near = list(w)
        for k in rng.sample(range(60), 3):
            near[k] = f"edit{rng.randrange(10**6)}"
        for k, x in enumerate((w[:25], w[18:45], w[38:], w, near)):
            rows.append((1000 * k + i, " ".join([prose(30_000 + 10 * i + k, 30), *x, prose(50_000 + 10 * i + k, 30)])))
        wanted[4000 + i] = set(range(30, 90))
    spans, texts = spans_of(spark, rows), dict(rows)
    share = [len(words & covered(texts[k], spans[k])) / 60 for k, words in wanted.items()]
    assert sum(x >= 0.8 for x in share) >= 0.95 * n, share


def test_equal_texts_take_part_once(spark):
    text, other = prose(1, 90), prose(2, 60)
    rows = [(i, text) for i in range(50)] + [(60, prose(3, 40) + " " + other), (61, prose(4, 40) + " " + other)]
    found = substring_dedup.shared_passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(i, 0) for i in range(1, 50)} | {(61, 60)}


def test_filter_keeps_every_shared_hash(spark):
    import numpy as np

    h = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    words = substring_dedup._filter(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert substring_dedup.maybe_shared(h.view(np.uint64), words).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert substring_dedup.maybe_shared(other, words).mean() < 0.03


def test_passages_of_odd_documents(spark):
    rows = odd(spark)
    found = {(r.doc_id, r.first_doc_id, r.n_words) for r in substring_dedup.shared_passages(rows).collect()}
    assert found == {(5, 4, 80)}
    assert substring_dedup.remove_passages(rows, substring_dedup.shared_passages(rows)).count() == rows.count()
    empty = rows.limit(0)
    assert substring_dedup.remove_passages(empty, substring_dedup.shared_passages(empty)).count() == 0


def test_exact_runs_of_the_table_are_found(spark, folder):
    """Every run of 50 words or more that an earlier document has is covered."""
    docs = sorted((r.doc_id, r.text) for r in catalog.documents(spark, folder).collect() if r.text)
    first, runs = {}, defaultdict(list)
    for key, text in docs:
        w = words(text)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), key) != key:
                runs[key].append(i)
    spans = defaultdict(list)
    for x in catalog.QUERIES["op5_substring_dedup"](spark, folder).collect():
        spans[x.doc_id].append((x.start_byte, x.end_byte))
    texts = dict(docs)
    assert runs
    for key, at in runs.items():
        wanted = {j for i in at for j in range(i, i + 50)}
        assert wanted <= covered(texts[key], spans[key]), key


def test_chain_takes_the_best_ascending_anchors():
    import numpy as np

    here, there = np.array([0, 10, 20, 30, 40, 15]), np.array([100, 110, 120, 130, 140, 500])
    assert substring_dedup.chain(here, there)[0] == [0, 1, 2, 3, 4]
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 9)
        b, a = [rng.randrange(60) for _ in range(n)], [rng.randrange(60) for _ in range(n)]

        def score(k, b=b, a=a, n=n):
            before = [score(j) - 0.1 * (b[k] - b[j] + a[k] - a[j]) for j in range(n) if b[j] < b[k] and a[j] < a[k]]
            return 16 + max([0, *before])

        got = substring_dedup.chain(np.array(b), np.array(a))[0]
        total = 16 * len(got) - sum(0.1 * (b[y] - b[x] + a[y] - a[x]) for x, y in zip(got, got[1:]))
        assert abs(total - max(score(k) for k in range(n))) < 1e-6


def brute_leaks(docs, items, least=0.8):
    out = {}
    for key, text in docs:
        w = (text or "").lower().encode().split()
        for item, item_text in items:
            b = (item_text or "").lower().encode().split()
            k = min(5, len(b))
            if not b:
                continue
            theirs = Counter(tuple(b[i : i + k]) for i in range(len(b) - k + 1))
            if not any(tuple(w[i : i + k]) in theirs for i in range(len(w) - k + 1)):
                continue
            for s in range(max(1, len(w) - len(b) + 1)):
                v = w[s : s + len(b)]
                ours = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
                if ours:
                    common = sum((ours & theirs).values())
                    x = common / (sum(ours.values()) + sum(theirs.values()) - common)
                    if x >= least:
                        out[key, item] = max(x, out.get((key, item), 0))
    return {k: round(v, 9) for k, v in out.items()}


def test_leaks_of_the_table(spark, folder):
    docs = [(r.doc_id, r.text) for r in catalog.documents(spark, folder).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in catalog.QUERIES["op6_decontamination"](spark, folder).collect()}
    assert got and got == brute_leaks(docs, items)


def test_leaks_of_odd_documents(spark):
    item = prose(60, 40)
    w = item.split()
    near = " ".join(w[:38] + ["edit"] + w[39:])  # two of 36 shingles differ
    far = " ".join(w[:10] + ["edit"] + w[11:20] + ["edit"] + w[21:30] + ["edit"] + w[31:])
    rows = [(1, prose(1, 50) + " " + item.upper() + " tail"), (2, near), (3, far), (4, prose(2, 90)), (None, item), (5, None), (6, ""), (7, "so Two words it is"), (8, item + " " + item), (9, "la " * 80)]
    benchmark = spark.createDataFrame([(1, item), (2, item), (3, "two WORDS"), (4, None), (5, " "), (6, "la " * 30)], "item_id long, text string")
    df = documents(spark, rows).withColumn("similarity", F.lit("clash")).withColumn("item", F.lit("clash"))
    found = decontamination.find_leaks(df, benchmark).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found}
    want = brute_leaks([r for r in rows if r[0] is not None], [(r.item_id, r.text) for r in benchmark.collect()])
    assert got == want and {(1, 1), (1, 2), (2, 1), (7, 3), (8, 1), (9, 6)} <= set(got) and (3, 1) not in got
    assert {r.start_word for r in found if r.doc_id == 1} == {51 - 1}
    assert decontamination.find_leaks(df.limit(0), benchmark).count() == 0
    assert decontamination.find_leaks(df, benchmark.limit(0)).count() == 0


def test_leaks_in_another_order(spark):
    items = [(i, prose(600 + i, 100)) for i in range(6)]
    rows = []
    for i, text in items:
        w = text.split()
        turned = [w[50:] + w[:50], w[33:] + w[:33], w[67:] + w[33:67] + w[:33], w[1:] + ["edit"]]
        rows += [(10 * i + k, " ".join([*prose(700 + i, 40).split(), *x, *prose(800 + i, 40 * (k % 2)).split()])) for k, x in enumerate(turned)]
    found = decontamination.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(rows, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == want and len(want) == len(rows)


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(63)
        flipped = x
        for b in rng.sample(range(63), decontamination.RADIUS):
            flipped ^= 1 << b
        pairs.append((x, flipped))
    df = spark.createDataFrame(pairs, "a long, b long")
    meet = F.arrays_overlap(decontamination.blocks(F.col("a"), decontamination.RADIUS), decontamination.blocks(F.col("b"), decontamination.RADIUS))
    assert df.where(~meet).count() == 0


def test_pipeline(spark, folder):
    docs = catalog.documents(spark, folder)
    kept, leaked = docs, {r.doc_id for r in catalog.QUERIES["op6_decontamination"](spark, folder).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == docs.columns, name
    final = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in kept.collect())
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in final)
    ids = {r.doc_id for r in final}
    assert not ids & leaked
    groups = brute_components([(r.doc_id, r.text) for r in docs.collect()], 80)
    assert not {k for k, least, _ in groups if k != least} & ids
    assert len(ids) >= 0.8 * sum(k == least for k, least, _ in groups)


def test_stages_bear_odd_documents(spark, folder):
    rows = odd(spark).withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).withColumn("ids", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns, name
        out.collect()
        assert stage(spark, rows.limit(0), folder).count() == 0, name
    one = corpus_pipeline.drop_near_duplicates(spark, rows, folder)
    assert Counter(r.doc_id for r in one.collect())[4] == 1 and one.where("doc_id = 5").count() == 0 and one.where("doc_id is null").count() == 2
    assert corpus_pipeline.encode_documents(spark, rows, folder).count() == rows.count()
