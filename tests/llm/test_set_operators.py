import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import SF, distance, groups, leaks, shingles

from corpusgraph.llm import decontam, fingerprints, jaccard, linedup, queries, shards


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("crowd", "block", "rounds"), [(jaccard.CROWD, jaccard.BLOCK, jaccard.ROUNDS), (1, 2, 3)])
def test_jaccard_matches_brute_force(edge_docs, edge_rows, crowd, block, rounds):
    ids, sizes = groups(edge_rows, 4, 85)
    got = jaccard.jaccard_groups(edge_docs, crowd=crowd, block=block, rounds=rounds).collect()
    assert ordered(tuple(r) for r in got) == ordered(zip([d for d, _ in edge_rows], sizes, ids, strict=True))


def test_jaccard_of_nothing(no_docs):
    assert jaccard.jaccard_groups(no_docs).count() == 0 and jaccard.one_of_each(no_docs).columns == no_docs.columns


def test_one_of_each(edge_docs, edge_rows):
    ids, sizes = groups(edge_rows, 5, 80)
    kept = jaccard.one_of_each(edge_docs).collect()
    assert edge_docs.columns == list(kept[0].asDict())
    wordless = [d for (d, _), n in zip(edge_rows, sizes, strict=True) if not n]
    assert ordered(r["doc_id"] for r in kept if r["text"] is None or not r["text"].split()) == ordered(wordless)
    assert sum(bool(r["text"] and r["text"].split()) for r in kept) == len({i for i, n in zip(ids, sizes, strict=True) if n})


def near_sets(rng, n):
    base = [np.unique(rng.integers(0, 1 << 63, size, np.uint64)) for size in (3, 20, 90, 400)]
    out = []
    for _ in range(n):
        s = base[rng.integers(4)].copy()
        k = rng.integers(0, max(1, len(s) // 8) + 1)
        s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 1 << 63, k, np.uint64)
        out.append(np.unique(s))
    return out


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(2)
    for n in (2, 7, 40, 150):
        sets = near_sets(rng, n)
        truth = [(i, j) for i in range(n) for j in range(i) if jaccard.linked(sets[i], sets[j], 85)]
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in truth:
            root[find(i)] = find(j)
        links = jaccard.tree_links(sets, 85)
        own = list(range(n))
        for i, j in links:
            assert jaccard.linked(sets[i], sets[j], 85)
            own[find(i, own)] = find(j, own)
        assert all((find(i) == find(j)) == (find(i, own) == find(j, own)) for i in range(n) for j in range(i))
        told = jaccard.possible([len(s) for s in sets], [len(s) for s in sets], [jaccard._bitmap(s, jaccard._width(len(s))).tobytes() for s in sets], 85)
        assert all(told[i] and told[j] for i, j in truth)


def test_edit_distance_and_lookups():
    rng = random.Random(5)
    for _ in range(4000):
        a = [rng.choice("abc") for _ in range(rng.randrange(1, 15))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(2)] = rng.choice(["", "a", "b"])
        a, b = "".join(a), "".join(b)
        for edits in (1, 2, 3):
            near = distance(a, b) <= edits
            assert linedup.within(a, b, edits) == near
            short, long = sorted((a, b), key=len)
            if near and len(short) > edits:
                own = [short[p : p + n] for p, n in linedup.segments(len(short), edits)]
                assert any(m == len(short) and own[i] == long[p : p + n] for i, m, p, n in linedup.lookups(len(long), edits))


def line_truth(rows, edits=2, least=20):
    """Components of lines: ``{line: (first place, links)}`` with places ``(no id, id, text, number)``."""
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    first = {}
    for none, d, t in docs:
        for n, x in enumerate(t.split("\n") if t else []):
            if len(x) >= least:
                first[x] = min(first.get(x, (True, 1 << 62)), (none, d, n, t))
    names = sorted(first)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = collections.Counter()
    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= edits and linedup.within(a, b, edits):
                degree[a] += 1
                degree[b] += 1
                root[find(a)] = find(b)
    start = {}
    for x in names:
        start[find(x)] = min(start.get(find(x), (True, 1 << 62)), first[x])
    return {x: (start[find(x)], degree[x]) for x in names}


@pytest.mark.parametrize("block", [linedup.BLOCK, 1])
def test_lines_match_brute_force(edge_docs, edge_rows, block):
    # two texts under one id are ordered by hash: leave them to the tests of removal
    rows = [(d, t) for d, t in edge_rows if d not in (9011, 9016)]
    truth = line_truth(rows)
    docs = linedup.hashed_text(edge_docs.where("doc_id IS NULL OR doc_id NOT IN (9011, 9016)").select("doc_id", "text"))
    got = linedup.line_classes(docs, block=block).collect()
    want = []
    for d, t in {(d, t or "") for d, t in rows}:
        told = []
        for n, x in enumerate(t.split("\n") if t else []):
            (none, of, number, _), links = truth.get(x, ((d is None, d or 0, n, t), 0))
            told.append((None if x not in truth or none else of, (none, of, number) == (d is None, d or 0, n), links))
        want.append((d, told))
    assert ordered((r["doc_id"], [(x["first_doc"], x["first"], x["n_links"]) for x in r["lines"]]) for r in got) == ordered(want)


def test_repeated_lines_go(edge_docs, edge_rows, no_docs):
    kept = linedup.without_repeats(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    lines = [x for r in rows if r["text"] for x in r["text"].split("\n") if len(x) >= linedup.LEAST_CHARS]
    repeated = collections.Counter(d for d, _ in edge_rows)
    assert all(n == 1 or repeated[9010] > 1 for n in collections.Counter(lines).values())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[9014]["text"] == "short" and by_id[9014]["n_chars"] == 5 and by_id[9013]["text"].count("\n") == 2 and 9015 not in by_id
    assert by_id[9001]["text"] is None and by_id[9002]["text"] == "" and by_id[9003]["text"] == " \n\t "
    assert linedup.without_repeats(no_docs).count() == 0


def test_short_lines_repeat_and_boilerplate_goes(spark, tmp_path):
    rows = [(i, f"menu\n\n}}\n{'rare' if i < 3 else f'own {i}'}\nA line of document number {'abcdefghijklmnop'[i] * 9}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_lines(spark, str(tmp_path)).collect()}
    assert got[0]["n_repeated"] == 0 and got[1]["n_repeated"] == 3 and got[5]["n_repeated"] == 2 and not any(r["n_links"] for r in got.values())
    assert got[2]["first_docs"] == [0, None, 0, 0, 2]
    kept = {r["doc_id"]: r["text"].split("\n")[:-1] for r in linedup.without_repeats(docs).collect()}
    assert kept[0] == ["menu", "", "}", "rare"] and kept[1] == ["", "rare"] and kept[5] == ["", "own 5"]


def test_lines_with_changed_words_are_near(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400)] + ["日", "本語"]
    texts = []
    for n in (14, 16, 25, 40, 59, 90, 300):
        for gap in " ", "":  # words, and a script without gaps
            w = rng.choices(vocabulary, k=n) if gap else [chr(0x4E00 + rng.randrange(500)) for _ in range(n)]
            texts.append(gap.join(w))
            for changes in (1, n // 12, n // 12 + 1, n // 9):
                x = list(w)
                for k in range(changes):  # far apart, as bad as may be
                    at = (k + 1) * len(w) // (changes + 1) if rng.random() < 0.7 else rng.randrange(len(x))
                    x[at : at + rng.randrange(2)] = rng.choice([[], ["changed" if gap else "変"], ["changed" if gap else "変"]])
                texts.append(gap.join(x))
    texts = sorted({x for x in texts if len(x) >= 20})
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [linedup._spaced(x).encode().split() for x in texts]
    want = collections.Counter()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            n = min(len(words[i]), len(words[j]))
            if linedup.within(a, b, 2) or n >= 16 and abs(len(words[i]) - len(words[j])) <= n // 12 and distance(words[i], words[j]) <= n // 12:
                want.update([i, j])
    got = {r["doc_id"]: r["n_links"] for r in queries.op5_lines(spark, str(tmp_path)).collect()}
    assert got == {i: want[i] for i in range(len(texts))} and sum(n > 0 for n in want.values()) > 40


def items_of(spark):
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return rows + [(900, None), (901, ""), (902, rows[0][1]), (903, "zig zag zog"), (904, rows[1][1].upper() + " more words at the end of it")]


def test_decontamination_matches_brute_force(spark, edge_rows):
    rng = random.Random(4)
    items = items_of(spark)
    prose = edge_rows[5][1].split()
    rows = list(edge_rows)
    for i, (_, t) in enumerate(items[:40]):
        w = t.split()
        if i % 3 == 1:
            w = w[rng.randrange(3) :]
        if i % 3 == 2 and len(w) > 46:
            w[rng.randrange(len(w))] = "changed"
        at = rng.randrange(len(prose))
        rows.append((20_000 + i, " ".join(prose[:at] + w + prose[at:])))
    rows += [(30_000, "x y zig ZAG zog y"), (30_001, items[0][1]), (30_002, items[1][1][: len(items[1][1]) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs, benchmark).collect()
    want = leaks(rows, [(i, t) for i, t in items if i != 903])
    for x, (d, t) in zip(want, rows, strict=True):
        if t and "zig zag zog" in t.lower():
            x.append(903)
    assert ordered((r["doc_id"], sorted(r["item_ids"])) for r in got) == ordered((d, sorted(x)) for x, (d, _) in zip(want, rows, strict=True))
    assert sum(bool(x) for x in want) > 35
    clean = decontam.contaminated(docs, benchmark, keep=True)
    assert clean.columns == docs.columns and clean.count() == sum(not x for x in want)


def test_decontamination_in_passes_and_without_items(spark, edge_docs, no_docs, monkeypatch):
    benchmark = spark.createDataFrame(items_of(spark), "item_id long, text string")
    whole = decontam.contaminated(edge_docs, benchmark).collect()
    monkeypatch.setattr(decontam, "PASS_CHARS", 2500)
    assert ordered(tuple(r) for r in decontam.contaminated(edge_docs, benchmark).collect()) == ordered(tuple(r) for r in whole)
    none = benchmark.limit(0)
    assert decontam.contaminated(edge_docs, none, keep=True).count() == edge_docs.count()
    assert decontam.contaminated(no_docs, benchmark, keep=True).columns == no_docs.columns


@pytest.mark.parametrize("most", [decontam.PASS_CHARS, 400])
def test_edited_copies_of_repeated_and_shared_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "PASS_CHARS", most)
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    twice, four, shared, outside = words(59), words(94), words(40), words(300)
    items = [(i, " ".join(twice)) for i in (1, 2)] + [(10 + i, " ".join(four) + " \n"[: i % 2] * i) for i in range(4)]
    own = [words(60) for _ in range(3)]
    items += [(20 + i, " ".join(shared + w)) for i, w in enumerate(own)]
    changed = lambda w, at: " ".join([*outside[:50], *w[:at], "changed", *w[at + 1 :], *outside[50:99]])
    rows = [(1, changed(twice, 29)), (2, changed(four, 40)), (3, changed(shared + own[1], 20)), (4, changed(shared + own[1], 70))]
    rows += [(5, " ".join(shared + outside[:60])), (6, " ".join(outside)), (7, changed([*shared[:20], "x", *shared[21:], *own[0]], 30))]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r["doc_id"]: r for r in got.collect()}
    assert {d: r["item_ids"] for d, r in found.items()} == {1: [1, 2], 2: [10, 11, 12, 13], 3: [21], 4: [21], 5: [], 6: [], 7: [20]}
    assert found[1]["similarity"] == pytest.approx(50 / 60) and found[2]["similarity"] == pytest.approx(85 / 95)


def test_weighted_items_keep_a_run():
    rng = np.random.default_rng(6)
    for _ in range(300):
        m = int(rng.integers(15, 200))
        weights = 1 / rng.choice([1, 2, 9, 40], 4)[np.sort(rng.integers(0, 4, m))]
        size = decontam.weighted_window_size(weights)
        for _ in range(40):
            edits, clear = rng.integers(0, m + 4, rng.integers(0, 8)), np.ones(m, bool)
            for e in edits.tolist():
                clear[max(0, e - 4) : e + 1] = False
            if size > 1 and weights[~clear].sum() <= weights.sum() / 9 and (weights != weights[0]).any():
                assert max(map(len, "".join(".x"[c] for c in clear.astype(int)).split("."))) >= size + decontam.STRIDE - 1


def test_hamming_index_is_complete():
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 1 << 63, 200, np.uint64)
    asked = np.concatenate([stored ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, k, replace=False)) if k else stored for k in (0, 1, 2, 3, 4)])
    at, entry = decontam.HammingIndex(stored).near(asked)
    want = {(i, j) for i in range(len(asked)) for j in range(200) if int(asked[i] ^ stored[j]).bit_count() <= 3}
    assert set(zip(at.tolist(), entry.tolist(), strict=True)) == want


def test_fingerprints_match_brute_force(edge_docs, edge_rows, no_docs):
    got = fingerprints.neighbour_report(edge_docs).collect()
    assert ordered((r["doc_id"], r["n_chars"]) for r in got) == ordered((d, len(t or "")) for d, t in edge_rows)
    once = [(d, t or "") for d, t in edge_rows if collections.Counter(x for x, _ in edge_rows)[d] == 1]
    line = sorted(once, reverse=True)
    by_id = {r["doc_id"]: r for r in got}
    for (a, t), (b, f) in zip(line, line[1:], strict=False):
        if any(b < d < a for d, _ in edge_rows if d is not None):
            continue
        half = len(t) // 2
        made = t[: len(t) - half] + f[:half]
        assert by_id[a]["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest()
        assert by_id[a]["near_next"] == fingerprints.likeness(by_id[a]["fingerprint"], by_id[b]["fingerprint"])
        x, y = set(shingles(t, 5)), set(shingles(made, 5))
        assert abs(by_id[a]["near_edited"] - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.25
    prints = collections.defaultdict(set)
    texts = dict(once)
    for d, t in texts.items():
        prints[t].add(by_id[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and by_id[9001]["fingerprint"] == "" and by_id[9004]["fingerprint"] == by_id[9005]["fingerprint"]
    assert fingerprints.neighbour_report(no_docs).count() == 0
    lone = fingerprints.neighbour_report(edge_docs.where("doc_id = 9012")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def test_likeness_is_unbiased():
    import pyarrow as pa

    rng = random.Random(1)
    errors = []
    for _ in range(60):
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([30, 200, 600]))]
        cut = rng.randrange(len(w))
        a, b = " ".join(w), " ".join(w[:cut] + [f"v{rng.randrange(10**9)}" for _ in w[cut:]])
        x, y = set(shingles(a, 5)), set(shingles(b, 5))
        p = fingerprints.fingerprints(pa.array([a, b]))
        errors.append(fingerprints.likeness(*p) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_shards(edge_docs, edge_rows, no_docs):
    got = shards.ring_shards(edge_docs, shards=8).collect()
    text = lambda t: (t or "").encode()
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == ordered((d, len(text(t)) + 1, zlib.crc32(text(t))) for d, t in edge_rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shards.ring_shards(no_docs).count() == 0


def test_one_hot_id_fills_many_ranges(spark):
    """Rows without id or text, and rows of one id, hold most of the table; the slots stay whole and rows of one id stay in ring order."""
    docs = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN NULL WHEN id % 2 = 0 THEN 7 ELSE id END AS doc_id", "CAST(NULL AS STRING) AS text", "id AS seq", "id AS number")
    got = shards.ring_shards(docs, shards=8).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 6000 and all(sorted(s) == list(range(750)) for s in slots.values()) and len(slots) == 8
    plan = shards.ring_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "arc" in plan and "_range" in plan
    home = {r["home_shard"] for r in got if r["doc_id"] == 7}
    assert len(home) == 1


def test_ring_placement_matches_a_plain_walk():
    rng = random.Random(9)
    points = shards.ring(5, 16)
    counts = {arc: rng.randrange(30) for arc in range(len(points))}
    total = sum(counts.values())
    for slack in (0.0, 0.25):
        limits = shards.capacities(total, 5, slack)
        load, want = [0] * 5, collections.Counter()
        waiting = dict(counts)
        for step in range(5):
            for arc in range(len(points)):
                way = list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))
                while waiting[arc] and load[way[step]] < limits[way[step]]:
                    load[way[step]] += 1
                    waiting[arc] -= 1
                    want[arc, way[step]] += 1
        got = collections.Counter()
        for arc, _, n, shard, _ in shards.place(counts, points, limits):
            got[arc, shard] += n
        assert got == want and sum(got.values()) == total


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    a = {r["doc_id"]: r["shard"] for r in shards.ring_shards(docs, 8, slack=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in shards.ring_shards(docs, 9, slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert ordered(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()) == ordered(want.fetchall())


def test_a_pair_is_compared_in_one_set_only(spark):
    """Near copies share many keys: each pair is met once, and links are counted, not handed out as rows."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(60)]
    texts = [" ".join(words[:i] + [f"changed{i}"] + words[i + 1 :]) for i in range(0, 60, 2)]
    docs = linedup.hashed_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    links = linedup.line_links(docs, block=7, share=linedup.WORD_SHARE).collect()
    total = collections.Counter()
    for r in links:
        total[r["h1"], r["h2"]] += r["n_links"]
    assert len(total) == 30 and set(total.values()) == {29} and len(links) < 30 * 29 // 2
    sets = [[1, 5, 9], [1, 5], [1, 9], [1]]
    assert [list(zip(*(x.tolist() for x in linedup.own_pairs(m, [s for s in sets if m in s])), strict=True)) for m in (1, 5, 9)] == [[(0, 3), (1, 2), (1, 3), (2, 3)], [(0, 1)], [(0, 1)]]
