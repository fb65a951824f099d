import os
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from signalspark.llm import components, line_dedup, simhash, substring_dedup


def by_rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, None), (41, 40), (41, 40)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(42)} | {k: 100 for k in range(100, 160)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_partitions_run_few_tasks(spark):
    """The driver keeps something of every task; stars need no round, and a round has six stages."""
    chain, stars = [(i, i + 1) for i in range(300)], [(k % 7, k) for k in range(7, 300)]
    held = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in held}
    tracker, tasks = spark.sparkContext.statusTracker(), []
    for name, edges in (("chain", chain), ("stars", stars)):
        frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
        try:
            for k, v in held.items():
                spark.conf.set(k, v)
            spark.sparkContext.setJobGroup(f"components of {name}", name)
            assert dict(map(tuple, components.connected_components(frame).collect())) == {b: 0 if edges is chain else b % 7 for e in edges for b in e}
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            for k, v in kept.items():
                spark.conf.set(k, v)
        stages = {s for j in tracker.getJobIdsForGroup(f"components of {name}") for s in tracker.getJobInfo(j).stageIds}
        tasks.append(sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i))
    assert tasks[0] < 1_000 and tasks[1] < 100


def plain_fingerprint(text):
    """A fingerprint by adding up the bits of whole numbers."""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, most=4):
    """The smallest value reachable by links of ``most`` differing bits at most, by every pair; values
    are (id, fingerprint)."""
    root = {i: i for i, _ in values}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(values):
        for j, b in values[:k]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= most:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in root}


def test_simhash_query_is_brute_force(spark, sf, documents):
    prints = {d: plain_fingerprint(t) for d, t in documents}
    group = linked(list(prints.items()))
    assert by_rows(simhash.op1_simhash_near_dedup(spark, sf)) == sorted(((d, f"{f:016x}", group[d]) for d, f in prints.items()), key=repr)


@pytest.fixture(scope="module")
def near_prints(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:40]:
        for k in range(1, 6):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), k)))
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)]  # a dense group
    rows = list(enumerate(sorted({simhash._signed(p) for p in prints})))
    return rows, linked(rows), spark.createDataFrame(rows, "id long, fp long")


@pytest.mark.parametrize("chain, crowd", [(2, None), (3, None), (4, None), (2, 0), (3, 5), (2, 10**9)])
def test_pigeonring_loses_no_link_at_any_chain_and_crowd(near_prints, chain, crowd):
    rows, want, frame = near_prints
    found = {r["id"]: r["component"] for r in simhash.fingerprint_components(frame, 4, chain, crowd).collect()}
    assert found == want


def test_keys_widen_with_the_number_of_fingerprints():
    assert [simhash.chain_length(n, 4) for n in (10, 10**6, 10**8, 10**10)] == [2, 2, 3, 4]
    for total in (10**3, 10**6, 10**8, 10**9, 10**10):
        assert total >> simhash.key_bits(4, simhash.chain_length(total, 4)) < simhash.BY_CHANCE
    for most in (1, 2, 3, 4, 7):  # every pair within the distance shares a key
        rng = random.Random(most)
        for chain in range(2, max(2, min(4, most)) + 1):
            masks = simhash._masks(most, chain)
            for _ in range(300):
                x = sum(1 << b for b in rng.sample(range(64), most))
                assert any(not x & mask for _, _, mask in masks)


def test_fingerprints_of_odd_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a  B") != simhash.fingerprint("a c")
    assert simhash.fingerprint("É") != simhash.fingerprint("é")


def test_simhash_groups_of_odd_rows(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    group = {r["doc_id"]: r["component_id"] for r in rows}
    assert group[0] == group[1] == group[2] == group[None] == 0 or group[None] == 7
    assert group[3] == group[4] == 3 and group[7] == group[8] == group[40] == 7
    assert simhash.simhash_groups(none).count() == 0


def test_near_duplicates_are_those_of_similar_shingles(spark, sf, documents):
    found = dict(map(tuple, simhash.near_duplicate_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()))
    shingles = {d: simhash._shingles(t, 5) for d, t in documents}
    for a, x in shingles.items():
        for b, y in shingles.items():
            if a < b and x | y and 5 * len(x & y) >= 4 * len(x | y):
                assert found[a] == found[b]
    members = defaultdict(list)
    for d, g in found.items():
        members[g].append(d)
    for g, mine in members.items():
        assert g == min(mine)
        for d in mine if len(mine) > 1 else ():
            assert any(not x | y or len(x & y) >= 0.8 * len(x | y) for e in mine if e != d for x, y in [(shingles[d], shingles[e])])


def test_near_duplicates_of_a_crowded_group_meet_in_the_middle(spark):
    rng = random.Random(3)
    words = ["word%d" % i for i in range(2000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    texts.append(" ".join(rng.choice(words) for _ in range(200)))
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == [1000 - len(texts) + 1, 1000 - len(texts) + 2]


def test_near_duplicates_keep_columns_and_odd_rows(odd, none):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 8 not in ids and 40 not in ids and ids.count(None) == 2 and ids.count(7) == 2
    assert simhash.drop_near_duplicates(none).count() == 0


def test_line_query_is_its_sql(same):
    assert same(line_dedup.op7_line_dedup, line_dedup.OP7_SQL)


def brute_lines(rows, min_words=5):
    """Removed line numbers by comparing every two places."""
    lines = [(d, [(k, s.strip(), len(s.split())) for k, s in enumerate((t or "").split("\n")) if s.strip()]) for d, t in rows]
    gone = defaultdict(set)
    for d, mine in lines:
        for e, theirs in lines:
            if e > d:
                continue
            for i in range(len(mine)):
                for j in range(i if e == d else len(theirs)):
                    n = words = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n][1] == theirs[j + n][1]:
                        words += mine[i + n][2]
                        n += 1
                    if words >= min_words:
                        gone[d].update(k for k, _, _ in mine[i : i + n])
    return {d: sorted(gone[d]) for d, _ in lines}


def test_line_runs_are_brute_force(spark):
    rng = random.Random(4)
    pool = ["a", "b", "c d", "e f g", "h i j k l m"]
    rows = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    done = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["removed_lines"] for r in done.collect()} == brute_lines(rows)


def test_runs_are_maximal(spark):
    a = "\n".join(f"line number {k} of the long run" for k in range(40))
    rows = [(1, "start of one\n" + a), (2, a + "\nand an end here"), (3, "x\n" + a.split("\n", 10)[10] + "\ny"), (4, a.split("\n")[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as version", "text")
    runs = line_dedup.repeated_runs(line_dedup._lines(docs, 5)).collect()
    assert sorted((r["doc_id"], r["i"], r["length"], r["first"]["doc_id"], r["first"]["i"]) for r in runs) == [(2, 0, 40, 1, 1), (3, 1, 30, 1, 11), (4, 0, 1, 1, 1)]


def brute_runs(rows, min_words=5):
    """Maximal runs by comparing every two places: (doc_id, i, length, first place)."""
    lines = {d: [s.strip() for s in t.split("\n") if s.strip()] for d, t in rows}
    places = sorted((d, i) for d, mine in lines.items() for i in range(len(mine)))

    def common(a, b):
        n = 0
        while a[1] + n < len(lines[a[0]]) and b[1] + n < len(lines[b[0]]) and lines[a[0]][a[1] + n] == lines[b[0]][b[1] + n]:
            n += 1
        return n

    longest = {}
    for k, place in enumerate(places):
        lengths = [common(place, earlier) for earlier in places[:k]]
        most = max(lengths, default=0)
        longest[place] = (most, places[lengths.index(most)] if most else None)
    found = []
    for (d, i), (n, first) in longest.items():
        if n and longest.get((d, i - 1), (0, None))[0] <= n and sum(len(s.split()) for s in lines[d][i : i + n]) >= min_words:
            found.append((d, i, n, *first))
    return sorted(found)


def found_runs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as version", "text")
    runs = line_dedup.repeated_runs(line_dedup._lines(docs, 5)).collect()
    return sorted((r["doc_id"], r["i"], r["length"], r["first"]["doc_id"], r["first"]["i"]) for r in runs)


def test_runs_of_several_sources_are_whole(spark):
    rows = [(1, "a a\nb b\nc c\nx"), (2, "a a\nb b\nc c\nd\ne\nf f"), (3, "y\na a\nb b\nc c\nd\ne\nf f")]
    assert found_runs(spark, rows) == [(2, 0, 3, 1, 0), (3, 1, 6, 2, 0)] == brute_runs(rows)


def test_runs_are_brute_force(spark):
    rng = random.Random(11)
    pool = ["a", "b", "c d", "e f g", "h i j k l m"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(30)]
    long = [rng.choice(pool) for _ in range(45)]
    rows += [(30, "\n".join(long)), (31, "\n".join(long)), (32, "\n".join([*long[:20], "z", *long[20:]])), (33, "\n".join(["a"] * 25)), (34, "z\n" + "\n".join(long[7:]))]
    assert found_runs(spark, rows) == brute_runs(rows)
    assert found_runs(spark, [*rows, rows[3], rows[31]]) == brute_runs(rows)


def test_scratch_tables_go(spark):
    from signalspark.llm.common import checkpoint_folder

    before = set(os.listdir(checkpoint_folder(spark).removeprefix("file:")))
    found_runs(spark, [(1, "a b c d e"), (2, "a b c d e\nf")])
    assert not [f for f in set(os.listdir(checkpoint_folder(spark).removeprefix("file:"))) - before if f.startswith("lines-")]


def test_hot_keys_are_joined_whole(spark):
    from signalspark.llm.common import join_counted

    rows = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 0, id) as k", "cast(id % 2 as string) as j")
    keyed = rows.groupBy("k", "j").agg(F.count("*").alias("n"), F.min("id").alias("m")).where("k % 5 = 0")
    found = join_counted(rows, keyed, ["k", "j"])
    assert keyed.agg(F.max("n")).first()[0] > 1000 and sorted(found.columns) == ["id", "j", "k", "m"]
    assert by_rows(found.select("id", "k", "j", "m")) == by_rows(rows.join(keyed.drop("n"), ["k", "j"]).select("id", "k", "j", "m"))
    every = join_counted(rows, keyed, ["k", "j"], how="left").select("id", "k", "j", F.coalesce("m", F.lit(-1)))
    assert by_rows(every) == by_rows(rows.join(keyed.drop("n"), ["k", "j"], "left").select("id", "k", "j", F.coalesce("m", F.lit(-1))))


def test_lines_of_odd_rows(odd, none):
    done = line_dedup.remove_repeated_lines(odd)
    assert set(done.columns) == {*odd.columns, "n_lines", "removed_lines"}
    rows = done.collect()
    assert len(rows) == odd.count()
    text = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    assert text[0] is None and text[1] == "" and text[2] == " \n\t " and text[6] == "" and text[40] == "" and text[8] == ""
    assert "one two" in text[5] and "\nof\nof\n" in text[11] and "one two" not in text[11]
    assert line_dedup.remove_repeated_lines(none).count() == 0


def test_substring_query_is_brute_force(spark, sf, documents):
    assert by_rows(substring_dedup.op8_substring_dedup(spark, sf)) == sorted(substring_dedup.brute_force(documents), key=repr)


def test_substring_query_is_its_sql(same):
    assert same(substring_dedup.op8_substring_dedup, substring_dedup.OP8_SQL)


def test_substrings_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    done = substring_dedup.remove_repeated_passages(odd)
    got = sorted((r["doc_id"], r["n_words"], sum(b - a for a, b in r["removed_spans"])) for r in done.collect())
    assert got == sorted(r[:3] for r in substring_dedup.brute_force(rows))
    assert substring_dedup.remove_repeated_passages(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeated_passages(odd, 6)


def test_substrings_at_every_shift(spark):
    rng = random.Random(6)
    words = [str(i) for i in range(10_000)]
    shared = rng.sample(words, 13)
    rows = [(i, " ".join(rng.sample(words, i % 9) + shared + rng.sample(words, i % 5))) for i in range(40)]
    done = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in done.where(F.col("doc_id") > 0).collect():
        assert r["removed_spans"] == [[r["doc_id"] % 9, r["doc_id"] % 9 + 13]]


def exact_groups(rows):
    """Group of each document: the smallest doc_id linked at Jaccard 0.8 of five-word shingles, by every pair."""
    sets = [(d, simhash._shingles(t, 5)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def top(d):
        return d if root[d] == d else top(root[d])

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            shared = len(x & y)
            if 5 * shared >= 4 * (len(x) + len(y) - shared):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: top(d) for d in root}


def edited_rows(count=40):
    """Texts with a copy each of a replaced tail, a cut passage, or scattered words changed."""
    rng = random.Random(8)
    words = ["word%d" % i for i in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for k in range(count):
        base = some(rng.randint(60, 600))
        n = len(base)
        for share in (0.06, 0.1, 0.11, 0.14):
            tail = base[: n - int(share * n)] + some(int(share * n))
            at = rng.randrange(n // 2)
            cut = base[:at] + base[at + int(1.7 * share * n) :]
            mixed = list(base)
            for i in rng.sample(range(n), max(1, int(share * n / 5))):
                mixed[i] = rng.choice(words)
            rows += [" ".join(w) for w in (base, (tail, cut, mixed)[k % 3])]
            base = some(n)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_of_replaced_tails_and_cut_passages_are_all_found(spark):
    rows = edited_rows()
    found = dict(map(tuple, simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == exact_groups(rows)


def test_near_duplicates_of_documents_are_the_exact_groups(spark, sf, documents):
    found = dict(map(tuple, simhash.near_duplicate_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()))
    assert found == exact_groups(documents)


def test_near_duplicates_of_a_crowded_group_are_the_exact_groups(spark):
    rng = random.Random(9)
    words = ["word%d" % i for i in range(2000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(300, " ".join(base)), (301, " ".join(rng.choice(words) for _ in range(200)))]
    for k in range(150):
        copy = list(base)
        for at in rng.sample(range(200), 2 + k % 4):
            copy[at] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    found = dict(map(tuple, simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == exact_groups(rows)


def test_fingerprint_links_are_those_of_every_pair(spark):
    rng = random.Random(12)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints[:20] for k in (0, 1, 3, 4, 5)]
    rows = list(enumerate(map(simhash._signed, prints)))
    pairs = [tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame(rows, "id long, fp long")).collect()]
    assert all(a < b and (prints[a] ^ prints[b]).bit_count() <= 4 for a, b in pairs) and len(set(pairs)) == len(pairs)
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert {i: found.get(i, i) for i, _ in rows} == linked(rows)


def test_near_duplicates_come_through_fingerprints_and_in_any_number_of_parts(spark, monkeypatch):
    """Near fingerprints give candidates, shingles the rest; one part's rows are on disk at a time."""
    links, shared = simhash.fingerprint_links, simhash._shared
    seen, rows = [], []
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: (seen.append(links(*a)), seen[-1])[1])
    monkeypatch.setattr(simhash, "_shared", lambda *a: (rows.append(a[2]), shared(*a))[1])
    monkeypatch.setattr(simhash, "PART_ROWS", 1_200)
    monkeypatch.setattr(simhash, "PART_PAIRS", 15)
    texts = edited_rows(4)
    texts += [(1000 + d, t.rpartition(" ")[0] + " last") for d, t in texts if len(t.split()) > 300]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert dict(map(tuple, simhash.near_duplicate_groups(docs).collect())) == exact_groups(texts)
    assert len(seen) == 1 and seen[0].count() > 0 and len(rows) == 2 * rows[0] and rows[0] > 1
    for _, t in [*texts[:5], (0, ""), (1, "one"), (2, "a b c d e f a b c d e f")]:
        assert simhash._majority(simhash._hashed(t, 5)) == simhash.fingerprint(t, 5, distinct=True)


def rows_made(spark, pattern):
    """Rows that Spark's plan nodes of such a description made so far."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        values = store.executionMetrics(runs.apply(i).executionId())
        nodes = store.planGraph(runs.apply(i).executionId()).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = node.metrics()
            for metric in map(metrics.apply, range(metrics.size()) if re.search(pattern, node.desc()) else []):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_near_duplicates_in_more_parts_join_and_deal_out_no_more_rows(spark, monkeypatch):
    """What is known of each text is joined once, and shingles are dealt out once, however many parts there are."""
    docs = spark.createDataFrame(edited_rows(4), "doc_id long, text string")
    found = []
    for size in (10**9, 1_200):
        monkeypatch.setattr(simhash, "PART_ROWS", size)
        patterns = [r"Join \[id#\d+L?\], \[node#", r"Generate posexplode\(prefix"]
        before = [rows_made(spark, p) for p in patterns]
        groups = sorted(map(tuple, simhash.near_duplicate_groups(docs).collect()))
        found.append(([rows_made(spark, p) - n for p, n in zip(patterns, before, strict=True)], groups))
    assert found[0] == found[1] and all(found[0][0])


def test_parts_of_any_size_remove_the_same(spark, odd):
    """Parts follow from the bytes of text; few large ones and many small ones give the same rows."""
    rows = lambda size: sorted((r["doc_id"], r["n_words"], str(r["removed_spans"])) for r in substring_dedup.remove_repeated_passages(odd, part_bytes=size).collect())
    assert rows(2_000) == rows(16_000_000)
