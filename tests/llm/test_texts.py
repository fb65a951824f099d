import json
import random

import pytest
from pyspark.sql import functions as F

from signalspark.llm import chat_format, decontamination, labelled, packing, quality_classifier, quality_rules, toxicity, url_filters


@pytest.mark.parametrize(
    "query, sql",
    [
        (quality_rules.op2_quality_rules, quality_rules.OP2_SQL),
        (url_filters.op5_url_filters, url_filters.OP5_SQL),
        (chat_format.op6_chat_formatting, chat_format.OP6_SQL),
        (decontamination.op9_benchmark_decontamination, decontamination.OP9_SQL),
    ],
)
def test_query_is_its_sql(same, query, sql):
    assert same(query, sql)


def test_quality_rules_of_odd_rows(odd, none):
    judged = quality_rules.clean_and_judge(odd)
    rows = {r["doc_id"]: r for r in judged.collect() if r["doc_id"] is not None}
    assert judged.count() == odd.count()
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"] and rows[0]["cleaned_text"] == ""
    assert rows[6]["n_repeat_words"] == 28 and rows[6]["n_dup_lines"] == 1
    assert rows[10]["n_words"] == 30_000 and rows[10]["kept"]
    assert quality_rules.clean_and_judge(none).count() == 0


def test_repeated_windows_on_both_sides_of_the_bound(spark):
    def brute(words):
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})

    rng = random.Random(8)
    texts = {0: ["a"] * 90}
    for n in (1, 30, 32, 33, 34, 36, 120):  # n words that come twice have n - 2 windows
        block = [f"w{n}x{i}" for i in range(n)]
        texts[n] = [*block, "between", *block, *(f"u{i}" for i in range(rng.randint(0, 9)))]
    texts[999] = [rng.choice("abcdef") for _ in range(400)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measured(docs).collect()}
    assert found == {k: brute(w) for k, w in texts.items()}


def test_line_rules(spark):
    good = " ".join(f"w{i}" for i in range(60))
    bad = {"symbols": "a### b$$$ c%%% d&&& e***", "menu": "Home | News | About | Contact", "shout": "NOW!! BUY!! GO!! YES!!", "none": "--- ...", "phrase": "Click here to go on"}
    docs = spark.createDataFrame([(i, good + "\n" + s) for i, s in enumerate(bad.values())] + [(9, good)], "doc_id long, text string")
    for r in quality_rules.clean_and_judge(docs).collect():
        assert r["cleaned_text"] == good and r["kept"] and r["n_failed_lines"] == (r["doc_id"] != 9)
    lossy = spark.createDataFrame([(1, good + "\n" + "a### b### c### d### " * 15)], "doc_id long, text string")
    assert not quality_rules.clean_and_judge(lossy).first()["kept"]


def test_packing_has_no_faults(spark, sf, documents):
    pieces = [r.asDict() for r in packing.op3_packing(spark, sf).collect()]
    assert packing.faults(documents, pieces, packing.tokenizer_path()) == []
    assert all(t & (t - 1) == 0 for t in {p["tier"] for p in pieces})


def test_step_groups_weigh_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    tokens = 16_384
    pieces = packing.pack(docs, packing.tokenizer_path(), group_tokens=tokens).withColumn("part", F.shiftright("sequence_id", 33)).collect()
    weight, tiers, parts = {}, {}, {}
    for p in pieces:
        weight[p["step_group"]] = weight.get(p["step_group"], 0) + p["length"]
        tiers.setdefault(p["step_group"], set()).add(p["tier"])
        parts[p["step_group"]] = p["part"]
    for part in set(parts.values()):
        mine = sorted(g for g in weight if parts[g] == part)
        assert all(weight[g] == tokens for g in mine[:-1]) and weight[mine[-1]] <= tokens
        assert sum(len(tiers[g]) > 1 for g in mine) <= 3
    assert all(weight[g] == tokens for g in weight if len(tiers[g]) == 1 and g not in {max(h for h in weight if parts[h] == q) for q in set(parts.values())})


def test_words_are_tokenized_as_whole_texts_are():
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokenizer(packing.tokenizer_path(), 50)
    rng = random.Random(1)
    parts = ["it's", "Don'T", "a.b,c", "...", ",.", "x,", "ÄÖÜ", "straße", "ΑΣ", "İ", "T̈", "é", "\xa0", "\x1c", " ", "12,5", "<|endoftext|>", "a<|endoftext|>b", "___", "_,", "&,", "''", "'s", "日本語", "\U0001f600", "µ", "½", "×,", "²."]
    for _ in range(300):
        text = rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", "\n", ",", ". "]) for _ in range(12))
        assert next(ours.encode([text])) == packing.np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes(), repr(text)


def test_packing_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = packing.pack(odd.coalesce(1), packing.tokenizer_path(), keep=("version",)).withColumn("ids_crc32", packing.ids_crc32(F.col("token_ids")))
    pieces = [r.asDict() for r in got.collect()]
    single = [r for r in rows if [x[0] for x in rows].count(r[0]) == 1]
    mine = [p for p in pieces if p["doc_id"] in {d for d, _ in single}]
    assert [f for f in packing.faults(single, mine, packing.tokenizer_path()) if f.startswith("document")] == []
    assert {p["version"] for p in pieces} == {"v"} and sum(p["doc_tokens"] for p in pieces if p["start"] == 0 and p["doc_id"] == 5) == 2 * next(p["doc_tokens"] for p in pieces if p["doc_id"] == 5)
    assert packing.pack(none, packing.tokenizer_path()).count() == 0
    padded = packing.pack(odd.coalesce(1), packing.tokenizer_path(), shortest=64).select("tier").distinct().collect()
    assert sum(r["tier"] & (r["tier"] - 1) != 0 for r in padded) <= 1


def test_urls_inherit_decisions(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/de/1">'),
            (2, "https://b.com/de/1", None),
            (3, "http://c.net/y", '<META http-equiv=refresh content="0; url=/z">'),
            (4, "http://c.net/z?q", "<link href='//a.net/x' rel='canonical nofollow'>"),
            (5, None, None),
            (6, "nonsense", ""),
            (7, "http://d.net/1", '<link rel="canonical" href="http://X.org/q"><link rel=canonical href=http://b.com/de/7>'),
            (8, "http://e.net/1", None),
            (8, "http://e.net/1", None),
            (9, "HTTP://EXAMPLE.ORG", None),
            (None, "http://f.net/1", '<link rel="canonical" href="http://f.net/1">'),
        ],
        "page_id long, url string, html string",
    ).withColumn("host", F.lit("clash"))
    redirects = spark.createDataFrame([("http://e.net/1", "http://www.b.com/de/2"), (None, "http://x.net/"), ("http://a.net/", None)], "source string, target string")
    got = [(r["page_id"], r["verdict"]) for r in url_filters.judge_urls(pages, redirects).collect()]
    assert sorted(got, key=repr) == sorted([(1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block"), (8, "block"), (9, "allow"), (None, "allow")], key=repr)
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def generated_pages(seed, count=150):
    """Pages whose canonical links and refresh tags form chains, stars and loops between hosts."""
    rng = random.Random(seed)
    hosts, paths = ["a.net", "b.com", "example.org", "w.example.org", "c.de", "x.com"], ["/", "/de/1", "/fr/2", "/es/3", "/en/1", "/q", ""]
    url = lambda: rng.choice(["http://", "HTTPS://"]) + rng.choice(hosts) + rng.choice(["", ":1"][:1]) + rng.choice(paths) + rng.choice(["", "?k", "#f", str(rng.randrange(30))])
    rows = []
    for i in range(count):
        target = rng.choice([url(), "/de/" + str(rng.randrange(9)), "near", "//" + url().partition("://")[2]])
        tag = rng.choice(["", "", f'<link rel="canonical" href="{target}">', f"<LINK href='{target}' rel=canonical>", f'<meta http-equiv="Refresh" content="3; URL={target}">', f'<link rel="next" href="{target}">'])
        rows.append((i, url(), rng.choice(["<html>", "text "]) + tag + "<p>" + rng.choice(["", "x" * 50])))
    return rows


def test_inherited_decisions_are_those_of_the_sql_and_of_brute_force(spark):
    import duckdb

    for seed in range(3):
        rows = generated_pages(seed) + [(900, "http://a.net/long", "y<" * 400_000 + '<link rel="canonical" href="http://x.com/de/8">'), (901, None, None)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        judged = url_filters.judge_urls(pages).collect()
        got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judged)
        db, frame = duckdb.connect(), pages.toPandas()
        db.register("pages", frame)
        assert got == sorted(db.execute(url_filters.OP5_SQL).fetchall())
        # brute force: spread decisions along edges until nothing changes
        links = {}
        for r in judged:
            links.setdefault(r["component"], []).append(r)
        for mine in links.values():
            direct = {r["verdict"] for r in mine if r["rule"]}
            free = {r["verdict"] for r in mine if not r["rule"]}
            assert len(free) <= 1 and (not free or "allow" not in direct or free == {"allow"})
        assert {r["verdict"] for r in judged if r["rule"] is None} == {"allow", "block"}


def test_control_strings_round_trip():
    for text in ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "[[INST]INST]", "", "a\n<|end|>\n", "<|turn|>user\nhi<|end|>\n", "\\n", "\U0001f600<s>"]:
        safe = chat_format.escaped(text)
        assert chat_format.unescaped(safe) == text and not any(c in safe for c in chat_format.CONTROLS)
        turns = [("user", text), (text, text), ("assistant", text)]
        whole, spans = chat_format.formatted(turns)
        assert chat_format.parsed(whole) == turns
        assert [chat_format.unescaped(whole[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_mixed_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": None, "output": "a"},
    ]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(10, None, "x"), (11, "[1", "x"), (12, '{"other": 1}', "x"), (13, "3", "x")]
    frame = spark.createDataFrame(rows, "id int, record string, formatted string")
    done = {r["id"]: r for r in chat_format.format_json(frame).collect()}
    for i in range(4):
        assert done[i]["known"] and chat_format.parsed(done[i]["formatted"]) == turns
    assert not any(done[i]["known"] for i in range(10, 14)) and done[10]["formatted"] is None
    assert len({done[i]["fingerprint"] for i in range(4)}) == 4


def test_records_that_are_hard_to_read(spark):
    deep = "[" * 50_000
    long = "x </s> " * 100_000
    records = ['{"prompt": "\\ud800 a \\ud83d\\ude00", "response": "b"}', '{"\\ud800": 1}', deep, '{"a":' * 50_000, json.dumps({"prompt": long, "response": None}), "NaN", '{"messages": [null]}', '{"messages": []}', "", None]
    frame = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    done = {r["id"]: r for r in chat_format.format_json(frame).collect()}
    assert chat_format.parsed(done[0]["formatted"]) == [("user", "\ufffd a \U0001f600"), ("assistant", "b")]
    assert chat_format.parsed(done[4]["formatted"]) == [("user", long), ("assistant", "")]
    assert [i for i, r in done.items() if r["known"]] == [0, 4]
    read = chat_format.format_json(frame).select("id", chat_format.read_back(F.col("formatted"), F.col("loss_spans")).alias("d")).select("id", "d.*").collect()
    assert {r["id"]: r["n_turns"] for r in read} == {i: 2 if i in (0, 4) else None for i in range(10)}
    assert chat_format.format_json(frame.limit(0)).count() == 0


def test_conversations_are_laid_out_in_two_ways(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 0, "user", "q"), (3, 0, None, None), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    done = {r["conv_id"]: r for r in chat_format.format_json(chat_format.laid_out(rows)).collect()}
    assert len({r["fingerprint"] for r in done.values()}) == 2 and all(r["known"] for r in done.values())
    assert chat_format.parsed(done[1]["formatted"]) == [("user", "q"), ("assistant", "")] and chat_format.parsed(done[3]["formatted"]) == [("", "")]
    assert chat_format.laid_out(rows.limit(0)).count() == 0


def test_odd_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    done = {r["conv_id"]: r for r in chat_format.format_turns(chat_format.grouped_turns(rows), "record").collect()}
    assert chat_format.parsed(done[1]["formatted"]) == [("", "x"), ("user", ""), ("user", "")] and done[None]["n_turns"] == 1


def test_contained_items_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "One, two three FOUR five six seven eight nine ten!"), (2, "word"), (3, None), (4, " "), (None, "word"), (5, "a b c d e f g h"), (1, "One, two three FOUR five six seven eight nine ten!")], "item_id long, text string")
    for rows in (decontamination.BROADCAST_ROWS, 0):
        got = sorted({(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(odd, items, rows).collect()})
        assert got == [(3, 2), (4, 2), (5, 1), (6, 1), (11, 1), (41, 1)]
    kept = decontamination.without_items(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 7
    assert decontamination.contained_items(none, items).count() == 0 and decontamination.contained_items(odd, items.limit(0)).count() == 0


def test_short_items_are_found_inside_documents(spark):
    import duckdb

    docs = spark.createDataFrame([(1, "zero one Two, three four five six"), (2, "two one three"), (3, "one"), (4, "four five"), (5, None), (6, "one two three four x one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two"), (2, "ONE"), (3, "three four five six"), (4, "a b c d e f"), (5, "zero one two three four five six")], "item_id long, text string")
    want = [(1, 1), (1, 2), (1, 3), (1, 5), (2, 2), (3, 2), (6, 1), (6, 2)]
    db = duckdb.connect()
    for name, frame in (("documents", docs.toPandas()), ("benchmark", items.toPandas())):
        db.register(name, frame)
    theirs = sorted(db.execute(decontamination.OP9_SQL).fetchall())
    for rows in (decontamination.BROADCAST_ROWS, 0):
        ours = sorted(map(tuple, decontamination.contained_items(docs, items, rows).collect()))
        assert ours == theirs and [r[:2] for r in ours] == want


def test_sketches_lose_no_item(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate([5, 6, 9, 14, 30, 59, 120])]
    docs = []
    for i, text in items:
        for k in range(12):
            words = text.split()
            at = rng.randrange(len(words))
            if k % 3:
                words[at:at] = [] if k % 2 else ["extra"]
                words[0] = "changed"
            docs.append((100 * i + k, "before it " * 40 + " ".join(words) + " after it" * 40))
    shingles = lambda t: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in docs for i, x in items if len(shingles(t) & shingles(x)) * 10 >= 8 * len(shingles(x))}
    got = decontamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("module, query, label, least", [(toxicity, toxicity.op10_toxicity, "toxic", 0.95), (quality_classifier, quality_classifier.op4_quality_classifier, "quality", 0.95)])
def test_classifier_on_held_out_documents(spark, module, query, label, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert sum(p == y for p, y, _ in rows) / len(rows) >= least and all(0 <= s <= 1 for _, _, s in rows)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers_of_odd_rows(spark, odd, none, module, label):
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (3, None), (5, 1)], f"doc_id long, {label} long")
    for known in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        model = module.fitted(odd, known)
        scored = module.score_documents(odd, model)
        rows = scored.collect()
        assert len(rows) == odd.count() and set(scored.columns) == {*odd.columns, "predicted"} and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
        assert module.score_documents(none, model).count() == 0


def test_samples_are_bounded_and_the_same(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    a, b = (sorted(r["doc_id"] for r in labelled.sample(ids.repartition(n), 100, 1).collect()) for n in (1, 7))
    assert a == b and len(a) == 100


def test_toxicity_trains_on_every_ordinary_text(monkeypatch):
    seen, trained = [], toxicity._trained
    monkeypatch.setattr(toxicity, "_trained", lambda size, samples, segment: seen.append(samples) or trained(size, samples, segment))
    ordinary = [" ".join(f"a{k}b{i}" for i in range(1000)) for k in range(330)] + ["étude last of all"]
    toxicity.train(["vile word vile", "vile word again"], ordinary, 0.1)
    assert any("étude last".encode() in s for s in seen[0]) and len(seen[0]) == 330 * (1000 // toxicity.WINDOW) + 1


def test_many_urls_without_an_address_meet_in_no_task(spark):
    """Two thirds of the pages have none: by either join they keep their verdict, and are dealt to all partitions."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://a.net/"), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "odd").alias("url"), F.when(F.col("id") % 30 == 0, '<link rel="canonical" href="http://b.com/de/1">').alias("html"))
    got = {}
    for bound in (0, 200_000):
        done = url_filters.judge_urls(pages, broadcast_rows=bound)
        got[bound] = sorted((r["page_id"], r["verdict"]) for r in done.collect())
    assert got[0] == got[200_000] == [(i, "block" if i % 30 == 0 else "allow") for i in range(3000)]
