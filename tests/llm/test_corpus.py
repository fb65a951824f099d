"""Ranked search, collocations and WARC archives."""

import base64
import collections
import gzip
import hashlib
import io
import math
import random
import re

import pyarrow as pa
import pytest

from signalspark.llm import collocations as C
from signalspark.llm import ranked_search, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("query, sql", [(ranked_search.op11_ranked_lexical_search, ranked_search.OP11_SQL), (C.op12_phrase_collocations, C.OP12_SQL), (warc.op13_warc, warc.OP13_SQL)])
def test_query_is_its_sql(same, query, sql):
    assert same(query, sql)


# search ------------------------------------------------------------------------------------------


def plain_search(docs, items, best):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    docs = [(d, collections.Counter(terms(t))) for d, t in docs if d is not None]
    docs = [(d, c, c.total()) for d, c in docs if c]
    N, L = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    rows = []
    for i, asked in wanted.items():
        found = []
        for d, c, n in docs:
            m = 100 - 50 + (50 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, d))
        rows += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(found)[:best])]
    return sorted(rows)


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, rank int, score string")


def test_search_of_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "One TWO three w1 w1 w2"), (2, None), (3, ""), (4, "É ß-word"), (5, "nowhere"), (1, "fourteen w3"), (None, "one"), (6, " ".join(f"w{i}" for i in range(300)))]
    expected = plain_search(docs, items, 50)
    assert {r[0] for r in expected} == {1, 4, 6} and len({r[3] for r in expected}) < len(expected)
    for blocks in (10, 200_000):
        got = sorted(tuple(r) for r in ranked_search.search(odd, items_frame(spark, items), block_terms=blocks).collect())
        assert got == expected
    assert sorted(tuple(r) for r in ranked_search.search(odd.repartition(7), items_frame(spark, items), best=3).collect()) == plain_search(docs, items, 3)
    assert ranked_search.search(none, items_frame(spark, items)).count() == 0
    assert ranked_search.search(odd, items_frame(spark, [])).count() == 0


def test_search_over_many_windows(spark):
    """Several windows a task, a third of the documents alike, and more ties than there are places."""
    rng = random.Random(3)
    docs = [(i, "same words here" if i % 3 == 0 else " ".join(rng.choice(["same", "words", "here", "rare", "x%d" % rng.randrange(400)]) for _ in range(rng.randrange(1, 9)))) for i in range(10_000)]
    rng.shuffle(docs)
    items = [(i, text) for i, text in enumerate(["same words here", "rare x1 x2 x3", "here"])]
    got = sorted(tuple(r) for r in ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), items_frame(spark, items)).collect())
    assert got == plain_search(docs, items, 50)


# collocations ------------------------------------------------------------------------------------


def plain_counts(rows):
    counts, totals = {}, collections.Counter()
    for lang, text in rows:
        mine = counts.setdefault(lang or "und", collections.Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                mine.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def plain_collocations(rows, least, best):
    counts, totals = plain_counts(rows)
    out = []
    for lang, mine in counts.items():
        candidates = {p: a for p, a in mine.items() if a >= least and len(p) > 1}
        longer = collections.Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        found = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (mine[p[:k]] + mine[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


def phrases(seed, n, vocabulary=9):
    rng = random.Random(seed)
    words = ["of", "The", "é", "ab", "abc", "z", "\U0001f600", "x-y", "\xa0"][:vocabulary]
    return [(rng.choice(["en", "en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n"]) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("range_bytes, shard_nodes", [(6_000_000, 3_000_000), (200, 100), (1000, 1)])
def test_collocations_are_the_plain_ones(spark, range_bytes, shard_nodes):
    rows = phrases(1, 120) + [("en", "a b c d " * 40), ("en", None), (None, ""), ("de", "of"), ("en", "the " * 200)]
    frame = spark.createDataFrame([(lang, text, "clash", 7) for lang, text in rows], "lang string, text string, phrase string, rank int").repartition(5)
    for least, best in ((30, 2000), (2, 40)):
        got = sorted(tuple(r) for r in C.collocations(frame, least, best, range_bytes, shard_nodes).collect())
        assert got == plain_collocations(rows, least, best) and got


def test_collocations_of_no_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(none).count() == 0
    blank = spark.createDataFrame([("en", None), (None, " \n ")], "lang string, text string")
    assert C.collocations(blank, 1).count() == 0


def test_tries_cut_merged_and_packed_keep_all_counts():
    texts = [t for _, t in phrases(2, 60)]
    whole = C.Trie.of_texts(pa.array(texts))
    expected = plain_counts([("x", t) for t in texts])[0]["x"]
    read = lambda t: {tuple(p.decode().split(" ")): (n, lefts) for _, p, n, lefts in t.frequent(1)}
    assert {p: n for p, (n, _) in read(whole).items()} == expected
    rng = random.Random(4)
    everything = sorted(tuple(w.encode() for w in p) for p in expected)
    for _ in range(20):
        bounds = sorted({rng.choice(everything) for _ in range(rng.randrange(6))} | {tuple(rng.choice([b"a", b"of", b"the", b"zz"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(4))})
        parts: dict[int, list] = {}
        for at in range(0, 60, 20):
            for number, part in C.Trie.of_texts(pa.array(texts[at : at + 20])).cut(bounds):
                parts.setdefault(number, []).append(C.Trie.unpacked(part.packed()))
        found = {}
        for number, pieces in parts.items():
            mine = read(C.Trie.merged(pieces))
            assert not mine.keys() & found.keys()
            found |= mine
            for p in mine:
                assert bisect_range(bounds, p) == number
        assert {p: n for p, (n, _) in found.items()} == expected
        assert all(lefts == [expected[p[:k]] for k in range(1, len(p))] for p, (_, lefts) in found.items())


def bisect_range(bounds, phrase):
    words = tuple(w.encode() for w in phrase)
    return sum(b <= words for b in bounds)


def test_a_word_that_begins_most_phrases_has_many_ranges(spark):
    rng = random.Random(6)
    rows = [("en", " ".join(w for _ in range(40) for w in ("the", f"w{rng.randrange(300)}"))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    bounds = C.range_bounds(frame, 4_000)["en"]
    assert sum(b[0] == b"the" for b in bounds) > 3
    assert sorted(tuple(r) for r in C.collocations(frame, 20, 50, 4_000).collect()) == plain_collocations(rows, 20, 50)


def test_scores_beyond_64_bits(spark):
    """A count whose product with 2,000,000 passes 64 bits is divided exactly."""
    n = 3 * 10**13 + 7
    row = spark.createDataFrame([(n, n, n + 2)], "a long, l long, r long").selectExpr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) as s").first()
    assert row["s"] == 2000000 * n // (2 * n + 2)


# archives ----------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, first string, revisit int, digest string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "f", 1, "d") for p, u, h in rows], PAGES)


def plain_pages(rows):
    first = {}
    for p, _, h in rows:
        if p is not None and (h or "") not in first or p is not None and p < first[h or ""]:
            first[h or ""] = p
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = p != first.get(h or "")
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


ODD_PAGES = [
    (5, "http://a/", "<p>é</p>"),
    (3, "http://b/\r\nWARC-Type: revisit", "<p>é</p>"),
    (9, None, None),
    (8, "", ""),
    (7, "x y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (2, "u", "z" * 3_000_000),
    (2, "u", "z" * 3_000_000),
    (4, "u", "z" * 3_000_000),
    (None, "n", "only null"),
    (None, "n", "<p>é</p>"),
    (-1, "m", "".join(chr(33 + i % 90) for i in range(200_000))),
]


@pytest.mark.parametrize("archive_bytes", [1, 4_000_000, 256_000_000])
def test_archives_of_odd_pages(spark, tmp_path, archive_bytes):
    got = warc.archive_pages(pages_frame(spark, ODD_PAGES), f"file:{tmp_path}", archive_bytes)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == plain_pages(ODD_PAGES)
    uris = {r["page_id"]: r["target_uri"] for r in got.collect()}
    assert uris[3] == "http://b/%0D%0AWARC-Type:%20revisit" and uris[9] is None and uris[8] == ""
    kinds = {r["record_type"] for r in warc.read_index(spark, str(tmp_path)).collect()}
    assert kinds == {"warcinfo", "response", "revisit"}


def test_archives_by_either_join(spark, tmp_path):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(200)]
    for bound in (0, 200_000):
        folder = f"{tmp_path}/{bound}"
        archives = warc.write_archives(pages_frame(spark, rows), f"{folder}/whole", broadcast_rows=bound)
        warc.normalise(archives, f"{folder}/whole", folder)
        assert sorted((tuple(r)[:5] for r in warc.read_records(spark, folder, read_bytes=5_000).collect()), key=repr) == plain_pages(rows)


def test_no_pages(spark, tmp_path):
    assert warc.archive_pages(pages_frame(spark, []), str(tmp_path)).count() == 0


def foreign(n):
    return [warc.page_record(i, f"http://x/{i}", "body " * i, False, None) for i in range(n)]


def test_foreign_archives_are_normalised(spark, tmp_path):
    """Plain files, one stream, a member a record, members that cut records, padding, and other records."""
    records = [b"WARC/1.0\r\nwarc-type:request\r\nCONTENT-LENGTH: 2\r\n\r\nab\r\n\r\n", *foreign(300)]
    data = b"".join(records)
    forms = {"plain.warc": data, "one.warc.gz": gzip.compress(data), "each.warc.gz": b"".join(map(gzip.compress, records)), "cut.warc.gz": b"".join(gzip.compress(data[i : i + 997]) for i in range(0, len(data), 997)), "pad.warc.gz": gzip.compress(data) + b"\0" * 512}
    for name, form in forms.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(form)
    names = spark.createDataFrame([(n,) for n in forms] + [(None,)], "archive string")
    made = warc.normalise(names, str(tmp_path / "in"), str(tmp_path)).collect()
    assert [r["records"] for r in made] == [301] * 5
    for r in made:
        whole = (tmp_path / "archives" / r["archive"]).read_bytes()
        assert len(whole) == r["bytes"] and gzip.decompress(whole) == data
    index = warc.read_index(spark, str(tmp_path)).where("record_type = 'request'").collect()
    for r in index:
        piece = (tmp_path / "archives" / r["archive"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert gzip.decompress(piece) == records[0]
    pages = [tuple(r)[:2] for r in warc.read_records(spark, str(tmp_path)).collect()]
    assert sorted(pages) == sorted((i, 5 * i) for i in range(300) for _ in forms)


@pytest.mark.parametrize("end", [-1, -20, -400])
def test_a_broken_archive_is_an_error(end):
    data = b"".join(foreign(5))
    for form in (data[: end - 4], gzip.compress(data)[:end]):
        with pytest.raises(ValueError):
            for _, _, block in warc.records_of(io.BytesIO(form)):
                list(block)


def test_inflating_holds_little(monkeypatch):
    """A block far larger than what is held at once comes in chunks."""
    monkeypatch.setattr(warc, "CHUNK", 4096)
    source = io.BytesIO(gzip.compress(warc.page_record(1, "u", "y" * 5_000_000, False, None)))
    (_, fields, block), *_ = [next(warc.records_of(source))]
    sizes = [len(piece) for piece in block]
    assert sum(sizes) == int(fields["content-length"]) and max(sizes) < 100_000
