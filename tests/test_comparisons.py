"""Pages, sections and groups held against the others."""

from pyspark.sql import functions as F

from signalspark.operators import comparisons as C
from signalspark.operators import segments


def facts(spark, rows):
    items = spark.createDataFrame(rows, "page int, position int, type string, words double")
    return {(r["page"], r["position"], f["key"]): f for r in C.section_comparisons(items, "page", "position", "type", "words").collect() for f in r["facts"]}


def test_sections_tell_what_is_measured_and_what_is_judged(spark):
    got = facts(spark, [(1, 0, "hero", 10.0), (1, 1, "faq", 30.0), (2, 0, "hero", 20.0), (2, 1, "proof", None), (3, 0, "faq", 1200.0)])
    assert got[1, 0, "words"]["text"] == "10 words; the middle one of this page's 2 sections has 30, of all 4 30"
    assert (2, 1, "words") not in got and got[2, 1, "place"]["text"] == "section 2 of 2; the middle one of 3 pages has 2"
    assert got[3, 0, "same"]["text"] == "33% (1 of 3) have faq here, the 2nd of 2 types" and got[3, 0, "anywhere"]["n"] == 2
    assert got[1, 1, "slot"]["text"] == "2 types lead here, on 50% (1 of 2) each" and got[1, 0, "slot"]["text"] == "67% (2 of 3) have hero here"
    assert {f["kind"] for k, f in got.items() if k[2] in ("words", "place")} == {"measured"} and {f["kind"] for k, f in got.items() if k[2] in ("slot", "same", "anywhere")} == {"judged"}


def test_one_type_alone_has_no_rank(spark):
    assert facts(spark, [(1, 0, "hero", 1.0)])[1, 0, "same"]["text"] == "100% (1 of 1) have hero here"


def test_sequences_and_what_is_missing(spark):
    strips = spark.createDataFrame([(1, "a > b", 2, 5.0), (2, "a > b", 2, 7.0), (3, "c", 1, 7.0)], "page int, sequence string, sections int, words double")
    got = {r["page"]: (r["same"], r["text"]) for r in C.sequence_comparisons(strips, "page").collect()}
    assert got == {1: (2, "67% (2 of 3) run this sequence"), 2: (2, "67% (2 of 3) run this sequence"), 3: (1, "no other page runs this sequence")}
    ranks = {(r["page"], r["key"]): (r["place"], r["ties"], r["text"]) for r in C.page_comparisons(strips, "page").collect()}
    assert ranks[2, "words"] == (1, 1, "7, the 1st of 3, with 1 others") and ranks[3, "sections"] == (3, 0, "1, the 3rd of 3")
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "page int, type string")
    assert {(r["page"], r["type"]): (r["carried"], r["n"]) for r in C.carried_and_missing(items, "page", "type", ["a", "b", "c"]).collect()} == {(1, "a"): (True, 2), (1, "b"): (True, 1), (1, "c"): (False, 0), (2, "a"): (True, 2), (2, "b"): (False, 1), (2, "c"): (False, 0)}


def test_cuts_are_led_or_withheld(spark):
    """One cut with too few groups, one with too small a gap, and two that hold."""
    rows = [(f"g{g}", g < 5, g % 9 == 0 and i == 0, i < g, None if g else i > 0) for g in range(9) for i in range(8)]
    frame = spark.createDataFrame(rows, "segment string, ai boolean, flat boolean, wide boolean, rare boolean")
    cells = segments.cells(frame, "segment", {c: F.col(c) for c in ("ai", "flat", "wide", "rare")})
    got = {r["cut"]: (r["role"], r["text"]) for r in C.segment_view(cells, segments.fragility(cells), "wide").collect()}
    assert got["wide"][0] == "lead" and got["ai"][0] == "rest" and got["flat"] == ("withheld", "the best and the worst group are 1 answers apart")
    assert got["rare"][0] == "withheld" and got["rare"][1].startswith("only 1 of 9 groups have enough answers")
    other = {r["cut"]: r["role"] for r in C.segment_view(cells, segments.fragility(cells), "flat").collect()}
    assert other["ai"] == "lead"  # the first by name where the wished one is withheld


def test_names_of_those_that_say_yes(spark):
    rows = spark.createDataFrame([("a", True, f"n{i:02d}") for i in range(12)] + [("a", False, "no"), ("a", None, "?"), (None, True, "x"), ("b", True, "Ä")], "g string, yes boolean, name string")
    got = {r["group"]: (r["yes"], r["names"]) for r in C.yes_names(rows, "g", F.col("yes"), "name", 3).collect()}
    assert got == {"a": (12, "n00, n01, n02"), "b": (1, "Ä")}


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "g string, n long")
    assert C.composition_headline(none, "g", "n").first()["text"] == "0 groups of 0 companies; the largest is none with 0"
    runs = spark.createDataFrame([], "ms double, bytes long, found int, expected int, ok boolean")
    assert C.probe_summary(runs, F.col("ok"), "ms", "bytes", "found", "expected").first()["text"] == "0 of 0 pages read; signals no readable page"
