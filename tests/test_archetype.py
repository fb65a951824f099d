from signalspark.operators import structure


def bands(spark, pages):
    rows = [(k, f"n{k:02d}", i, t, 10 * i) for k, types in enumerate(pages) for i, t in enumerate(types)]
    items = spark.createDataFrame(rows, "page int, name string, i int, type string, words int")
    found = structure.archetype_bands(items, "page", "name", "i", "type", "words", ["hero", "proof", "price", "rare", "never", "other"], most=3)
    return {r["type"]: r.asDict() for r in found.collect()}


def test_the_pinned_type_is_first_and_breakers_are_the_fewer(spark):
    pages = [["proof", "other", "proof"]] * 6 + [["price", "proof"]] * 3 + [["other"]] * 4 + [["proof", "hero", "rare"]]
    found = bands(spark, pages)
    assert set(found) == {"hero", "proof", "price", "rare"}
    assert (found["hero"]["place"], found["proof"]["place"], found["price"]["place"], found["rare"]["place"]) == (1, 2, 3, None)
    assert (found["proof"]["carriers"], found["proof"]["absent"], found["proof"]["breakers"], found["proof"]["omitted"]) == (10, 4, "n09, n10, n11", 1)
    assert (found["price"]["carriers"], found["price"]["share"], found["price"]["breakers"], found["price"]["omitted"]) == (3, 0.214, "n06, n07, n08", 0)
    assert found["hero"]["share"] == 0.071 and found["hero"]["breakers"] == "n13"


def test_no_pages_give_no_bands(spark):
    assert structure.archetype_bands(spark.createDataFrame([], "page int, name string, i int, type string, words int"), "page", "name", "i", "type", "words", ["hero", "other"]).count() == 0
