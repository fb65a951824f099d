import random

from pyspark.sql import functions as F

from signalspark.functions import markup, text
from signalspark.functions.vocabulary import ENTITIES

CASES = {
    "a &amp; b": "a & b", "&amp;lt;": "&lt;", "&AMP;&Lt;": "&<", "&unknown; &Eacute;": "&unknown; &Eacute;", "&amp": "&amp", "&;": "&;", "&": "&", "": "",
    "&#65;&#x42;&#x1F600;": "AB\U0001f600", "&#X41;": "&#X41;", "&#ff;": "&#ff;", "&#1f;": "\x01", "&#0000000065;": "A", "&#x110000;": "&#x110000;",
    "&#99999999999999999999;": "&#99999999999999999999;", "&#xfffffffffffffffffff;": "&#xfffffffffffffffffff;", "&#xD800;": "�", "a&shy;b&zwnj;c": "abc", "x&&gt;&": "x&>&",
}


def test_entities_are_decoded_once(spark):
    rows = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "s string").select("s", text.decode_entities(F.col("s")).alias("d")).collect()
    assert {r["s"]: r["d"] for r in rows} == CASES | {None: None}
    assert {k: markup.decoded(k) for k in CASES} == CASES


def test_both_forms_are_the_same(spark):
    rng = random.Random(3)
    bits = ["&", ";", "#", "x", "X", "a", "1", "65", "D8", " ", "00", "é", *(f"&{k};" for k in ENTITIES), "&#8217;", "&#x2019;", "&nope;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.decode_entities(F.col("s")).alias("d")).collect()
    assert all(r["d"] == markup.decoded(r["s"]) for r in rows)


def test_text_decodes_all_names(spark):
    got = spark.createDataFrame([("<p>1 &pound; &lt;b&gt;</p>&hellip;<script>&amp;</script>&#39;x&#39;",)], "s string").select(text.plain_text(F.col("s"))).first()[0]
    assert got == "1 £ <b> … 'x'"
