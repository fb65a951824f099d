import random

import pytest

SCHEMA = "doc_id long, text string, part string, score string, version string, fp string, tier int, n_lines string"
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def odd_rows():
    """Nulls, blanks, ties, repeated rows, a very long text, and columns with clashing names."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    texts = [None, "", " \n\t ", "word", "Word", LINE, LINE + "\n" + LINE, base, base, base.replace("w1 ", "x1 ", 1), text(30_000), "\n".join([text(20), LINE, "of", "of", text(9)]), "É ß   \U0001f600 á \xa0", text(60) + " " + base]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[7], (None, base), (None, None), (40, base), (41, LINE)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(d, t, "p", None, "v", "f", 3, None) for d, t in odd_rows()], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def same(spark, sf):
    """Whether a query and its SQL give the same rows on the smallest tables."""
    import duckdb

    def compare(query, sql):
        ours = query(spark, sf).toPandas()
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        theirs = db.execute(sql).df()
        columns = sorted(theirs.columns)
        rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
        return rows(ours) == rows(theirs)

    return compare
