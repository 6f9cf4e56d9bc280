import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sp(spark):
    """The test session, with the package shipped to its Python workers."""
    from claimlens.session import ship_package

    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents(sp):
    return sp.read.parquet(f"{SMALL}/documents.parquet")


#: odd rows: nulls, empty, white space, repeats, ties, other scripts, a very long text
def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    passage = " ".join(f"passage{i}" for i in range(60))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "one two"), (7, passage), (8, "before " + passage + " after"),
        (9, passage), (9, passage), (10, None), (None, passage), (None, None), (11, long), (12, long + " end"), (13, "naïve ▁ café  日本語 \x00 😀"),
        (14, "a" * 3000), (15, "ab " * 500), (16, "<|endoftext|> x</s>"), (17, passage.upper()),
    ]


@pytest.fixture(scope="session")
def odd(sp):
    """The odd rows among columns whose names operators use inside."""
    rows = [(i, t, -1, "x", 0, 1.0, "z", 7, "q", 2) for i, t in odd_rows()]
    df = sp.createDataFrame(rows, "doc_id long, text string, d long, t string, chunk int, score double, h string, n long, f string, bucket int")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(sp):
    return sp.createDataFrame([], "doc_id long, text string, d long")
