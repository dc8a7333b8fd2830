from wardline.operators import joins
from wardline.operators.joins import is_small, lookup_join


def test_split_join_equals_plain_join_with_hot_keys(spark):
    # key 7 owns a third of the facts, many of them equal copies
    facts = spark.createDataFrame(
        [(i % 40, i) for i in range(2000)] + [(7, 1)] * 1000 + [(None, 5)], "k long, v long"
    ).repartition(6)
    lookup = spark.createDataFrame([(k, k * 10 + c) for k in range(45) for c in range(2)], "k long, w long")
    plain = sorted(map(tuple, facts.join(lookup, "k").select("k", "v", "w").collect()))
    for hot_rows in (10, 100, 10_000):
        split = lookup_join(facts, lookup, "k", small=False, hot_rows=hot_rows)
        assert sorted(map(tuple, split.select("k", "v", "w").collect())) == plain
    small = lookup_join(facts, lookup, "k", small=True)
    assert sorted(map(tuple, small.select("k", "v", "w").collect())) == plain


def test_size_check(spark):
    df = spark.range(100)
    assert is_small(df, 100)
    assert not is_small(df, 99)


def test_a_long_list_of_hot_keys_raises_the_limit(spark, monkeypatch):
    facts = spark.createDataFrame([(i % 50, i) for i in range(1000)] + [(3, 0)] * 500, "k long, v long")
    lookup = spark.createDataFrame([(k, -k) for k in range(60)], "k long, w long")
    plain = sorted(map(tuple, facts.join(lookup, "k").select("k", "v", "w").collect()))
    monkeypatch.setattr(joins.is_small, "__defaults__", (5,))
    split = joins.split_join(facts, lookup, "k", hot_rows=10)
    assert sorted(map(tuple, split.select("k", "v", "w").collect())) == plain
