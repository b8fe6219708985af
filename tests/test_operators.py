import random
import statistics
from collections import Counter, defaultdict

from carequeue.operators.joins import COPIES, keep_left, null_unknown
from carequeue.operators.scores import of_max, of_max_or_zero, with_maxima
from carequeue.operators.settle import settled
from carequeue.operators.summary import distinct_flags, summarise

SCHEMA = "k string, k2 int, lag int, lag2 int, id long, other string, flag int"


def sample(rows=600, seed=3):
    """A third of the rows share one group, one id repeats often, and every column has nulls."""
    rng = random.Random(seed)
    found = []
    for i in range(rows):
        hot = i % 3 == 0
        found.append((
            "hot" if hot else rng.choice(["a", "b", None]),
            1 if hot else rng.choice([1, 2, None]),
            rng.choice([None, *range(-5, 20)]),
            rng.choice([None, *range(3)]),
            7 if rng.random() < 0.3 else rng.choice([None, *range(40)]),
            rng.choice([None, "x", "y", "z"]),
            rng.choice([0, 1]),
        ))
    return found


def brute_force(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0], row[1]].append(row)

    def middle(values):
        present = [v for v in values if v is not None]
        return float(statistics.median(present)) if present else None

    return {
        key: (len(g), sum(r[6] for r in g), middle(r[2] for r in g), middle(r[3] for r in g),
              len({r[4] for r in g if r[4] is not None}), len({r[5] for r in g if r[5] is not None}),
              len({r[4] for r in g if r[4] is not None and r[6] == 1}))
        for key, g in groups.items()
    }


def test_summarise_against_brute_force(spark):
    rows = sample()
    found = summarise(
        spark.createDataFrame(rows, SCHEMA).repartition(5),
        ["k", "k2"],
        counts={"n": "1", "flags": "flag"},
        medians={"m1": "lag", "m2": "lag2"},
        distinct={"ids": "id", "others": "other"},
        distinct_where={"flagged_ids": ("ids", "flag = 1")},
    )
    mine = {(r.k, r.k2): (r.n, r.flags, r.m1, r.m2, r.ids, r.others, r.flagged_ids) for r in found.collect()}
    assert mine == brute_force(rows)


def test_summarise_parts_alone(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA)
    expected = brute_force(rows)
    pick = {"n": 0, "m1": 2, "ids": 4}
    for name, options in {"n": {}, "m1": {"medians": {"m1": "lag"}}, "ids": {"distinct": {"ids": "id"}}}.items():
        found = summarise(frame, ["k", "k2"], counts={"n": "1"}, **options).collect()
        assert {(r.k, r.k2): r[name] for r in found} == {key: value[pick[name]] for key, value in expected.items()}


def test_summarise_whole_and_empty(spark):
    frame = spark.createDataFrame(sample(), SCHEMA)
    ask = {"counts": {"n": "1"}, "medians": {"m": "lag"}, "distinct": {"ids": "id"},
           "distinct_where": {"some": ("ids", "flag = 1")}}
    whole = summarise(frame, [], **ask).collect()
    assert len(whole) == 1 and whole[0].n == 600
    assert summarise(frame.where("false"), [], **ask).first().asDict() == {"m": None, "ids": 0, "some": 0, "n": 0}
    assert summarise(frame.where("false"), ["k"], **ask).count() == 0


def test_distinct_flags(spark):
    frame = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "id int, f int")
    assert distinct_flags(frame, "id", {"hit": "f"}).first().asDict() == {"id": 2, "hit": 1}


def test_keep_left_is_a_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (None, "e")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (3, 12), (None, 13), (9, 14), (1, None), (1, None)], "k int, y int")
    plain = left.join(right, "k", "left").select("k", "x", "y").collect()
    mine = keep_left(left, right, "k").select("k", "x", "y", COPIES).collect()
    assert len(mine) == len(set(mine)) == len(set(plain))
    assert {tuple(r)[:3]: r[COPIES] for r in mine} == Counter(map(tuple, plain))


def test_summaries_of_folded_rows_are_those_of_all_rows(spark):
    left = spark.range(40).selectExpr("id AS k", "id % 3 AS g")
    right = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 31 END AS k", "id % 4 AS lag", "id % 2 AS f")
    measures = {"counts": {"n": "1", "f": "coalesce(f, 0)"}, "medians": {"m": "lag"}, "distinct": {"d": "k"}}
    plain = summarise(left.join(right, "k", "left"), ["g"], **measures).collect()
    folded = summarise(keep_left(left, right, "k"), ["g"], weight=COPIES, **measures).collect()
    assert sorted(folded) == sorted(plain)
    alone = summarise(keep_left(left, right, "k"), ["g"], counts=measures["counts"], weight=COPIES).collect()
    assert sorted((r.g, r.n, r.f) for r in alone) == sorted((r.g, r.n, r.f) for r in plain)


def test_null_unknown(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    known = spark.createDataFrame([("a",)], "k string")
    assert sorted(r.k or "-" for r in null_unknown(rows, known, "k").collect()) == ["-", "-", "a"]


def test_shares_of_the_maximum(spark):
    frame = settled(spark.createDataFrame([(1.0, 0, None), (4.0, 0, None)], "a double, b int, c double"))
    found = with_maxima(frame).selectExpr(
        *[f"{of_max(c)} AS {c}" for c in "abc"], *[f"{of_max_or_zero(c)} AS {c}0" for c in "abc"]
    )
    assert sorted(map(tuple, found.collect())) == [
        (0.25, None, None, 0.25, 0.0, 0.0),
        (1.0, None, None, 1.0, 0.0, 0.0),
    ]


def test_settled_frames_keep_their_rows_and_lose_their_plan(spark):
    frame = settled(spark.range(10).selectExpr("id * 2 AS x"))
    assert frame.agg({"x": "sum"}).first()[0] == 90
    plan = frame._jdf.queryExecution().toString()
    assert "Range" not in plan and spark.sparkContext.getCheckpointDir()
