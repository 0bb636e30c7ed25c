import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import queries, world_queries
from tessera.functions import kernels
from tessera.operators import blocking, decide, grid, matcher
from tessera.plans import linkage
from tessera.sources.tables import table as _table

DATA = "/root/testdata/sf0.001"
CHANNELS = {"name": "name", "addr": "addr"}
NAMES = [
    "block_union",
    "blocking_report",
    "candidate_lists",
    "df_cap_sweep",
    "gbt_scores",
    "group_relative_features",
    "jaro_winkler",
    "label_pairs",
    "string_scores",
    "token_jaccard",
    "world_cap_sweep",
    "world_ranking_variants",
    "world_candidates",
    "world_f05",
    "world_error_examples",
    "world_gram_blocker",
    "world_flags",
    "world_leave_one_out",
    "world_matching_results",
    "world_output_checks",
    "world_prediction_profile",
    "world_switch_gate",
    "world_threshold_variants",
    "world_threshold_profile",
]


@pytest.mark.parametrize("name", NAMES)
def test_hits_are_no_rows(spark, monkeypatch, name):
    """No query makes a row for each token that a query and a pool record share."""
    monkeypatch.setattr(blocking, "hits", lambda *a: pytest.fail("a row for each hit"))
    monkeypatch.setattr(world_queries, "_stored", {})
    entry.queries()[name](spark, DATA).count()


def _records(spark, word=str):
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{int(rng.paretovariate(0.5)) % 60}" for _ in range(n))
    rows = [(word(i), rng.choice(["US", "US", "France", None]), i % 3 == 0, some(rng.randrange(4)), some(rng.randrange(9))) for i in range(600)]
    return spark.createDataFrame([*rows, *[(word(1000 + i), "US", i == 0, "same words", "") for i in range(80)]], f"id {'string' if word is str else 'int'}, country string, is_query boolean, name string, addr string")


def _rows(df):
    ints, reals = ("rank", "in_name"), ("blk", "ncos", "acos")
    return sorted(df.select("country", "q", "c", *ints, *[F.round(x, 6).alias(x) for x in reals]).collect())


@pytest.mark.parametrize("block", [40, 6_000_000])
@pytest.mark.parametrize("norm", ["candidate", "full", "none"])
def test_blocks_equal_the_join(spark, monkeypatch, block, norm):
    """Blocks of any size give what the relational join gives, ties of many equal records included."""
    monkeypatch.setattr(grid, "BLOCK", block)
    p, rec = blocking.Blocking(df_frac=0.2, norm=norm, k_main=12, k_name=4), _records(spark).localCheckpoint()
    want = blocking.candidates(blocking.scores(blocking.index(rec, CHANNELS, p), p), p)
    got = grid.found(grid.best(grid.pack(rec, CHANNELS, p), p, (grid.Variant(0, norm),)), p)
    assert _rows(got) == _rows(want) and got.count() > 500


def test_meet(spark):
    """Pairs meet the records of both sides; pairs without one go, as in an inner join."""
    rec = _records(spark, int).select("id", "name")
    pairs = rec.select((F.col("id") % 7).alias("q"), F.col("id").alias("c"), (F.col("id") * 2).alias("z")).unionByName(spark.createDataFrame([(1, 5000, 0)], "q int, c int, z int"))
    got = grid.meet(pairs, rec.where("id < 6"), rec).select("q", "c", "z", "a.name", F.col("b.name").alias("n2"))
    want = pairs.join(rec.where("id < 6").toDF("q", "name"), "q").join(rec.toDF("c", "n2"), "c").select("q", "c", "z", "name", "n2")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 400


@pytest.mark.parametrize("twice", [False, True])
def test_scores_of_pairs_met(spark, monkeypatch, twice):
    monkeypatch.setattr(grid, "MET", 2)
    names = [(k, "ab" * (k % 4) + "cd" * (k % 3)) for k in range(12)] + [(3, "other")] * twice
    rec = spark.createDataFrame(names, "id int, name string").where("name <> ''")
    pairs = spark.createDataFrame([(q, c, q * c) for q in range(6) for c in range(14)], "q int, c int, z int")
    score = grid.Score(lambda rows: kernels.Letters(rows.field("name").to_pylist()), kernels.jaro_winklers, "jw")
    got = grid.meet(pairs, rec.where("id < 6"), rec, score)
    assert got.columns == ["q", "c", "z", "jw"]
    want = [(q, c, q * c, kernels.jaro_winkler(x, y)) for q, x in names for c, y in names if q < 6 and x and y]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_only_records_met_are_ranked():
    """A query with many hits gives back the records it meets, not the whole pool."""
    batch = pa.RecordBatch.from_pylist([{"id": k, "n": 40, "t": [1, 2] if k < 6 else [3], "d": [6, 6] if k < 6 else [34], "m": [65, 1] if k < 6 else [1]} for k in range(40)])
    batch = batch.set_column(4, "m", batch.column("m").cast(pa.list_(pa.int8())))
    idx, n, a = grid._Block([batch], [grid.Variant()]).meets(np.array([0, 1]), np.array([2.0, 3.0]), np.array([True, False]))
    assert idx.tolist() == [*range(6)] and n.tolist() == [2.0] * 6 and a.tolist() == [3.0] * 6


def test_names_are_scored_where_they_meet(spark):
    """Texts are not sent to Python and back once more for each pair."""
    plan = entry.queries()["jaro_winkler"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "jaro_winkler_similarity" not in plan and "MapInArrow" in plan


def _exchanged(df):
    """Columns of the exchanges of a plan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_labels_of_large_groups_of_copies(spark):
    """Groups of equal texts are not listed as pairs: 2,000 x 2,000 of them label 3 candidates (F8)."""
    marked = spark.range(4000).select("id", F.lit("x").alias("country"), (F.col("id") % 2 == 0).alias("is_query"), F.lit("h").alias("h"))
    other = spark.createDataFrame([(5000, "x", True, "a"), (5001, "x", False, "b"), (5003, "y", False, "h"), (5004, "x", True, None), (5005, "x", False, None)], "id long, country string, is_query boolean, h string")
    lists = spark.createDataFrame([(0, [1, 5001, 5003]), (5000, [1, 5001]), (5004, [5005])], "q long, c array<long>")
    got = queries.labelled(lists, marked.union(other))
    assert {tuple(r) for r in got.collect()} == {(0, 1, 1), (0, 5001, 0), (0, 5003, 0), (5000, 1, 0), (5000, 5001, 0), (5004, 5005, 0)}
    assert got.count() == 6


def test_pairs_are_judged_where_they_are_found(spark, monkeypatch):
    """Scored pairs are the same from single blocks, where no candidate is shuffled, and from many (F15, F18, F19, F21 to F24)."""
    world_queries._stored.clear()
    one = world_queries._rated(spark, DATA)
    assert "q_idx" not in " ".join(_exchanged(one)) and "rank" not in " ".join(_exchanged(one))
    kept = {tuple(r) for r in world_queries._scored(spark, DATA).collect()}
    monkeypatch.setattr(grid, "BLOCK", 300)
    world_queries._stored.clear()
    monkeypatch.setattr(grid, "judged", None)
    many = {tuple(r) for r in world_queries._scored(spark, DATA).collect()}
    world_queries._stored.clear()
    assert kept and kept == many
    assert any(r[-1] == 1 for r in kept) and any(r[-2] < world_queries.FLOOR for r in kept)


def test_whole_pools_are_searched_without_an_index_table(spark, monkeypatch):
    """The words of whole pools go to their tasks, without tables of postings or records by word (F15, F18, F21 to F24)."""
    made = []
    monkeypatch.setattr(grid, "table", lambda df, name, *a, **b: made.append(name) or _table(df, name, *a, **b))
    monkeypatch.setattr(world_queries, "_stored", {})
    world_queries._rated(spark, DATA)
    assert made == ["counts", "heavy", "over"]


@pytest.mark.parametrize("frac, least", [(0.2, 5), (0.0001, 0)])
def test_worded_equals_the_join(spark, frac, least):
    """Frequencies counted in the task give the candidates of the relational join, also where the cap drops every word."""
    p, rec = blocking.Blocking(df_frac=frac, min_cap=least, k_main=12, k_name=4), _records(spark).localCheckpoint()
    want = blocking.candidates(blocking.scores(blocking.index(rec, CHANNELS, p), p), p).select("country", "q", "c", "rank")
    packed = grid.worded(rec.withColumn("x", F.struct("id")), CHANNELS, p)
    every = lambda a, of, c, b, rank: (np.arange(len(of)), {"rank": pa.array(rank.astype(np.int32))})
    got = grid.judged(packed, p, every, "rank int").select("country", "q", "c", "rank")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20


def test_letters_bound_the_similarity():
    """No pair is passed over that Jaro-Winkler would rate higher than its letters allow."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé 1" if rng.random() < 0.02 else "abc 1") for _ in range(rng.randrange(9)))
    for letters in range(40):
        x, y = [word() for _ in range(20)], [word() for _ in range(300)]
        if letters < 20:
            x, y = ([w.replace("é", "e") for w in z] for z in (x, y))
        of = np.array([rng.randrange(20) for _ in y])
        most = world_queries._jw_most(pa.array(x), of, pa.array(y))
        assert all(kernels.jaro_winkler(x[i], t) <= m + 1e-12 for i, t, m in zip(of, y, most, strict=True) if x[i] and t)
        assert letters >= 20 or (most < 0.9).any()


def test_trials_equal_their_decisions(spark):
    """Runs ranked together score each entity as runs decided one by one, with two rankings by query for all of them (F22)."""
    rng = random.Random(11)
    rows = [(f"q{rng.randrange(30)}", f"c{c}", rng.randrange(9), c % 7, rng.choice([0.5, 0.6, 0.7, 0.75, 0.8, 0.9]), rng.randrange(2)) for c in range(120) for _ in range(3)]
    pairs = spark.createDataFrame(rows, "q string, c string, q_idx int, c_idx int, p double, y int").dropDuplicates(["q", "c"]).dropDuplicates(["c", "p", "q_idx"]).dropDuplicates(["q", "p", "c_idx"]).localCheckpoint()
    ent = spark.createDataFrame([(f"q{k}", "US", k % 4) for k in range(35)], "q string, country string, tsize long")
    runs = {"base": {}} | world_queries._TRIALS
    got = decide.trials(pairs, ent, runs, "q_idx", "c_idx")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3
    for name, how in runs.items():
        want = decide.entity_scores(decide.decide(pairs, **({"threshold": 0.75} | how), q_order="q_idx", c_order="c_idx"), ent)
        assert sorted(got.select("q", F.col(f"f05_{name}")).collect()) == sorted(want.select("q", "f05").collect())


def test_profile_decides_once(spark, monkeypatch):
    """The predictions that are counted and those whose sources are counted are of one decision (F21)."""
    made, once = [], decide.decide
    monkeypatch.setattr(decide, "decide", lambda *a, **b: made.append(1) or once(*a, **b))
    monkeypatch.setattr(world_queries, "_stored", {})
    entry.queries()["world_prediction_profile"](spark, DATA).count()
    assert len(made) == 1


def test_variants_decide_once(spark):
    """Match lists of several thresholds come of one decision, ties by input position (F23, F24)."""
    pairs = spark.createDataFrame([("q1", "c1", 2, 0, 0.9), ("q2", "c1", 1, 0, 0.9), ("q2", "c2", 1, 5, 0.8), ("q2", "c3", 1, 4, 0.8)], "q string, c string, q_idx int, c_idx int, p double")
    got = linkage.variants(pairs, spark.createDataFrame([("q1",), ("q2",)], "q string"), [0.8, 0.85], 2, "q_idx", "c_idx")
    assert {tuple(r) for r in got.collect()} == {(0.8, "q1", ""), (0.85, "q1", ""), (0.8, "q2", "c1,c3"), (0.85, "q2", "c1")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2


def test_leave_one_out_decides_once(spark, monkeypatch):
    """All countries are counted from one decision, with ties by input position and not by the spelling of ids (F18)."""
    made, once = [], decide._ranked
    monkeypatch.setattr(decide, "_ranked", lambda *a, **b: made.append(1) or once(*a, **b))
    monkeypatch.setattr(world_queries, "_stored", {})
    got = entry.queries()["world_leave_one_out"](spark, DATA).collect()
    assert len(made) == 1 and len(got) > 1
    rows = [("US", "S1-9", "c", 9, 1, 0.8, 1), ("US", "S1-10", "c", 10, 1, 0.8, 0), ("France", "S1-2", "d", 2, 2, 0.9, 1)]
    pairs = spark.createDataFrame(rows, "country string, q string, c string, q_idx long, c_idx long, p double, y int")
    asked = [("S1-9", "US", 9, ["c"]), ("S1-10", "US", 10, None), ("S1-2", "France", 2, ["d"])]
    monkeypatch.setattr(world_queries, "_scored", lambda *a: pairs)
    monkeypatch.setattr(world_queries, "_asked", lambda *a: spark.createDataFrame(asked, "id string, country string, row_idx long, true array<string>"))
    monkeypatch.setattr(world_queries, "_entities", lambda *a: spark.createDataFrame([("S1-9", "US", 1), ("S1-10", "US", 0), ("S1-2", "France", 1)], "q string, country string, tsize long"))
    assert sorted(entry.queries()["world_leave_one_out"](spark, DATA).collect()) == [("France", 0.5, 1.0, 1.0), ("US", 0.5, 1.0, 1.0)]


def test_leave_one_out_equals_each_country(spark):
    """One decision for all gives what each country and all others, decided by themselves, give (F18)."""
    rng = random.Random(7)
    place = lambda k: (None, "US", "India", "France")[k % 4]
    rows = {(q, c): (place(q), q, c, rng.randrange(30, 100) / 100, rng.randrange(2)) for q in range(60) for c in rng.sample(range(q % 4, 100, 4), 9)}
    pairs = spark.createDataFrame([*rows.values()], "country string, q long, c long, p double, y int").localCheckpoint()
    ent = spark.createDataFrame([*[(q, place(q), q % 5) for q in range(70)], (70, "Atlantis", 0)], "q long, country string, tsize long").localCheckpoint()
    steps, best = [0.5, 0.6, 0.7, 0.8, 0.9], lambda country: decide.tuned(decide.threshold_grid(pairs.where(country), ent.where(country), steps), "f05").first()
    want = []
    for label in ("France", "India", "US"):
        here = F.col("country") == label
        thr, own = best(~here)["thr"], best(here)["f05"]
        scored = decide.entity_scores(decide.decide(pairs.where(here), thr), ent.where(here))
        want.append((label, thr, scored.agg(F.round(F.avg("f05"), 6)).first()[0], own))
    assert sorted(matcher.leave_one_out(pairs, ent, [], steps).collect()) == want
    assert sorted(matcher.leave_one_out(pairs, ent, [], steps, scorer=lambda known, asked: asked).collect()) == want
    assert len({thr for _, thr, _, _ in want}) > 1 or any(f < own for _, _, f, own in want)
