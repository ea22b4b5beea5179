import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.contracts import ColumnSpec, GateError, Profile
from tallyframe.functions import expressions as X
from tallyframe.operators import audit, boosted, distance, estimators, fidelity, generate, preprocess, rules, stats, tuning, utility
from tallyframe.plans import bundle, evaluate, evaluations, reports  # noqa: F401  register their queries
from tallyframe.plans.registry import QUERIES, SQL

RULES = {
    "number": [{"type": "not_null"}, {"type": "finite"}, {"type": "integer"}, {"type": "bounds", "min": 0, "max": 10}],
    "code": [{"type": "not_null"}, {"type": "regex", "pattern": "^[A-Z]+$"}, {"type": "length", "min": 2, "max": 2}],
    "event_date": [{"type": "not_null"}, {"type": "datetime_range", "min": "2020-01-01", "max": "2020-12-31"}],
    "unique_id": [{"type": "not_null"}, {"type": "unique"}],
    "category": [{"type": "not_null"}, {"type": "allowed_values", "values": ["x", "y"]}],
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1.0, "AA", "2020-06-01", "a", "x"), (2.5, "a", "2019-12-31", "a", "z"), (11.0, "AAA", "2021-01-01", "b", "y"), (4.0, "BB", "2020-06-01", "c", "x")]
    return spark.createDataFrame(rows, "number double, code string, event_date string, unique_id string, category string").withColumn("event_date", F.to_timestamp("event_date"))


def test_rule_families(golden):
    rows = rules.validity(golden, RULES, {})
    score = {r.scope_id: r.score for r in rows.collect()}
    assert score == {"number": 0.5, "code": 0.5, "event_date": 0.5, "unique_id": 0.5, "category": 0.75, "fully_valid_rows": 0.25}
    totals = rules.validity_scores(rows).first()
    assert math.isclose(totals.column_score, 0.55) and totals.constraint_score is None and math.isclose(totals.validity, 0.55)


def test_missing_passes_all_rules_but_not_null(spark):
    df = spark.createDataFrame([(None, None)], "a double, b string")
    out = df.select(rules.column_rule("a", {"type": "not_null"}).alias("n"), rules.column_rule("a", {"type": "bounds", "min": 1}).alias("m"), rules.column_rule("b", {"type": "regex", "pattern": "x"}).alias("r")).first()
    assert tuple(out) == (False, True, True)


def test_fullmatch_refuses_a_trailing_line_break(spark):
    df = spark.createDataFrame([("AA",), ("AA\n",)], "c string")
    assert [r[0] for r in df.select(X.python_fullmatch(F.col("c"), "^[A-Z]+$")).collect()] == [True, False]


def test_no_applicable_rows_is_undefined(golden):
    rule = {"type": "comparison", "left": "number", "right": "number", "op": "ge", "applies": {"type": "column_equals", "column": "category", "value": "absent"}}
    row = rules.validity(golden, {"number": [{"type": "not_null"}]}, {"k": rule}).where("scope_id = 'k'").first()
    assert row.n_total == 0 and row.score is None and row.weight == 0


def test_permutation_scores_one_and_contributions_add_up(spark):
    base = spark.createDataFrame([(float(i), "abc"[i % 3]) for i in range(24)], "x double, g string")
    both = fidelity.union_arms(base, base.orderBy(F.desc("x")))
    rows = fidelity.column_shapes(both, ["x"], ["g"]).collect()
    assert all(r.score == 1 for r in rows) and math.isclose(sum(r.contribution for r in rows), 1.0, abs_tol=1e-12)
    assert fidelity.correlation_similarity(both.withColumn("y", F.lit(1.0)), ["x", "y"]).first().score is None


def test_retention_and_ratio(spark):
    df = spark.createDataFrame([(0.35, 0.80, 0.71, True), (10.0, 4.0, 5.5, False), (0.2, 0.8, 0.92, True), (0.5, 0.5, 0.7, True)], "d double, r double, s double, up boolean")
    got = [r[0] for r in df.select(utility.local_retention(F.col("d"), F.col("r"), F.col("s"), F.col("up"))).collect()]
    assert [None if v is None else round(v, 9) for v in got] == [0.8, 0.75, 1.2, None]
    one = spark.range(1)
    assert math.isclose(one.select(utility.target_ratio(F.lit(2.0), F.lit(2.5), F.lit(False))).first()[0], 0.8)
    assert one.select(utility.target_ratio(F.lit(0.0), F.lit(0.6), F.lit(True))).first()[0] is None


def test_imputation_fits_on_train_only(spark):
    train = spark.createDataFrame([("20", "NY", 0), ("40", "CA", 1), ("?", "NY", 0)], "age string, city string, target int")
    held = spark.createDataFrame([("1000", None, 0), (None, "TX", 1)], "age string, city string, target int")
    state = preprocess.fit_imputation(preprocess.normalise_markers(train, ["age"], ["city"]), ["age"], ["city"])
    assert state.numeric == {"age": 30.0} and state.categorical == {"city": "NY"}
    out = preprocess.impute(preprocess.normalise_markers(held, ["age"], ["city"]), state, indicators=True).collect()
    assert [(r.age, r.city, r.age__missing) for r in out] == [(1000.0, "NY", 0), (30.0, "TX", 1)]


def test_mode_tie_takes_the_least(spark):
    assert preprocess.fit_imputation(spark.createDataFrame([("z",), ("a",)], "c string"), [], ["c"]).categorical == {"c": "a"}


@pytest.mark.parametrize("rows, kind, code", [([("17.5",)], "integer", "type_mismatch"), ([("inf",)], "continuous", "nonfinite_values"), ([(None,)], "integer", "missing_values_prohibited"), ([("9223372036854775808",)], "integer", "type_mismatch"), ([("yes",)], "boolean", "type_mismatch")])
def test_gate_reasons(spark, rows, kind, code):
    with pytest.raises(GateError) as found:
        audit.gate(spark.createDataFrame(rows, "c string"), Profile("d", (ColumnSpec("c", kind),)))
    assert found.value.reason_code == code


def test_gate_keeps_large_integers_and_checks_shape(spark):
    p = Profile("d", (ColumnSpec("c", "integer"),))
    assert audit.gate(spark.createDataFrame([(str(2**53 + 1),)], "c string"), p).first()[0] == 2**53 + 1
    for df, rows, code in ((spark.createDataFrame([("1", "2")], "c string, x string"), None, "schema_mismatch"), (spark.createDataFrame([("1",)], "c string"), 2, "row_count_mismatch")):
        with pytest.raises(GateError) as found:
            audit.gate(df, p, rows)
        assert found.value.reason_code == code


def test_nearest_against_numpy_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((40, 2)), rng.random((30, 2))
    frame = lambda m: spark.createDataFrame(pd.DataFrame({"k": range(len(m)), "x": m[:, 0], "y": m[:, 1], "g": ["pq"[i % 2] for i in range(len(m))]}))
    got = {r.k: r.distances for r in distance.nearest(frame(a), frame(b), "k", ["x", "y"], ["g"], neighbours=2, block=7).collect()}
    spread = b.max(0) - b.min(0)
    d = (np.abs(a[:, None] - b[None]) / spread).sum(2) + 2.0 * (np.arange(40)[:, None] % 2 != np.arange(30)[None] % 2)
    assert all(np.allclose(got[i], np.sort(d[i])[:2]) for i in range(40))


def test_normal_quantile(spark):
    got = spark.createDataFrame([(0.001,), (0.5,), (0.975,)], "p double").select(X.normal_quantile(F.col("p"))).collect()
    assert np.allclose([r[0] for r in got], [-3.090232, 0.0, 1.959964], atol=1e-5)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    out = utility.ranking_scores(df, F.col("y") == 1, "s").first()
    assert math.isclose(out.roc_auc, 0.625)
    assert utility.ranking_scores(df.where("y = 1"), F.col("y") == 1, "s").first().roc_auc is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    import duckdb

    got = QUERIES[name](spark, sf)
    if name not in SQL:
        assert got.count() > 0
        return
    held = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = held.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((v is None, round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.fetchall()))


def test_snap_of_repeated_lines_matches_sql(spark, sf, tmp_path):
    """Lines that are repeated, whole or with another price, and lines without a quantity."""
    import duckdb

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").limit(50)
    odd = lines.withColumn("l_quantity", F.when(F.col("l_linenumber") > 3, F.col("l_quantity")))
    lines.union(lines).union(lines.withColumn("l_extendedprice", F.lit(1.0))).union(odd).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    held = duckdb.connect()
    held.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    key = lambda row: (row[0], row[1], str(row[2]))
    got, want = (sorted(map(key, rows)) for rows in (QUERIES["b17_snap"](spark, str(tmp_path)).collect(), held.execute(SQL["b17_snap"]).fetchall()))
    assert got == want and 50 <= len(got) < 150


def test_functional_dependency_compares_whole_tuples(spark):
    df = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 1), ("a|b", "c", 2), (None, "c", 1), ("z", "z", None), ("z", "z", 1)], "x string, y string, v long")
    rule = {"type": "functional_dependency", "columns": ["x", "y"], "dependent": "v", "mapping": {("a|b", "c"): 1}, "missing": "not_applicable"}
    applies, satisfied = rules.constraint(rule)
    assert [r[0] for r in df.select(satisfied).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in df.select(applies).collect()] == [True, True, True, False, False, True]
    listed = rule | {"mapping": [{"determinant": ["a|b", "c"], "dependent": 1}]}
    assert [r[0] for r in df.select(rules.constraint(listed)[1]).collect()] == [True, False, False, False, False, False]


def test_gate_reads_whole_numbers_exactly(spark):
    profile = Profile("p", (ColumnSpec("i", "integer"), ColumnSpec("x", "continuous")))
    df = spark.createDataFrame([("5.0", "1.5"), ("9007199254740993", "2")], "i string, x string")
    assert [tuple(r) for r in audit.gate(df, profile).collect()] == [(5, 1.5), (9007199254740993, 2.0)]
    broken = spark.createDataFrame([("5.5", "inf"), (None, None)], "i string, x string")
    with pytest.raises(GateError):
        audit.gate(broken, profile)
    kept = audit.gate(broken, profile, preserve=True).collect()
    assert kept[0].i == 5.5 and math.isinf(kept[0].x) and tuple(kept[1]) == (None, None)
    with pytest.raises(GateError, match="type_mismatch"):
        audit.gate(spark.createDataFrame([("a", "1")], "i string, x string"), profile, preserve=True)
    with pytest.raises(GateError, match="empty_table"):
        audit.gate_arms({"train": df, "synthetic": df.limit(0), "test": df}, profile)


def test_contract_is_closed(spark):
    profile = Profile("p", (ColumnSpec("a", "continuous", valid_domain={"min": 0, "max": 2}), ColumnSpec("b", "categorical", roles=("target",))))
    every = [{"selector": {"semantic_types": ["continuous", "categorical"]}, "rules": [{"type": "not_null"}]}, {"selector": {"valid_domain_keys": ["min"]}, "rules": [{"type": "bounds"}]}]
    rules.check_contract(profile, every, {})
    assert rules.column_rules(profile, every)["a"] == [{"type": "not_null"}, {"type": "bounds", "min": 0, "max": 2}]
    for bad in ([{"selector": {"roles_any": ["target"]}, "rules": [{"type": "not_null"}]}], [{"selector": {"column_ids": ["z"]}, "rules": []}], [{"selector": {"column_ids": ["a", "b"]}, "rules": [{"type": "python", "code": "1"}]}]):
        with pytest.raises(GateError, match="invalid_validity_contract"):
            rules.check_contract(profile, bad, {})
    with pytest.raises(GateError):
        rules.check_contract(profile, every, {"k": {"type": "comparison", "left": "a", "right": "nope", "op": "lt"}})


def test_contracts_that_are_refused():
    profile = Profile("p", (ColumnSpec("a", "continuous", valid_domain={"min": 0, "max": 2}), ColumnSpec("b", "categorical"), ColumnSpec("t", "datetime"), ColumnSpec("i", "integer")))
    every = {"selector": {"column_ids": ["a", "b", "t", "i"]}, "rules": [{"type": "not_null"}]}
    only = lambda column, **rule: {"selector": {"column_ids": [column]}, "rules": [rule]}
    pair = {"type": "comparison", "left": "a", "right": "i", "op": "lt"}
    evidence = {"source_type": "dataset-documentation", "reference": "page 3"}
    good = [only("a", type="bounds", min=0), only("a", type="bounds"), only("b", type="length", max=3), only("t", type="datetime_range", min="2020-01-01"), only("b", type="allowed_values", values=["x", "1"]), only("i", type="integer", rule_id="i-1", evidence=evidence, severity="hard", version="1.0.0")]
    fine = {"c": pair, "s": {"type": "sum_equals", "columns": ["a"], "total": "i"}, "f": {"type": "functional_dependency", "columns": ["b"], "dependent": "i", "mapping": [{"determinant": ["x"], "dependent": 1}]}, "w": {**pair, "applies": {"type": "column_in", "column": "b", "values": ["x"]}, "missing": "not_applicable"}}
    rules.check_contract(profile, [every, *good], fine)
    for bad in (
        only("a", type="bounds", min=3, max=1), only("i", type="bounds"), only("a", type="bounds", min=float("nan")), only("a", type="bounds", min=True), only("b", type="bounds", min=1), only("b", type="allowed_values"), only("b", type="allowed_values", values=[]),
        only("b", type="allowed_values", values=["x", "x"]), only("b", type="length"), only("b", type="length", min=-1), only("b", type="length", min=4, max=3), only("b", type="regex", pattern="("), only("b", type="regex"), only("t", type="datetime_range"), only("t", type="datetime_range", min="soon"), only("t", type="datetime_range", min="2021-01-01", max="2020-01-01"),
        only("a", type="integer"), only("a", type="finite", rule_id="No Id"), only("a", type="finite", severity="soft"), only("a", type="finite", version="2"), only("a", type="finite", evidence={"source_type": "guess", "reference": "x"}), only("a", type="finite", evidence={**evidence, "reference": " "}),
        {"selector": {"roles_any": ["target"]}, "rules": [{"type": "not_null"}]}, {"selector": {"semantic_types": ["number"]}, "rules": [{"type": "not_null"}]}, {"selector": {"nullable_model_input": "yes"}, "rules": [{"type": "not_null"}]}, {"selector": {"column_ids": ["a"]}, "rules": []}, {"selector": {}, "rules": [{"type": "not_null"}]},
    ):
        with pytest.raises(GateError, match="invalid_validity_contract"):
            rules.check_contract(profile, [every, bad], {})
    with pytest.raises(GateError, match="occurs twice"):
        rules.check_contract(profile, [every, only("a", type="finite", rule_id="x"), only("i", type="finite", rule_id="x")], {})
    for bad in (
        {**pair, "op": "xx"}, {k: v for k, v in pair.items() if k != "right"}, {**pair, "right": "b"}, {**pair, "right": "a"}, {**pair, "applies": {"type": "column_equals", "column": "nope", "value": 1}}, {**pair, "applies": {"type": "column_in", "column": "b", "values": []}}, {**pair, "applies": {"type": "sometimes"}}, {**pair, "missing": "ignored"}, {**pair, "note": 1},
        {"type": "conditional_domain", "condition": "b", "when": [], "target": "i", "then": [1]}, {"type": "mutual_exclusion", "columns": ["a", "i"], "truthy": [1], "max": 2}, {"type": "mutual_exclusion", "columns": ["a"], "truthy": [1], "max": 0}, {"type": "sum_equals", "columns": ["b"], "total": "i"}, {"type": "sum_equals", "columns": ["a"], "total": "i", "relative": -1},
        {"type": "allowed_combinations", "columns": ["a", "b"], "allowed": [(1,)]}, {"type": "allowed_combinations", "columns": ["a", "b"], "allowed": [(1, "x"), (1, "x")]}, {"type": "functional_dependency", "columns": ["b"], "dependent": "i", "mapping": []}, {"type": "functional_dependency", "columns": ["b"], "dependent": "i", "mapping": [{"determinant": ["x"], "dependent": 1}, {"determinant": ["x"], "dependent": 2}]},
    ):
        with pytest.raises(GateError, match="invalid_validity_contract"):
            rules.check_contract(profile, [every], {"k": bad})


def test_texts_of_numbers(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "7.", "1d", " 2f ", "0x1", "nan", "inf", "1_0", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(X.number(F.col("x"))).collect()]
    assert got[:5] == [1.0, 2.5, -300.0, 0.5, 7.0] and got[5:8] == [None] * 3 and math.isnan(got[8]) and got[9] == math.inf and got[10:] == [None] * 3
    role = lambda values: audit.infer_roles(spark.createDataFrame([(v,) for v in values], "x string")).first().role
    assert [role(v) for v in (["1d", "2f"], ["nan", "inf"], ["1", " 2 "], ["1.5", None], ["1", "x"])] == ["categorical", "categorical", "integer", "continuous", "categorical"]
    profile = Profile("p", (ColumnSpec("x", "continuous", nullable=True),))
    for bad, code in (("1d", "type_mismatch"), (" 2f ", "type_mismatch"), ("inf", "nonfinite_values")):
        with pytest.raises(GateError, match=code):
            audit.gate(spark.createDataFrame([(bad,)], "x string"), profile)
    assert [r.x for r in audit.gate(spark.createDataFrame([("nan",), ("1e3",)], "x string"), profile).collect()] == [None, 1000.0]
    with pytest.raises(GateError, match="missing_values_prohibited"):
        audit.gate(spark.createDataFrame([(math.nan,)], "x double"), Profile("p", (ColumnSpec("x", "continuous"),)))


def test_nan_is_missing_and_not_finite(spark):
    df = spark.createDataFrame([(math.nan, 1.0), (None, 1.0), (1.0, math.nan), (math.inf, 2.0)], "x double, y double")
    got = lambda rule: [r[0] for r in df.select(rules.column_rule("x", rule, floating=True)).collect()]
    assert got({"type": "not_null"}) == [False, False, True, True] and got({"type": "finite"}) == [False, True, True, False] and got({"type": "bounds", "max": 2}) == [True, True, True, False]
    held = rules.validity(df, {"x": [{"type": "not_null"}]}, {"k": {"type": "comparison", "left": "x", "right": "y", "op": "ge"}}).collect()
    assert {(r.scope_id, r.n_valid) for r in held} == {("x", 2), ("k", 1), ("fully_valid_rows", 1)}
    assert stats.quantiles(spark.createDataFrame([(math.nan,), (1.0,), (None,)], "x double"), "x", {"m": 0.5}).first().m == 1.0
    arms = spark.createDataFrame([(1.0, False), (math.nan, False), (1.0, True)], f"x double, {fidelity.ARM} boolean")
    assert fidelity.ks_complement(arms, ["x"]).first().score == 1.0


def test_ids_are_unique(spark):
    for given, want in ((["a", "a", "a-2"], ["a", "a-2", "a-2-2"]), (["a-2", "a", "a"], ["a-2", "a", "a-3"]), (["x", "y"], ["x", "y"]), (["a", "a", "a"], ["a", "a-2", "a-3"])):
        df = spark.createDataFrame(list(enumerate(given)), "n long, s string")
        assert [r.column_id for r in audit.slugs(df, "n", "s").orderBy("n").collect()] == want


def test_exact_places_and_splits_with_ties(spark):
    r = np.random.default_rng(6)
    rows = [(int(i), int(i % 2), int(r.integers(0, 3)) if i % 5 else None) for i in range(500)] + [(500, 0, 1)] * 3
    df = spark.createDataFrame(rows, "id long, g long, k long")
    got = stats.places(df.where("k is not null"), ["g"], F.col("k"), ["id"]).collect()
    for g in (0, 1):
        mine = sorted((x._place, x.k) for x in got if x.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine) and {x._place_of for x in got if x.g == g} == {len(mine)}
    two = spark.createDataFrame([(i, "c", i % 2) for i in range(100)], "id long, c string, k long")
    sizes = {x.split: x["count"] for x in preprocess.stratified_split(two, "c", F.col("k")).groupBy("split").count().collect()}
    assert sizes == {"train": 60, "val": 20, "test": 20}
    same = preprocess.validation_rows(spark.createDataFrame([(1,)] * 90, "id long"), "id", 1).groupBy("split").count().collect()
    assert {x.split: x["count"] for x in same} == {"val": 10, "train": 80}
    made, _ = preprocess.covering_split(two, "id", ["c"])
    assert made.where("split = 'train'").count() == 90


def test_sentences_keep_commas(spark):
    rows = [("x, b is 3", "y\\"), (None, "1, 2"), ("\\, a is 1", None), (",", ", ")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [tuple(r) for r in df.select(X.sentence(["a", "b"]).alias("s")).select(*X.from_sentence(F.col("s"), ["a", "b"])).collect()] == rows


def plain_mixture(x, k, rounds, floor=1e-6, concentration=0.001):
    """The variational mixture, row by row, digamma by differences."""
    psi = lambda v: np.array([(math.lgamma(i + 1e-5) - math.lgamma(i - 1e-5)) / 2e-5 for i in v])
    place = np.searchsorted(np.unique(np.quantile(x, [i / k for i in range(1, k)])), x, "left")
    r = np.eye(k)[place]
    center, variance = x.mean(), x.var(ddof=1)
    for t in range(rounds + 1):
        n = r.sum(0) + 10 * np.finfo(float).eps
        m = (r * x[:, None]).sum(0) / n
        s = (r * (x[:, None] - m) ** 2).sum(0) / n + floor
        a, b = 1 + n, concentration + np.append(np.cumsum(n[::-1])[-2::-1], 0)
        means = (center + n * m) / (1 + n)
        var = (variance + n * s + n / (1 + n) * (m - center) ** 2) / (1 + n)
        lw = psi(a) - psi(a + b) + np.append(0, np.cumsum(psi(b) - psi(a + b))[:-1])
        log = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - means) ** 2 / var) + lw + 0.5 * (np.log(2) + psi((1 + n) / 2) - np.log(1 + n) - 1 / (1 + n))
        r = np.exp(log - log.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
    w = a / (a + b) * np.append(1, np.cumprod(b / (a + b))[:-1])
    return w / w.sum(), means, np.sqrt(var), r


def test_search_is_repeatable_and_goes_on(spark, tmp_path):
    space = {"x": tuning.Choice("float", -5.0, 5.0), "n": tuning.Choice("int", 1, 9), "rate": tuning.Choice("log", 1e-4, 1.0), "kind": tuning.Choice("values", values=("a", "b", "c"))}
    asked = []

    def objective(p):
        asked.append(p)
        if len(asked) == 3:
            raise GateError("empty_table")
        return -((p["x"] - 2) ** 2) - abs(p["n"] - 4) - abs(math.log10(p["rate"]) + 2) - (p["kind"] != "b")

    whole = [tuple(r) for r in tuning.search(spark, objective, space, 45, seed=3).collect()]
    assert [r[0] for r in whole] == list(range(45)) and [r[1] for r in whole].count("failed") == 1 and whole[2][2] is None
    best = tuning.best_trial(spark.createDataFrame(whole, tuning.TRIALS)).first()
    late, early = (np.mean([r[2] for r in part if r[2] is not None]) for part in (whole[25:], whole[:10]))
    assert late > early + 2 and best.value > -3 and all(1 <= p["n"] <= 9 and -5 <= p["x"] <= 5 and 1e-4 <= p["rate"] <= 1 for p in asked)
    asked.clear()
    folder = str(tmp_path / "trials")
    first = tuning.search(spark, objective, space, 7, seed=3, folder=folder).count()
    again = [tuple(r) for r in tuning.search(spark, objective, space, 45, seed=3, folder=folder).collect()]
    assert first == 7 and len(asked) == 45 and again == whole
    short = tuning.search(spark, lambda p: 1.0, {"x": tuning.Choice("float")}, 30, patience=4)
    assert short.count() == 5
    with pytest.raises(GateError, match="invalid_search_space"):
        tuning.search(spark, objective, {"x": tuning.Choice("log", 0.0, 1.0)}, 3)


def test_boosted_trees_over_ordered_statistics(spark):
    r = np.random.default_rng(13)
    rows = []
    for i in range(1200):
        c, x = "abcdefgh"[r.integers(0, 8)], float(r.random())
        rows.append((i, x, c if i % 50 else None, "yes" if (c in "abc") ^ (x > 0.9) else "no", float("abcdefgh".index(c)) * 3 + x))
    df = spark.createDataFrame(rows, "id long, x double, c string, y string, z double")
    arms = {k: df.where(F.col("id") % 4 == i) for i, k in enumerate(("train", "val", "test", "synthetic"))}
    for kind in ("real", "merged"):
        got = {(x.split, x.metric): x.value for x in boosted.evaluate(arms, "y", "classification", ["x"], ["c"], kind=kind, order=F.xxhash64("id"), rounds=10).collect()}
        assert set(got) == {(s, m) for s in ("train", "val", "test") for m in ("acc", "f1", "roc_auc")}
        assert got["test", "acc"] > 0.9 and got["test", "roc_auc"] > 0.9
    told = {(x.split, x.metric): x.value for x in boosted.evaluate(arms, "z", "regression", ["x"], ["c"], kind="synthetic", order=F.xxhash64("id"), rounds=20).collect()}
    assert told["test", "r2"] > 0.8
    noise = df.withColumn("y2", F.pmod(F.xxhash64("id"), F.lit(2)).cast("double")).withColumn("own", F.col("id").cast("string"))
    told = boosted.ordered_statistics(noise, "own", F.col("y2"), F.col("id")).select("own_stat").distinct().collect()
    assert len(told) == 1  # a category of one row tells nothing of its target
    with pytest.raises(GateError):
        boosted.evaluate(arms, "y", "classification", ["x"], ["c"], kind="none", order=F.col("id"))


def test_scores_of_arms_that_are_alike_or_apart(spark):
    """What detection, alpha-precision and delta-presence say of the same table and of one that is far away."""
    r = np.random.default_rng(14)
    make = lambda shift, first: spark.createDataFrame([(first + i, float(a) + shift, float(b), "pq"[i % 2]) for i, (a, b) in enumerate(r.normal(size=(400, 2)))], "id long, a double, b double, g string")
    real, like, far = make(0.0, 0), make(0.0, 1000), make(50.0, 2000)
    same, apart = (estimators.detection_score(real, x, ["a", "b"], ["g"], key="id").first() for x in (like, far))
    assert same.score > 0.8 and apart.score < 0.01 and apart.roc_auc > 0.995
    same, apart = (estimators.alpha_beta(real, x, "id", ["a", "b"]).first() for x in (like, far))
    assert same.alpha_precision > 0.85 and same.beta_recall > 0.3 and apart.alpha_precision < 0.1 and apart.beta_recall < 0.1
    one = estimators.delta_presence(real, real, ["a", "b"]).collect()
    assert len(one) == 2 + 5 + 10 + 15 and all(x.n_real == x.n_synthetic and math.isclose(x.ratio, 1.0, rel_tol=1e-6) for x in one)
    for k in (2, 5, 10, 15):
        assert sum(x.n_real for x in one if x.k == k) == 400
    assert estimators.delta_presence(real, far, ["a", "b"], clusters=(2,)).agg(F.sum("n_synthetic")).first()[0] == 400
    scores = estimators.simple_models(real, like, real, "g", "classification", ["a", "b"], [], kind="merged", evaluators=["perceptron"])
    assert {x.metric for x in scores.collect()} == {"macro-f1", "balanced-accuracy", "roc-auc", "pr-auc"}


def test_bayesian_mixture_against_numpy(spark):
    r = np.random.default_rng(8)
    x = np.round(np.concatenate([r.normal(-5, 0.5, 400), r.normal(3, 1.0, 800), r.normal(40, 2.0, 300)]), 2)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate([*x, *[0.0] * 200])] + [(-1, None), (-2, math.nan)], "id long, x double")
    fitted = preprocess.fit_modes(df, "x", 10, modal=[0.0])
    w, m, s, shares = plain_mixture(x[x != 0.0], 10, fitted.rounds)
    likely = set(shares.argmax(1))
    want = sorted(((w[k], m[k], s[k]) for k in range(10) if w[k] > 0.005 and k in likely), key=lambda p: p[1])
    assert 3 <= len(want) < 10 and np.allclose(fitted.parts, want, rtol=1e-5)
    rows = preprocess.mode_normalised(df, fitted, "id", 3).collect()
    n = len(fitted.parts)
    for row in rows:
        if row.x is None or math.isnan(row.x):
            assert row.x_mode is None and row.x_within is None
        elif row.x == 0.0:
            assert (row.x_mode, row.x_within) == (n, 0.0)
        else:
            _, mean, std = fitted.parts[row.x_mode]
            assert math.isclose(row.x_within, max(-0.99, min(0.99, (row.x - mean) / (4 * std))), abs_tol=1e-9)
    back = preprocess.mode_restored(preprocess.mode_normalised(df, fitted, "id", 3), fitted).where("x is not null and abs(x_within) < 0.99").collect()
    assert all(math.isclose(row.x, dict(enumerate([*x, *[0.0] * 200]))[row.id], abs_tol=1e-6) for row in back)
    drawn = np.array([row.x_mode for row in rows if row.id >= 0 and row.id < 1500])
    kept = [k for _, k in sorted((m[k], k) for k in range(10) if w[k] > 0.005 and k in likely)]
    assert np.abs(np.bincount(drawn, minlength=n)[:n] / 1500 - (shares[:, kept] / shares[:, kept].sum(1, keepdims=True)).mean(0)).max() < 0.03


def test_quantiles_and_running_sums(spark):
    r = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(r.integers(0, 3, 900), np.round(r.exponential(3, 900), 1))] + [(7, 1.0), (8, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.937, "e": 1.0}
    got = {x.g: tuple(x)[1:] for x in stats.quantiles(df, "v", shares, ["g"]).collect()}
    for g in (0, 1, 2, 7):
        mine = [v for k, v in rows if k == g]
        assert np.allclose(got[g], np.quantile(mine, list(shares.values())))
    averaged = {x.g: tuple(x)[1:] for x in stats.quantiles(df, "v", shares, ["g"], rule="averaged").collect()}
    assert np.allclose(averaged[1], np.quantile([v for k, v in rows if k == 1], list(shares.values()), method="averaged_inverted_cdf"))
    counts = df.where("v is not null").groupBy("v").count()
    for down, buckets in ((False, 7), (True, 7), (False, 40), (True, 200)):
        placed = sorted(stats.running_sums(counts, [], "v", ["count"], descending=down, buckets=buckets).collect(), key=lambda x: x.v, reverse=down)
        assert [x.upto_count for x in placed] == np.cumsum([x["count"] for x in placed]).tolist()


@pytest.mark.parametrize("kind", ["l1", "l2", "mean"])
def test_nearest_against_all_pairs(spark, kind):
    r = np.random.default_rng(11)
    make = lambda n, first: [(first + i, None if r.random() < 0.05 else float(np.round(r.normal(), 1)), float(r.integers(0, 4)), None if r.random() < 0.1 else str(r.choice(list("xyz")))) for i in range(n)]
    a, b = make(60, 0), make(150, 1000)
    schema = "id long, p double, q double, g string"
    ranges = [max(x[k] for x in b if x[k] is not None) - min(x[k] for x in b if x[k] is not None) for k in (1, 2)]

    def apart(x, y):
        d = 0.0
        for k in (1, 2):
            gap = 0.0 if x[k] is None and y[k] is None else 1.0 if x[k] is None or y[k] is None else abs(x[k] - y[k]) / ranges[k - 1]
            d += gap if kind == "l1" else gap * gap if kind == "l2" else min(gap, 1.0)
        d += (x[3] != y[3]) * (1.0 if kind == "mean" else 2.0)
        return math.sqrt(d) if kind == "l2" else d / 3 if kind == "mean" else d

    for left, own in ((a, False), (b, True)):
        found = distance.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(b, schema), "id", ["p", "q"], ["g"], kind=kind, neighbours=3, block=20, skip_equal_key=own)
        got = {x.id: x for x in found.collect()}
        assert len(got) == len(left)
        for x in left:
            want = sorted((apart(x, y), y[0]) for y in b if not (own and y[0] == x[0]))[:3]
            assert np.allclose(got[x[0]].distances, [d for d, _ in want])
            assert np.allclose([apart(x, next(y for y in b if y[0] == k)) for k in got[x[0]].neighbours], [d for d, _ in want])


@pytest.mark.parametrize("numeric, categorical", [([], ["g0", "g1", "g2"]), ([f"x{i}" for i in range(8)], [])])
def test_nearest_compares_few_blocks(spark, numeric, categorical):
    """Without a number, and with eight that follow two hidden ones: fewer than a tenth of the block pairs, and the result of all pairs."""
    block, sizes = 40, (3000, 12_000)

    def made(n, seed):
        r = np.random.default_rng(seed)
        x = r.random((n, 2)) @ np.random.default_rng(0).normal(size=(2, 8)) + r.normal(size=(n, 8)) * 0.002
        return pd.DataFrame({"k": np.arange(n) + seed * 10**6} | {f"x{i}": x[:, i] for i in range(8)} | {f"g{i}": r.integers(0, 6, n).astype(str) for i in range(3)})

    a, b = made(sizes[0], 1), made(sizes[1], 2)
    report = []
    got = {x.k: x for x in distance.nearest(spark.createDataFrame(a), spark.createDataFrame(b), "k", numeric, categorical, neighbours=2, block=block, report=report).collect()}
    assert report[0][0] < 0.1 * (sizes[0] // block) * (sizes[1] // block)
    for at in range(0, sizes[0], 500):
        part = a[at : at + 500]
        d = np.zeros((500, sizes[1]))
        for c in numeric:
            d += np.abs(part[c].values[:, None] - b[c].values) / (b[c].max() - b[c].min())
        for c in categorical:
            d += 2.0 * (part[c].values[:, None] != b[c].values)
        first = np.argsort(d, axis=1, kind="stable")[:, :2]
        for i, k in enumerate(part.k):
            assert np.allclose(got[k].distances, d[i, first[i]]) and got[k].neighbours == b.k.values[first[i]].tolist()


@pytest.mark.parametrize("kind", ["l1", "l2", "mean"])
def test_nearest_of_numbers_only(spark, kind):
    """Boxes of numbers: missing values, ties, equal rows, a column without range, the row itself left out."""
    r = np.random.default_rng(13)
    make = lambda n, first: [(first + int(i), *[None if r.random() < 0.03 else float(np.round(v, 1)) for v in r.normal(size=3)], 5.0) for i in r.permutation(n)]
    a, b = make(150, 0), make(700, 1000)
    schema = "id long, p double, q double, s double, flat double"
    matrix = lambda rows: np.array([[np.nan if v is None else v for v in x[1:]] for x in rows])
    keys, y = np.array([x[0] for x in b]), matrix(b)
    spread = np.nanmax(y, axis=0) - np.nanmin(y, axis=0)
    for left, own in ((a, False), (b, True)):
        found = distance.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(b, schema), "id", ["p", "q", "s", "flat"], [], kind=kind, neighbours=3, block=100, skip_equal_key=own)
        got = {x.id: x for x in found.collect()}
        assert len(got) == len(left)
        for key, x in zip((z[0] for z in left), matrix(left)):
            gap = np.abs(x - y) / np.where(spread > 0, spread, 1.0)
            gap[np.isnan(x) ^ np.isnan(y)], gap[np.isnan(x) & np.isnan(y)] = 1.0, 0.0
            d = gap.sum(1) if kind == "l1" else np.sqrt((gap**2).sum(1)) if kind == "l2" else np.minimum(gap, 1).mean(1)
            d[(keys == key) & own] = np.inf
            assert np.allclose(got[key].distances, np.sort(d)[:3])
            assert np.allclose(d[[int(np.flatnonzero(keys == k)[0]) for k in got[key].neighbours]], np.sort(d)[:3])


def test_boxes_leave_few_distances(spark, monkeypatch):
    """Independent numbers, where distances to pivots exclude nearly nothing: a row meets a small share of the rows."""
    r = np.random.default_rng(14)
    numbers = lambda n: distance.Points(distance.pa.array(range(n)), r.random((n, 6)), [])
    space = distance.Space(tuple("abcdef"), (), "l1", 2.0, (1.0,) * 6)
    own, there = numbers(500), numbers(16_000)
    there = there.at(distance.metric.halved(space.scaled(there.numbers)))
    whole = space.distances(own, there)
    met, plain = [], distance.Space.distances
    monkeypatch.setattr(distance.Space, "distances", lambda self, a, b, cap=None: met.append(len(a) * len(b)) or plain(self, a, b, cap))
    best, rows = distance._within(space, own, there, 2, False, np.full(len(own), np.inf))
    assert sum(met) < 0.2 * whole.size
    assert np.allclose(best, np.sort(whole, axis=1)[:, :2]) and np.allclose(whole[np.arange(500)[:, None], rows], best)


def test_one_wide_ball_widens_no_search(spark):
    """Balls of all sizes against all pairs; an outlier adds its own block pairs only; equal rows count once each."""
    r = np.random.default_rng(12)
    plain = np.round(r.random((1500, 2)), 3)
    plain[:40] = plain[0]
    fakes = np.round(r.random((1500, 2)), 3)

    def asked(real, fake, seen):
        frame = lambda m, first: spark.createDataFrame([(first + i, float(x), float(y)) for i, (x, y) in enumerate(m)], "k long, x double, y double")
        return tuple(distance.prdc(frame(real, 0), frame(fake, 10_000), "k", ["x", "y"], block=50, report=seen).first())

    def balls(points, centres):
        spread = centres.max(0) - centres.min(0)
        apart = lambda p, q: np.sqrt((((p[:, None] - q[None]) / spread) ** 2).sum(2))
        return apart(centres, points) <= np.sort(apart(centres, centres), axis=1)[:, 5:6]

    pairs = []
    for real in (plain, np.vstack([plain, [[30.0, 30.0]]])):
        seen = []
        inside, back = balls(fakes, real), balls(real, fakes)
        want = (inside.any(0).mean(), back.any(0).mean(), inside.sum() / (5 * len(fakes)), inside.any(1).mean())
        assert np.allclose(asked(real, fakes, seen), want)
        pairs.append(seen[0][0])
    assert pairs[1] < 10 * pairs[0]


def test_values_of_any_frequency_meet_their_counts(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"v{i // 4}") for i in range(600)]
    got = stats.duplicated(spark.createDataFrame(rows, "k long, v string"), ["v"]).collect()
    assert {r.k: r.duplicated for r in got} == {k: sum(v == w for _, w in rows) > 1 for k, v in rows} and len(got) == 600


def test_co_moments_against_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 40)) + 1e6
    x[r.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame(pd.DataFrame({f"c{i}": x[:, i] for i in range(40)} | {"arm": np.arange(200) % 2 == 0})).repartition(3)
    for row in stats.co_moments(df, [f"c{i}" for i in range(40)], "arm").withColumn("rho", stats.rho()).collect():
        both = x[(np.arange(200) % 2 == 0) == (row.by == "true")][:, [row.i, row.j]]
        both = both[~np.isnan(both).any(1)]
        assert row.n == len(both) and math.isclose(row.rho, np.corrcoef(both.T)[0, 1], abs_tol=1e-7)


def test_many_columns_end_soon(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(r.normal(size=(200, 100)), columns=[f"c{i}" for i in range(100)])).withColumn(fidelity.ARM, F.rand(1) < 0.5)
    assert fidelity.correlation_similarity(df, [f"c{i}" for i in range(100)]).where("score between 0 and 1").count() == 4950


@pytest.mark.parametrize("rows", [3000, 1000])
def test_rank_generator_keeps_ranks_and_marginals(spark, rows):
    r = np.random.default_rng(5)
    a = r.normal(size=3000)
    train = pd.DataFrame({"a": a, "b": np.round(np.exp(a + r.normal(size=3000)), 1), "c": r.integers(0, 4, 3000).astype(float), "g": np.where(a + r.normal(size=3000) > 0.5, "y", np.where(r.random(3000) < 0.5, "n", "m"))})
    made = generate.GENERATORS["tabsds"](["a", "b", "c"], ["g"]).fit(spark.createDataFrame(train)).sample(rows, 7)
    again = made.toPandas()
    assert made.columns == ["row_id", "a", "b", "c", "g"] and again.row_id.nunique() == rows
    coded = lambda df: df.assign(g=df.g.map({"m": 0, "n": 1, "y": 2}))[["a", "b", "c", "g"]].rank().corr().values
    assert np.abs(coded(again) - coded(train)).max() < 0.02
    for c in train.columns:
        if rows == 3000:
            assert sorted(again[c]) == sorted(train[c])
        else:
            assert sorted(again[c]) == sorted(train[c])[::3]


def test_rank_generator_reads_its_table_a_few_times(spark, monkeypatch):
    """Each table is evaluated twice at most, not once more for each value join; frequent and rare values, several pieces of scores."""
    monkeypatch.setattr(generate, "PIECE", 300)
    r = np.random.default_rng(6)
    a = r.normal(size=2500)
    train = pd.DataFrame({"a": np.where(r.random(2500) < 0.4, 0.0, np.round(a, 2)), "b": a + r.normal(size=2500), "c": r.integers(0, 3, 2500).astype(float), "d": np.full(2500, 7.0), "g": np.where(a > 0, "y", "n")})
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(train).mapInArrow(tell, "a double, b double, c double, d double, g string")
    got = {(x.left_column, x.right_column): x.rho for x in generate.spearman(df, ["a", "b", "c", "d"]).collect()}
    assert seen.value <= 2 * len(train)
    want = train[["a", "b", "c"]].rank().corr()
    assert len(got) == 6 and all(v is None if "d" in k else math.isclose(v, want.loc[k], abs_tol=1e-9) for k, v in got.items())
    seen.value = 0
    made = generate.RankGenerator(["a", "b", "c"], ["g"]).fit(df)
    assert seen.value <= 2 * len(train)
    for rows in (2500, 4001):
        out = made.sample(rows, 3).toPandas()
        assert sorted(out.row_id) == list(range(rows))
        for c in ("a", "b", "c", "g"):
            assert sorted(out[c]) == [sorted(train[c])[i * 2500 // rows] for i in range(rows)]
        assert np.abs(out[["a", "b", "c"]].rank().corr() - want).max().max() < 0.03


def test_independent_draws_follow_the_frequencies(spark):
    r = np.random.default_rng(15)
    df = spark.createDataFrame([(float(v), "a" if v < 0.9 else "b", None if i % 10 == 0 else i % 3) for i, v in enumerate(r.random(2000))], "x double, g string, k long")
    got = generate.MarginalGenerator(["x", "g", "k"]).fit(df).sample(3000, 5).toPandas()
    known = df.toPandas()
    assert len(got) == 3000 and got.row_id.nunique() == 3000 and set(got.x) <= set(known.x) and not got.isna().any().any()
    assert abs((got.g == "a").mean() - (known.g == "a").mean()) < 0.03 and np.abs(got.k.value_counts(normalize=True) - known.k.value_counts(normalize=True)).max() < 0.04
    assert abs(np.corrcoef(got.x, got.g == "a")[0, 1]) < 0.06 and abs(got.x.mean() - known.x.mean()) < 0.03


def test_subsampled_evaluation(spark):
    """The source protocol's subsample: the same rows for one seed, whole arms without it."""
    r = np.random.default_rng(16)
    profile = Profile("p", (ColumnSpec("a", "continuous"), ColumnSpec("g", "categorical")))
    arm = lambda n, shift: spark.createDataFrame([(float(v) + shift, "xy"[i % 2]) for i, v in enumerate(r.normal(size=n))], "a double, g string")
    real, fake = arm(400, 0.0), arm(300, 0.5)
    one, two, other = (evaluate.evaluate_table(real, fake, profile, subsample=100, seed=k).atoms.where("scope_id = 'a'").first() for k in (1, 1, 2))
    assert (one.n_reference, one.n_synthetic) == (100, 100) and one.raw_value == two.raw_value != other.raw_value
    assert evaluate.evaluate_table(real, fake, profile).atoms.first().n_reference == 400


def test_generators_keep_their_promises(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3] if i % 2 else "x", float(i % 7)) for i in range(60)], "id long, a string, b string, n double")
    drawn = generate.network_sample(df.withColumn("c", F.concat("a", "b")), {"a": [], "b": [], "c": ["a", "b"]}, 500, 1)
    assert drawn.count() == 500 and drawn.where("a is null or b is null or c is null").count() == 0
    made = generate.checked_sample(generate.NetworkGenerator(["n"], ["a", "b"], bins=3).fit(df), 77, 2, {"a": ["a", "b"]})
    assert made.columns == ["row_id", "n", "a", "b"]
    assert generate.hill_climb(df.withColumn("c", F.col("b")), ["b", "c"]) in ({"b": ["c"], "c": []}, {"b": [], "c": ["b"]})
    new = generate.smote(df, "id", ["n"], "a", "a", 25, 3, categorical=["b"]).collect()
    assert len(new) == 25 and {r.a for r in new} == {"a"} and {r.b for r in new} == {"x"} and all(0 <= r.n <= 6 for r in new)
    shuffled = generate.shuffled_columns(df, "id", ["n", "a", "b"], 4, levels=3)
    assert sorted(r.b for r in shuffled.collect()) == sorted(r.b for r in df.collect()) and shuffled.count() == 60
    assert generate.topped_up({"a": 5, "b": 2}) == {"a": 0, "b": 3}


def test_shuffled_columns_deal_within_levels(spark):
    """Values stay within their level, levels follow exact ranks, and rows without a lead value are dealt among themselves; keys may repeat."""
    r = np.random.default_rng(8)
    lead = [None if i % 11 == 0 else 0.0 if i % 3 == 0 else float(np.round(v, 1)) for i, v in enumerate(r.normal(size=900))]
    rows = [(f"k{i // 2}", v, f"b{i}", i) for i, v in enumerate(lead)]
    got = generate.shuffled_columns(spark.createDataFrame(rows, "k string, x double, b string, n long"), "k", ["x", "b", "n"], 4, levels=7).collect()
    there = np.sort([v for v in lead if v is not None])
    level = lambda v: -1 if v is None else int(np.searchsorted(there, v)) * 7 // len(there)
    assert sorted((x.k, str(x.x)) for x in got) == sorted((k, str(v)) for k, v, _, _ in rows)
    assert sorted((level(x.x), x.b) for x in got) == sorted((level(v), b) for _, v, b, _ in rows)
    assert sorted((level(x.x), x.n) for x in got) == sorted((level(v), n) for _, v, _, n in rows)
    assert sum(x.b == f"b{x.n}" for x in got) < 60


@pytest.mark.parametrize("pieces", [4, 256])
def test_values_at_places(spark, pieces):
    r = np.random.default_rng(9)
    v = np.where(r.random(3000) < 0.3, -0.5, np.round(r.normal(size=3000), 2)).tolist()
    df = spark.createDataFrame([(x,) for x in [*v, None, float("inf")]], "v double")
    asked = [0, 1, 700, 701, 1500, 2999, 3000]
    assert stats.at_places(df, "v", lambda n: asked if n == 3001 else [], pieces) == [sorted([*v, math.inf])[k] for k in asked]
    assert stats.at_places(df.where("v > 1e9 and v < 1e10"), "v", lambda n: asked) == []


def test_bundle_verifier_recomputes(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + i % 3), "abc"[i % 3]) for i in range(90)], "x double, y double, g string")
    profile = Profile("p", (ColumnSpec("x", "continuous"), ColumnSpec("y", "continuous"), ColumnSpec("g", "categorical")))
    out = evaluate.evaluate_table(df.where("x < 45"), df.where("x >= 45"), profile)
    assert out.status == "success" and bundle.verify(out.atoms, out.scores).count() == 0
    wrong = out.atoms.withColumn("weight", F.when(F.col("scope_id") == "g", 0.9).otherwise(F.col("weight")))
    assert {r.problem for r in bundle.verify(wrong, out.scores).collect()} >= {"not_reproducible", "wrong_contribution"}
    assert {r.problem for r in bundle.verify(out.atoms, out.scores.withColumn("score", F.col("score") + 0.1)).collect()} == {"wrong_score"}
    judged = evaluate.evaluate_table(df, df, profile, protocol="p3", definitions=[{"selector": {"semantic_types": ["continuous", "categorical"]}, "rules": [{"type": "not_null"}]}])
    assert judged.atoms.where("reason_code = 'no_reviewed_constraints'").count() == 1 and judged.status == "success"


def test_utility_protocol(spark):
    r = np.random.default_rng(5)
    rows = [(float(v), "pq"[int(v + r.normal(0, 0.3) > 0)], "uv"[i % 2]) for i, v in enumerate(r.normal(size=240))]
    df = spark.createDataFrame(rows, "x double, g string, h string").withColumn("k", F.monotonically_increasing_id())
    profile = Profile("p", (ColumnSpec("x", "continuous"), ColumnSpec("g", "categorical"), ColumnSpec("h", "categorical")))
    a, b, c = (df.where(F.col("k") % 3 == i).drop("k") for i in range(3))
    out = evaluate.evaluate_table(a, b, profile, protocol="p4", test=c, target="g", task="classification", evaluators=["logistic-regression"], seeds=[0, 1], expected_rows=b.count())
    kept = out.atoms.where("metric_id = 'std-local-utility-retention'").collect()
    assert len(kept) == 2 and all(x.state == "computed" and x.raw_value > 0.5 for x in kept) and out.status == "success"
    assert bundle.verify(out.atoms, out.scores).count() == 0
    lacking = evaluate.evaluate_table(a, b.where("g = 'p'"), profile, protocol="p4", test=c, target="g", task="classification", evaluators=["logistic-regression"], expected_rows=b.where("g = 'p'").count())
    assert {x.reason_code for x in lacking.atoms.where("metric_id = 'std-local-utility-retention'").collect()} == {"insufficient_target_support"} and lacking.status == "partial"


def test_json_and_configs():
    assert evaluate.canonical_json('{"b": 1, "a": [1.5, null]}') == '{"a":[1.5,null],"b":1}'
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(GateError):
            evaluate.canonical_json(bad)
    config = {"a": None, "b": [1, None, {"c": None}]}
    assert evaluate.unpacked_config(evaluate.packed_config(config)) == config
    with pytest.raises(GateError, match="invalid_task"):
        evaluate.check_protocol([{"dataset_id": "d", "columns": [{"name": "x"}]}], [{"task_id": "t", "dataset_id": "d", "target": "x"}])
