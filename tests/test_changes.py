"""Features, bins, scaling, reshaping, encodings, text."""

import statistics

import pytest
from pyspark.sql import functions as F

from scour.operators import encode, features, reshape, schema, text
from scour.plans.stages import apply_stage
from tests.conftest import values


def run(df, ops, stage="transformation", **more):
    return apply_stage(df, {f"{stage}_operations": ops}, stage, **more)


def test_scale_one_hot_and_bins(frame):
    rows = [(7, "oak", 120), (11, "elm", 345), (13, "oak", 410), (19, "fir", 720)]
    df = frame(rows, "rings long, wood string, height long")
    out, log = run(
        df,
        {
            "rings": [{"operation": "scale_normalize", "method": "standard_scaler"}],
            "wood": [{"operation": "encode_categorical", "method": "one_hot"}],
            "height": [{"operation": "discretize_bin", "method": "equal_width", "bins": 4}],
        },
    )
    assert [e.status for e in log] == ["completed"] * 3
    scaled = values(out, "rings")
    assert abs(statistics.mean(scaled)) < 1e-10 and abs(statistics.stdev(scaled) - 1) < 1e-10
    assert {"wood_oak", "wood_elm", "wood_fir"} <= set(out.columns) and "wood" not in out.columns
    assert values(out, "height_binned") == ["(119.399, 270.0]", "(270.0, 420.0]", "(270.0, 420.0]", "(570.0, 720.0]"]


def test_single_row_and_empty_table(spark, frame):
    df = frame([(31, "ash")], "rings long, wood string")
    ops = {"rings": [{"operation": "scale_normalize", "method": "standard_scaler"}], "wood": [{"operation": "encode_categorical", "method": "one_hot"}]}
    out, log = run(df, ops)
    assert [e.status for e in log] == ["completed"] * 2 and values(out, "rings") == [None]
    empty = spark.createDataFrame([], "x double")
    assert apply_stage(empty, {}, "transformation")[0].count() == 0


def test_wrong_kind_of_column_fails_and_changes_nothing(frame):
    df = frame([("wet", 40), ("dry", 12)], "soil string, depth long")
    ops = {
        "soil": [{"operation": "scale_normalize", "method": "standard_scaler"}, {"operation": "discretize_bin", "method": "equal_width", "bins": 2}],
        "depth": [{"operation": "encode_categorical", "method": "one_hot"}, {"operation": "text_processing", "method": "lowercase"}],
    }
    out, log = run(df, ops)
    assert [e.status for e in log] == ["failed"] * 4 and out.collect() == df.collect()


def test_formula_rename_drop(frame):
    df = frame([("Quercus", "robur", 80, "moist"), ("Ulmus", "glabra", 35, "chalk")], "genus string, species string, years long, ground string")
    ops = [
        {"operation": "create_new_feature", "formula": "concat(genus, ' ', species)", "new_feature_name": "latin"},
        {"operation": "rename_column", "old_name": "years", "new_name": "stands"},
        {"operation": "drop_column", "column_name": "ground"},
        {"operation": "create_new_feature", "formula": "no_such_column + 1"},
        {"operation": "rename_column", "old_name": "gone", "new_name": "x"},
        {"operation": "create_new_feature", "method": "age_grouping"},
        {"operation": "create_new_feature"},
    ]
    out, log = run(df, {"global": ops}, "modification")
    assert [e.status for e in log] == ["completed"] * 3 + ["failed"] + ["skipped"] * 3
    assert values(out, "latin") == ["Quercus robur", "Ulmus glabra"] and out.columns == ["genus", "species", "stands", "latin"]


def test_aggregate_guards_and_null_rules(frame):
    df = frame([("a", 1.0), ("a", None), ("b", None), (None, 9.0)], "k string, v double")
    assert sorted(map(tuple, features.aggregate(df, "k", "v", "sum").collect())) == [("a", 1.0), ("b", 0.0)]
    assert dict(map(tuple, features.aggregate(df, ["k"], "v", "size").collect())) == {"a": 2, "b": 1}
    op = {"operation": "aggregate", "group_by_cols": "k, zz", "target_column": "v", "method": "sum"}
    bad = [op, {"operation": "aggregate"}, op | {"group_by_cols": "k", "method": "zigzag"}]
    out, log = run(df, {"global": bad}, "modification")
    assert [e.status for e in log] == ["failed"] * 3 and out.count() == 4


def test_edges_closed_on_the_right_side(frame):
    df = frame([(10.0,), (20.0,), (30.0,)], "x double")
    with_lowest = features.make_bins([10, 20, 30], ["a", "b"], include_lowest=True)
    without = features.make_bins([10, 20, 30], ["a", "b"])
    assert values(features.discretise(df, "x", with_lowest), "x_binned") == ["a", "a", "b"]
    assert values(features.discretise(df, "x", without), "x_binned") == ["a", "b", None]
    close = features.make_bins([0.00012, 1.00001, 1.00002], None)
    assert close.labels == ("(0.00012, 1.00001]", "(1.00001, 1.00002]")


def test_equal_quantile_edges_collapse(frame):
    df = frame([(v,) for v in (1.0, 1.0, 1.0, 2.0, 3.0, 4.0)], "x double")
    bins = features.fit_equal_frequency(df, "x", 4)
    assert bins.edges == (1.0, 1.5, 2.75, 4.0) and bins.labels == ("(0.999, 1.5]", "(1.5, 2.75]", "(2.75, 4.0]")
    out = features.discretise(df, "x", bins)
    assert len(set(values(out, "x_binned"))) == 3 and out.where("x_binned IS NULL").count() == 0
    with pytest.raises(ValueError):
        features.fit_equal_frequency(df, "x", 4, ["a", "b", "c", "d"])


def test_age_and_bmi_edges(frame):
    ages = [-1, 0, 17, 18, 34, 35, 55, 99, 100, None]
    out = features.age_groups(frame([(a,) for a in ages], "age int"))
    got = {r["age"]: r["engineered_feature"] for r in out.collect()}
    assert got == {-1: None, 0: "0-18", 17: "0-18", 18: "19-35", 34: "19-35", 35: "36-55", 55: "56+", 99: "56+", 100: None, None: None}
    bmis = [0.0, 18.5, 18.6, 24.9, 40.0, 100.0, 101.0]
    out = features.bmi_classes(frame([(b,) for b in bmis], "bmi double"))
    got = [r["engineered_feature"] for r in out.orderBy("bmi").collect()]
    assert got == [None, "Underweight", "Normal weight", "Normal weight", "Obesity Class III", "Obesity Class III", None]


def test_constant_column_scales_to_null(frame):
    df = frame([(5.0,)] * 3, "x double")
    assert values(features.scale(df, "x", "min_max_scaler"), "x") == [None] * 3
    assert features.fit_scale(df, "x").method == "standard_scaler"


def test_pivot_leaves_null_keys_out_and_unpivot_turns_it_back(frame):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (1, "a", 3.0), (2, None, 4.0), (None, "a", 5.0), (2, "b", 6.0)]
    df = frame(rows, "i int, c string, v double")
    wide = reshape.pivot(df, "i", "c", "v")
    assert sorted(map(tuple, wide.collect())) == [(1, 2.0, 2.0), (2, None, 6.0)]
    long = reshape.unpivot(wide, "i", ["a", "b"], "c", "v").where("v IS NOT NULL")
    assert sorted(map(tuple, long.collect())) == [(1, "a", 2.0), (1, "b", 2.0), (2, "b", 6.0)]
    mixed = reshape.unpivot(df.where("i = 2 AND c = 'b'"), ["i"], ["c", "v"])
    assert sorted(map(tuple, mixed.collect())) == [(2, "c", "b"), (2, "v", "6.0")]


def test_merge_with_unknown_table_or_column(frame):
    df = frame([(1,)], "k int")
    other = frame([(1, "x")], "k int, v string")
    ops = [
        {"operation": "merge", "right_df_name": "nope", "on": "k"},
        {"operation": "merge", "right_df_name": "t", "on": "z"},
        {"operation": "join", "right_df_name": "t", "on": "k", "how": "sideways"},
        {"operation": "join", "right_df_name": "t", "on": "k"},
    ]
    out, log = run(df, {"global": ops}, tables={"t": other})
    assert [e.status for e in log] == ["skipped", "failed", "failed", "completed"] and out.first()["v"] == "x"


@pytest.mark.parametrize("n, method", [(5, "one_hot"), (6, "label_encode"), (50, "label_encode"), (51, "frequency_encode")])
def test_adaptive_encoding_thresholds(frame, n, method):
    df = frame([(f"v{i:03}",) for i in range(n)] + [(None,)], "c string")
    assert encode.adaptive_method(df, "c") == method


def test_large_code_tables_give_the_same_codes(frame):
    data = [("hot",)] * 300 + [(f"v{i:03}",) for i in range(200)] + [(None,)] * 3
    df = frame(data, "c string")
    for encoder, name in ((encode.label_encode, "c_encoded"), (encode.frequency_encode, "c_freq_encoded")):
        small = sorted(map(str, encoder(df, "c").select("c", name).collect()))
        assert sorted(map(str, encoder(df.repartition(7), "c", limit=10).select("c", name).collect())) == small
    labels = {r["c"]: r["c_encoded"] for r in encode.label_encode(df, "c").collect()}
    assert labels["hot"] == 0 and labels["v000"] == 1 and labels[None] == 201


def test_one_hot_sums_to_the_known_rows(frame):
    df = frame([("a",), ("b",), (None,), ("a",)], "c string")
    sums = encode.one_hot(df, "c").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("c_a", "c_b")]).first()
    assert tuple(sums) == (2, 1)
    with pytest.raises(ValueError):
        encode.one_hot(df, "c", limit=1)


TEXTS = [(0, "Éa, b_c-2!"), (1, "the Cats can't"), (2, ""), (3, None)]


@pytest.mark.parametrize(
    "method, expected",
    [
        ("lowercase", ["éa, b_c-2!", "the cats can't", "", None]),
        ("remove_punctuation", ["Éa b_c2", "the Cats cant", "", None]),
        ("remove_stopwords", ["Éa, b_c-2!", "Cats can't", "", None]),
        ("lemmatize", ["Éa, b_c-2!", "the cat can't", "", None]),
        ("expand_contractions", ["Éa, b_c-2!", "the Cats cannot", "", None]),
        ("remove_accents", ["Ea, b_c-2!", "the Cats can't", "", None]),
    ],
)
def test_text_methods(frame, method, expected):
    options = {"lexicon": {"Cats": "cat", "cat": "cat"}} if method == "lemmatize" else {}
    df = frame(TEXTS, "i int, t string")
    out, log = run(df, {"t": [{"operation": "text_processing", "method": method} | options]})
    assert log[0].status == "completed"
    assert [r[f"t_{method}"] for r in out.orderBy("i").collect()] == expected


def test_unknown_text_method_fails(frame):
    _, log = run(frame(TEXTS, "i int, t string"), {"t": [{"operation": "text_processing", "method": "sing"}, {"operation": "text_processing", "method": "lemmatize"}]})
    assert [e.status for e in log] == ["failed", "failed"]


def test_lemma_rules_need_a_known_stem():
    lexicon = {w: w for w in ("box", "bus", "wolf", "baby", "man", "church", "ring")} | {"geese": "goose"}
    forms = {"boxes": "box", "buses": "bus", "wolves": "wolf", "babies": "baby", "men": "man", "churches": "church", "geese": "goose", "runs": "runs"}
    assert {w: text.lemma_of(w, lexicon) for w in forms} == forms


def test_declared_types(frame):
    rows = [("1", "2.5", "True", "2020-01-01 00:00:00-05:00", "x"), ("7.0", "oops", "false", "2020-06-01", "y"), (None, None, None, None, None)]
    df = frame(rows, "a string, b string, c string, d string, e string")
    types = {"a": "integer", "b": "float", "c": "boolean", "d": "datetime", "e": "datetime", "zz": "float", "b2": "odd"}
    out, warnings = schema.standardise_types(df, types)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "timestamp", "e": "string"}
    assert values(out, "a") == [1, 7, None] and values(out, "b") == [2.5, None, None] and list(warnings) == ["e"]
    assert out.where("d = timestamp'2020-01-01 05:00:00+00:00'").count() == 1


def test_compact_types(frame):
    df = frame([(1, 300, 2**40, 0.5), (None, -5, 7, 1.5)], "a long, b long, c long, d double")
    assert dict(schema.compact_types(df, floats=True).dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "float"}


def test_lemmas_by_join_equal_lemmas_by_word(spark, frame):
    lexicon = {"box": "box", "wolf": "wolf", "wolves": "wolf", "glass": "glass", "bus": "bus", "buse": "buse", "city": "city", "men": "men", "ox": "ox", "oxen": "ox"}
    texts = ["boxes wolves wolfs glasses", "  buses cities  oxen ", "unknowns men mens boxs", "", None, "glass box", "boxes"]
    df = frame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = spark.createDataFrame(list(lexicon.items()), "form string, lemma string")
    by_word, by_join = (text.process_text(df, "t", "lemmatize", lexicon=x) for x in (lexicon, table))
    assert by_join.columns == by_word.columns
    assert sorted(by_join.collect(), key=lambda r: r.i) == sorted(by_word.collect(), key=lambda r: r.i)
