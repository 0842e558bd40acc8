"""Matrices, matching, search and q-gram tables."""

import random

import pytest

from glyphmatch.functions import kernels
from glyphmatch.functions.encode import from_texts
from glyphmatch.functions.metrics import text_distance
from glyphmatch.operators import grams, match, pairs, search
from glyphmatch.options import METHODS, options
from glyphmatch.sql import register


def vector(spark, values):
    return spark.createDataFrame(list(enumerate(values, 1)), "pos long, s string")


def test_matrix(spark):
    found = pairs.distance_matrix(vector(spark, ["aa", "bb", "cc"]), vector(spark, ["aa", "cc"]), method="lv", use_names="strings").collect()
    assert {(r.i, r.j): r.dist for r in found} == {(1, 1): 0, (1, 2): 2, (2, 1): 2, (2, 2): 2, (3, 1): 2, (3, 2): 0}
    assert {(r.label_i, r.label_j) for r in found} >= {("bb", "cc")}


def test_lower_triangle(spark):
    assert pairs.distance_matrix(vector(spark, ["a", "b", "c", "d", "e", "f"])).count() == 15
    found = {(r.i, r.j): r.dist for r in pairs.distance_matrix(vector(spark, ["a", None, "b"])).collect()}
    assert found == {(2, 1): None, (3, 1): 1, (3, 2): None}
    assert pairs.distance_matrix(vector(spark, ["a"])).count() == 0
    # From i to j: the third word loses a letter on its way to the first.
    one = pairs.distance_matrix(vector(spark, ["a", "ab"]), method="lv", weight=(0.5, 1, 1)).first()
    assert one.dist == 0.5


def test_similarity_matrix_equals_its_transpose(spark):
    found = {(r.i, r.j): r.sim for r in pairs.similarity_matrix(vector(spark, ["ca", "abc", "cba"])).collect()}
    assert len(found) == 9 and all(found[i, j] == found[j, i] for i, j in found) and found[2, 2] == 1


def test_pairing_by_position(spark):
    found = pairs.pairwise(vector(spark, ["a", "b", "c"]), vector(spark, ["a"]), method="lv").collect()
    assert sorted((r.pos, r.dist) for r in found) == [(1, 0), (2, 1), (3, 1)]
    assert pairs.pairwise(vector(spark, ["a"]), vector(spark, []), method="lv").count() == 0


def test_sequence_matrix(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4])], "pos long, s array<int>")
    assert {(r.i, r.j): r.dist for r in pairs.seq_distmatrix(df, df).collect()} == {(1, 1): 0, (1, 2): 2, (2, 1): 2, (2, 2): 0}


def matched(spark, x, table, **how):
    xs = spark.createDataFrame(list(enumerate(x, 1)), "id long, x string")
    ts = spark.createDataFrame(list(enumerate(table, 1)), "pos long, t string")
    return [r.match for r in match.amatch(xs, ts, **how).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("x", "table", "how", "expected"),
    [
        (["aa"], ["ba", "bb"], {"max_dist": 1}, [1]),
        (["aa"], ["bb", "bb"], {"max_dist": 1}, [None]),
        ([None], ["a"], {}, [None]),
        ([None], ["a"], {"nomatch": 0}, [0]),
        ([None], [None, None], {}, [1]),
        ([None], [None], {"match_na": False, "nomatch": 7}, [7]),
        (["600 EXAMPLE AVE NJ 8629"], ["2100 EXAMPLE AVE NJ 8619", "600 EXAMPLE AVE NJ 8629"], {"method": "jaccard"}, [2]),
        (["smith"], ["smyth", "smelt"], {"method": "soundex"}, [1]),
        (["INIGO"], ["IÑIGO"], {"method": "lv", "max_dist": 1}, [1]),
        (["Motörhead"], ["bastard", "Motorhead"], {"method": "dl", "max_dist": 2, "use_bytes": True}, [2]),
        (["Motörhead"], ["bastard", "Motorhead"], {"method": "dl", "max_dist": 1, "use_bytes": True}, [None]),
        (["Motörhead"], ["bastard", "Motorhead"], {"method": "lcs", "max_dist": 3, "use_bytes": True}, [2]),
        (["Motörhead"], ["bastard", "Motorhead"], {"method": "qgram", "q": 3, "max_dist": 7, "use_bytes": True}, [2]),
        (["Motörhead"], ["bastard", "Motorhead"], {"method": "qgram", "q": 3, "max_dist": 6, "use_bytes": True}, [None]),
    ],
)
def test_nearest_match(spark, x, table, how, expected):
    assert matched(spark, x, table, **how) == expected


@pytest.mark.parametrize("method", ["osa", "dl", "lv", "jw"])
def test_unbounded_match(spark, method):
    assert matched(spark, ["m", "fem"], ["male", "female"], method=method, max_dist=float("inf")) == [1, 2]


@pytest.mark.parametrize(("method", "most", "how"), [("osa", 1, {}), ("osa", 2, {}), ("lv", 2, {}), ("dl", 2, {}), ("lcs", 2, {}), ("hamming", 2, {}), ("lv", 1, {"weight": (0.5, 0.25, 1)}), ("dl", 1, {"weight": (0.5, 0.5, 1, 0.25)}), ("jaccard", 0.6, {"q": 2}), ("cosine", 0.5, {"q": 2}), ("qgram", 3, {"q": 2}), ("jw", 0.3, {}), ("soundex", 0.5, {})])
def test_pruning_loses_nothing(spark, method, most, how):
    rng = random.Random(11)
    words = ["".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(90)]
    x, table = words[:45], words[45:]
    o = options(method, **how)
    expected = []
    for w in x:
        if method == "soundex":
            from glyphmatch.functions.metrics import text_distance

            df = spark.createDataFrame([(t, w) for t in table], "t string, x string")
            d = [r[0] for r in df.select(text_distance("t", "x", "soundex")).collect()]
        else:
            d = kernels.distances(from_texts(table), from_texts([w] * len(table)), o).tolist()
        near = [(v, k) for k, v in enumerate(d, 1) if v <= most]
        expected.append(min(near)[1] if near else None)
    assert matched(spark, x, table, method=method, max_dist=most, **how) == expected


def test_membership_and_sequences(spark):
    x = spark.createDataFrame([(1, "foo"), (2, "bar"), (3, None)], "id long, x string")
    t = spark.createDataFrame([(1, "fu"), (2, "bars")], "pos long, t string")
    assert [r.found for r in match.ain(x, t, max_dist=1, method="lv").orderBy("id").collect()] == [False, True, False]
    x = spark.createDataFrame([(1, [1, 3, 2]), (2, [1, 2, 3])], "id long, x array<int>")
    t = spark.createDataFrame([(1, [2, 3, 4]), (2, [1, 2, 3])], "pos long, t array<int>")
    assert [r.match for r in match.seq_amatch(x, t, max_dist=3).orderBy("id").collect()] == [2, 2]
    assert [r.found for r in match.seq_ain(x, t).orderBy("id").collect()] == [False, True]
    with pytest.raises(ValueError):
        match.amatch(x, t, max_dist=0)


TEXTS = ["When I grow up, I want to be", "one of the harversters of the sea", "I think before my days are gone", "I want to be a fisherman"]


def texts(spark, values=TEXTS):
    return spark.createDataFrame(list(enumerate(values, 1)), "i long, x string")


def test_search(spark):
    patterns = spark.createDataFrame([(1, "fish"), (2, "gone"), (3, "to be")], "j long, pattern string")
    found = {(r.i, r.j): (r.location, r.distance, r.match) for r in search.afind(texts(spark), patterns).collect()}
    expected = [
        [(1, 4, "When"), (1, 3, "When"), (24, 0, "to be")],
        [(6, 2, "f th"), (1, 2, "one "), (28, 3, "he se")],
        [(1, 3, "I th"), (28, 0, "gone"), (6, 2, "nk be")],
        [(16, 0, "fish"), (3, 3, "want"), (8, 0, "to be")],
    ]
    assert found == {(i, j): expected[i - 1][j - 1] for i in range(1, 5) for j in range(1, 4)}


def test_search_by_pattern(spark):
    df = texts(spark)
    assert [r.i for r in search.grab(df, "harvester", max_dist=2).collect()] == [2]
    assert [r.match for r in search.grab(df, "harvester", max_dist=2, value=True).collect()] == ["harverste"]
    assert [r.found for r in search.grabl(df, "harvester", max_dist=2).orderBy("i").collect()] == [False, True, False, False]
    assert [r.match for r in search.extract(df, "harvester", max_dist=2).orderBy("i").collect()] == [None, "harverste", None, None]
    assert [r.found for r in search.grabl(df, None).collect()] == [None] * 4
    with pytest.raises(ValueError):
        search.grab(df, "x", max_dist=-1)


@pytest.mark.parametrize("method", [m for m in (*METHODS, "running_cosine") if m not in ("soundex", "hamming")])
def test_search_by_every_method(spark, method):
    patterns = spark.createDataFrame([(1, "lizard")], "j long, pattern string")
    df = texts(spark, ["If you squeeze my lizzard, I put my snake on you."])
    assert search.afind(df, patterns, method=method, q=3, p=0.1).first().location == 19


def test_search_edges(spark):
    df = texts(spark, ["foo", "", None])
    patterns = spark.createDataFrame([(1, ""), (2, "foo"), (3, None)], "j long, pattern string")
    for method in ("osa", "soundex"):
        found = {(r.i, r.j): (r.location, r.distance, r.match) for r in search.afind(df, patterns, method=method).collect()}
        assert all(found[i, j] == (None, None, None) for i, j in found if i == 3 or j == 3)
    found = {(r.i, r.j): (r.location, r.distance, r.match) for r in search.afind(df, patterns).collect()}
    assert found[1, 1][1] == 0 and found[2, 2] == (1, 3, "") and found[1, 2] == (1, 0, "foo")
    same = [sorted(map(tuple, search.afind(texts(spark), patterns.filter("j = 2"), method=m, q=3).collect())) for m in ("cosine", "running_cosine")]
    assert same[0] == same[1]
    wide = search.afind(texts(spark), patterns.filter("j = 2"), window=6).first()
    assert len(wide.match) == 6
    in_bytes = search.afind(texts(spark, ["aöb"]), spark.createDataFrame([(1, "b")], "j long, pattern string"), use_bytes=True).first()
    assert (in_bytes.location, in_bytes.match) == (4, "b")


@pytest.mark.parametrize(("values", "q", "expected"), [(["a"], 1, {"a": 1}), (["aa"], 1, {"a": 2}), (["a", "a"], 1, {"a": 2}), ([None, "a"], 1, {"a": 1}), ([None], 1, {}), (["a"], 2, {}), (["a", "ab"], 2, {"ab": 1}), ([""], 0, {"": 1}), (["😀ö😀"], 2, {"😀ö": 1, "ö😀": 1})])
def test_qgrams(spark, values, q, expected):
    df = spark.createDataFrame([("v", x) for x in values], "name string, s string")
    assert {r.qgram: r.n for r in grams.qgrams(df, q).collect()} == expected


def test_qgram_tables(spark):
    df = spark.createDataFrame([("v", "aö")], "name string, s string")
    assert {r.qgram for r in grams.qgrams(df, 2, use_bytes=True).collect()} == {"61|c3", "c3|b6"}
    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", [2, 3, 4]), ("b", [None, 1])], "name string, s array<int>")
    table = {tuple(r.qgram): (r.a, r.b) for r in grams.wide(grams.seq_qgrams(df, 2)).collect()}
    assert table == {(1, 2): (1, 0), (2, 3): (1, 1), (3, 4): (0, 1)}
    with pytest.raises(ValueError):
        grams.qgrams(df, -1)


def test_sql_names(spark):
    register(spark)
    row = spark.sql("select sd_osa('ca', 'abc') o, sd_dl('ca', 'abc') d, sd_jw('a', 'a') j, sd_phonetic('Ashcraft') p, sd_phonetic('Motörhead') m, sd_printable_ascii('ö') a, sd_afind('a gone b', 'gone').location l").first()
    assert tuple(row) == (3, 2, 0, "A261", "M3?6", False, 3)


def test_sql_options(spark):
    register(spark)
    one = lambda q: spark.sql(f"select {q}").first()[0]
    assert one("sd_distance('ca', 'abc')") == 3 and one("sd_distance('ca', 'abc', 'dl')") == 2
    assert one("sd_distance('abcd', 'bcde', method => 'qgram', q => 2)") == 2
    assert one("sd_distance('ab', 'ba', weight => array(1d, 1d, 1d, 0.5d))") == 0.5
    assert one("sd_distance('MARTHA', 'MARHTA', 'jw', p => 0.1d)") == pytest.approx(0.0388889)
    assert one("sd_distance('ö', 'o', 'lv', use_bytes => true)") == 2 and one("sd_distance(null, 'a')") is None
    assert one("sd_distance('Robert', 'Rupert', 'soundex')") == 0 and one("sd_distance(null, 'a', 'soundex')") is None
    assert one("sd_similarity('abcd', 'abce')") == 0.75 and one("sd_similarity('ab', 'abc', 'hamming')") == 0
    assert one("sd_similarity('abcd', 'bcde', 'qgram', q => 2)") == pytest.approx(2 / 3)
    assert one("sd_amatch('hello', array('hallo', null, 'help'), 2)") == 1 and one("sd_amatch('hello', array('xxxxx'), 2)") is None
    assert one("sd_amatch(null, array('hallo', null), 2)") == 2
    assert one("sd_lower_tri(array('a', 'ab', 'abc'), 'lv')") == [1, 2, 1] and one("sd_lower_tri(array('a', null))") == [None]
    assert one("sd_qgrams('abab', 2)") == {"ab": 2, "ba": 1} and one("sd_qgrams('ab')") == {"a": 1, "b": 1}
    assert one("sd_phonetic('Motörhead', true)") == "M3?6" and one("sd_lv('ab', 'b')") == 1 and one("sd_soundex('ab', 'ab')") == 0
    assert one("sd_hamming('abc', 'abd')") == 1 and one("sd_hamming('abc', 'ab')") == float("inf") and one("sd_jaccard('ab', 'bc')") == pytest.approx(2 / 3)
    assert one("sd_jaccard('', '')") == 0 and one("sd_jaccard(null, '')") is None


@pytest.mark.parametrize(("method", "most", "how"), [("jw", 0.2, {"p": 0.1}), ("jw", 0.35, {}), ("jaccard", 0.4, {"q": 2}), ("cosine", 0.25, {"q": 2}), ("qgram", 3, {"q": 2}), ("lv", 6, {}), ("osa", 5, {})])
def test_no_candidate_is_lost(spark, method, most, how):
    """Every pair within the distance is among the candidates, and membership agrees with the nearest match."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcde", k=rng.randint(0, 11))) for _ in range(90)]
    x = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:45])], "id long, x string")
    t = spark.createDataFrame([(k, t) for k, t in enumerate(texts[45:], 1)], "pos long, t string")
    every = x.crossJoin(t).select("id", "pos", text_distance("t", "x", method, **how).alias("d")).filter(f"d <= {most} and not isnan(d)").collect()
    best = {}
    for r in every:
        best[r.id] = min(best.get(r.id, (9e9, 0)), (0.0 if abs(r.d) < 1e-14 else r.d, r.pos))
    found = {r.id: (r.dist, r.match) for r in match.amatch(x, t, max_dist=most, method=method, **how).collect() if r.match is not None}
    assert found == best
    assert {r.id for r in match.ain(x, t, max_dist=most, method=method, **how).collect() if r.found} == set(best)


def test_search_has_no_shuffle(spark):
    texts = spark.range(5).selectExpr("id as i", "concat('text ', id) as x")
    assert "Exchange" not in search.grabl(texts, "text", max_dist=1)._jdf.queryExecution().toString()


SEQUENCES = [None, [], [None], [1], [1, None, 2], [1, -1, 2], [2, 1], [1, 2, 1, 2], [3, 3, 3], [1, 2, 3, 1, 2], [1, 2, 1, 2]]


def _gram_distance(a, b, method, q):
    from collections import Counter

    a, b = (Counter(tuple(s[k : k + q]) for k in range(len(s) - q + 1)) for s in (a, b))
    if method == "qgram":
        return float(sum(abs(a[g] - b[g]) for g in a | b))
    if method == "jaccard":
        return 1 - len(a.keys() & b.keys()) / len(a | b) if a or b else 0.0
    if a == b:
        return 0.0
    norm = lambda c: sum(n * n for n in c.values())
    return abs(1 - sum(a[g] * b[g] for g in a) / (norm(a) ** 0.5 * norm(b) ** 0.5)) if a and b else float("nan")


@pytest.mark.parametrize(("method", "q", "most"), [("cosine", 1, 0.3), ("cosine", 2, 0.9), ("jaccard", 2, 0.7), ("jaccard", 1, 1.0), ("qgram", 1, 3), ("qgram", 2, float("inf"))])
def test_sequences_are_matched_by_profiles(spark, method, q, most):
    """No kernel sees a pair's sequences, and no pair carries them: they are counted once (F2, F3)."""
    rows = spark.createDataFrame(list(enumerate(SEQUENCES)), "id int, x array<int>")
    entries = rows.filter("id not in (3, 7)").selectExpr("id as pos", "x as t")
    got = match.seq_amatch(rows, entries, max_dist=most, method=method, q=q)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    there = lambda s: None if s is None or s[:1] == [None] else s
    want = {}
    for i, s in enumerate(map(there, SEQUENCES)):
        of = [(round(_gram_distance(s, t, method, q), 12), k) for k, t in enumerate(map(there, SEQUENCES)) if s is not None and t is not None and k not in (3, 7)]
        near = min((x for x in of if x[0] <= most and x[0] < float("inf")), default=(None, None))
        want[i] = near[::-1] if s is not None else (0, None)
    assert {r.id: (r.match, r.dist and round(r.dist, 9)) for r in got.collect()} == {i: (k, d and round(d, 9)) for i, (k, d) in want.items()}
    found = match.seq_ain(rows, entries, max_dist=most, method=method, q=q)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.found for r in found.collect()} == {i: k is not None for i, (k, _) in want.items()}


@pytest.mark.parametrize("most_kinds", [512, 3])
@pytest.mark.parametrize("wide", [0, 200])
def test_sequence_matrices_make_sets_once(spark, monkeypatch, most_kinds, wide):
    """What joins pairs of sequences reads sets (F4, F5): the plan cuts no grams above its join, by bits of several words or by arrays."""
    from glyphmatch.plans import profiles

    monkeypatch.setattr(profiles, "MOST_KINDS", most_kinds)
    sequences = [*SEQUENCES, list(range(wide)), list(range(0, wide, 2)), list(range(wide // 2, wide))]
    rows = spark.createDataFrame(list(enumerate(sequences)), "pos int, s array<int>")
    there = lambda s: None if s is None or s[:1] == [None] else s
    want = {(i, j): None if there(s) is None or there(t) is None else round(_gram_distance(s, t, "jaccard", 2), 9) for i, s in enumerate(sequences) for j, t in enumerate(sequences)}
    shown = lambda df, name: {(r.i, r.j): None if r[name] is None else round(r[name], 9) for r in df.collect()}
    lower, whole = pairs.seq_distmatrix(rows, method="jaccard", q=2, use_names="strings"), pairs.seq_distmatrix(rows, rows, method="jaccard", q=2)
    for df in (lower, whole):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "slice(" not in plan and "array_join(" not in plan[: plan.index("Join")]
    assert shown(lower, "dist") == {(i, j): d for (i, j), d in want.items() if i > j}
    assert {(r.i, str(r.label_i)) for r in lower.collect()} == {(i, str(s)) for i, s in enumerate(sequences) if i}
    assert shown(whole, "dist") == want
    assert shown(pairs.seq_simmatrix(rows, rows, method="jaccard", q=2), "sim") == {k: None if d is None else round(1 - d, 9) for k, d in want.items()}
