"""Values of the distances, similarities and codes, and invariants on random strings."""

import math
import random

import numpy as np
import pytest

from glyphmatch.functions import kernels
from glyphmatch.functions.encode import from_texts
from glyphmatch.functions.metrics import codes_of, seq_dist, seq_sim, text_distance, text_similarity
from glyphmatch.functions.phonetic import phonetic, printable_ascii
from glyphmatch.options import METHODS, options

INF = math.inf


def d(a, b, method, **how):
    return float(kernels.distances(codes_of([a]), codes_of([b]), options(method, **how))[0])


@pytest.mark.parametrize("method", ["osa", "lv", "dl", "lcs"])
def test_empty_strings(method):
    assert [d(*p, method) for p in (("", ""), ("", "a"), ("a", ""), ("a", "a"))] == [0, 1, 1, 0]


@pytest.mark.parametrize(
    ("a", "b", "method", "how", "expected"),
    [
        ("ab", "aba", "osa", {}, 1),
        ("ab", "ba", "osa", {}, 1),
        ("ca", "abc", "osa", {}, 3),
        ("ca", "abc", "dl", {}, 2),
        ("b", "a", "lcs", {}, 2),
        ("leia", "leela", "lv", {"weight": (0.1, 1, 1)}, 1.1),
        ("leia", "leela", "lv", {"weight": (1, 0.1, 1)}, 2),
        ("aa", "a", "hamming", {}, INF),
        ("a", "aa", "hamming", {}, INF),
        ("", "", "qgram", {"q": 0}, 0),
        ("", "a", "qgram", {}, 1),
        ("b", "a", "qgram", {}, 2),
        ("aaa", "abc", "cosine", {}, 1 - 1 / math.sqrt(3)),
        ("aaa", "abc", "cosine", {"q": 2}, 1),
        ("abc", "abcabc", "cosine", {}, 0),
        ("ab", "ab", "cosine", {}, 0),
        ("aaa", "abc", "jaccard", {}, 2 / 3),
        ("aaa", "abc", "jaccard", {"q": 2}, 1),
        ("a", "", "jw", {}, 1),
        ("", "", "jw", {}, 0),
        ("a", "b", "jw", {}, 1),
        ("RICK WARREN", "WARREN BUFFET", "jw", {}, 1 - (7 / 13 + 7 / 11 + 3.5 / 7) / 3),
        ("axiou", "aaeeiioouu", "jw", {}, 1 - (4 / 5 + 4 / 10 + 1) / 3),
        ("abcdeu", "abxde", "jw", {}, 1 - (4 / 6 + 4 / 5 + 1) / 3),
        ("crate", "trace", "jw", {"weight": (0.5, 1, 1)}, 1 - (0.5 * 3 / 5 + 3 / 5 + 1) / 3),
        ("crate", "trace", "jw", {"weight": (1, 1, 0.5)}, 1 - (3 / 5 + 3 / 5 + 0.5) / 3),
    ],
)
def test_values(a, b, method, how, expected):
    assert d(a, b, method, **how) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("method", ["osa", "lv", "dl"])
def test_weights_by_position(method):
    assert d("a", "ab", method, weight=(0.5, 1, 1, 1)) == 0.5
    assert d("ab", "a", method, weight=(1, 0.5, 1, 1)) == 0.5
    assert d("b", "a", method, weight=(1, 1, 0.5, 1)) == 0.5
    assert d("", "aa", method, weight=(0.5, 1, 1, 1)) == 1
    if method != "lv":
        assert d("ca", "ac", method, weight=(1, 1, 1, 0.5)) == 0.5


@pytest.mark.parametrize(("a", "b", "sim"), [("martha", "marhta", 0.944), ("dixon", "dicksonx", 0.767), ("duane", "dwayne", 0.822)])
def test_jaro(a, b, sim):
    assert 1 - d(a, b, "jw") == pytest.approx(sim, abs=5e-4)


@pytest.mark.parametrize(("a", "b", "expected"), [("martha", "marhta", 0.039), ("dwayne", "duane", 0.16), ("dixon", "dicksonx", 0.187)])
def test_winkler(a, b, expected):
    assert d(a, b, "jw", p=0.1) == pytest.approx(expected, abs=5e-4)
    assert d("john doe", "jane doe", "jw", p=0.1, bt=0) == d("john doe", "jane doe", "jw", p=0.1, bt=0.1)
    assert d("john doe", "jane doe", "jw", p=0.1, bt=0.1) < d("john doe", "jane doe", "jw", p=0.1, bt=0.8)


def brute_edit(b, a, w, method):
    """Cost of turning b into a by the recurrences, cell by cell."""
    D, I, S, T = w
    h = {(i, j): (j * I if i == 0 else i * D) for i in range(len(b) + 1) for j in range(len(a) + 1) if not i or not j}
    last = {}
    for i in range(1, len(b) + 1):
        column = 0
        for j in range(1, len(a) + 1):
            equal = b[i - 1] == a[j - 1]
            best = min(h[i - 1, j] + D, h[i, j - 1] + I, h[i - 1, j - 1] + (0 if equal else S))
            if method == "osa" and i > 1 and j > 1 and b[i - 1] == a[j - 2] and b[i - 2] == a[j - 1]:
                best = min(best, h[i - 2, j - 2] + (0 if equal else T))
            if method == "dl":
                k, m = last.get(a[j - 1], 0), column
                swap = h[k - 1, m - 1] + ((i - k - 1) + (j - m - 1) + 1) * T if k and m else INF
                best = min(swap, h[i - 1, j - 1]) if equal else min(best, swap)
            h[i, j] = best
            if equal:
                column = j
        last[b[i - 1]] = i
    return h[len(b), len(a)]


@pytest.mark.parametrize("method", ["osa", "lv", "dl"])
@pytest.mark.parametrize("weight", [(1, 1, 1, 1), (0.5, 1, 0.75, 0.25), (0.1, 0.9, 0.3, 1)])
def test_edit_distances_by_brute_force(method, weight):
    rng = random.Random(5)
    alphabet = ["a", "b", "c", "ö", "😀"]
    a = ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(300)]
    b = ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(300)]
    found = kernels.distances(from_texts(a), from_texts(b), options(method, weight=weight))
    assert found.tolist() == pytest.approx([brute_edit(y, x, weight, method) for x, y in zip(a, b)])


@pytest.mark.parametrize("method", [m for m in METHODS if m != "soundex"])
def test_random_strings_are_symmetric_and_finite(method):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(32, 1200, rng.integers(0, 51)))) for _ in range(120)]
    a, b = texts[:60], texts[60:]
    for q in (0, 1, 3):
        x, y = (kernels.distances(from_texts(p), from_texts(r), options(method, q=q)) for p, r in ((a, b), (b, a)))
        assert np.array_equal(np.nan_to_num(x, nan=-1), np.nan_to_num(y, nan=-1)) or method == "jw"
        assert (kernels.distances(from_texts(a), from_texts(a), options(method, q=q)) == 0).all()
    assert not len(kernels.distances(from_texts([]), from_texts([]), options(method)))


def test_columns_nulls_and_bytes(spark):
    rows = [("Motörhead", "Motorhead"), (None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    for method in METHODS:
        found = [r[0] for r in df.select(text_distance("a", "b", method)).collect()]
        assert found[1] is None and found[2] is None and found[3] == 0
    expected = {"dl": 2, "osa": 2, "lv": 2, "hamming": INF, "lcs": 3}
    for method, value in expected.items():
        assert df.select(text_distance("a", "b", method, use_bytes=True)).first()[0] == value
    assert df.select(text_distance("a", "b", "qgram", q=3, use_bytes=True)).first()[0] == 7


def test_native_and_batch_agree(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choices("abcö😀", k=rng.randint(0, 7))), "".join(rng.choices("abcö😀", k=rng.randint(0, 7)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    for method in ("lv", "hamming", "jaccard"):
        native = [r[0] for r in df.select(text_distance("a", "b", method, q=2)).collect()]
        batch = kernels.distances(from_texts([a for a, _ in rows]), from_texts([b for _, b in rows]), options(method, q=2))
        assert native == pytest.approx(batch.tolist())


@pytest.mark.parametrize(
    ("method", "chars", "in_bytes"),
    [("osa", 1 / 2, 1 / 3), ("lv", 1 / 2, 1 / 3), ("dl", 1 / 2, 1 / 3), ("hamming", 1 / 2, 0), ("lcs", 1 / 2, 2 / 5), ("qgram", 1 / 2, 2 / 5), ("cosine", 1 / 2, 1 / math.sqrt(6)), ("jaccard", 1 / 3, 1 / 4), ("jw", 2 / 3, (1 / 2 + 1 / 3 + 1) / 3)],
)
def test_similarity(spark, method, chars, in_bytes):
    df = spark.createDataFrame([("ao", "aö"), ("bb", "cc"), ("bb", "bb")], "a string, b string")
    assert [r[0] for r in df.select(text_similarity("a", "b", method)).collect()] == pytest.approx([chars, 0, 1])
    assert df.select(text_similarity("a", "b", method, use_bytes=True)).first()[0] == pytest.approx(in_bytes)


def test_qgram_similarity_without_room_is_undefined(spark):
    df = spark.createDataFrame([("a", "a")], "a string, b string")
    assert math.isnan(df.select(text_similarity("a", "b", "qgram", q=2)).first()[0])


def test_phonetic(spark):
    codes = {
        "Robert": "R163", "rupert": "R163", "Rubin": "R150", "Ashcraft": "A261", "asHCroft": "A261", "Tymczak": "T522", "Pfister": "P236", "gutierrez": "G362",
        "Jackson": "J250", "washington": "W252", "Lee": "L000", "": "0000", "s s": "S000", "0abc": "0120", "Motörhead": "M3?6",
    }
    df = spark.createDataFrame([(k,) for k in codes], "s string")
    assert {r[0]: r[1] for r in df.select("s", phonetic("s")).collect()} == codes
    assert spark.sql("select cast(null as string) s").select(phonetic("s")).first()[0] is None
    pairs = [("", "0000"), ("john", "jan"), ("schoen", "son"), ("r00d", "rt"), ("rhw", "r"), ("sock", "sck")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(text_distance("a", "b", "soundex")).collect()] == [0, 0, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        phonetic("s", "other")


def test_printable_ascii(spark):
    df = spark.createDataFrame([("abc ~",), ("a\n",), ("ö",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(printable_ascii("s")).collect()] == [True, False, False, True, True]


@pytest.mark.parametrize(
    ("a", "b", "method", "how", "expected"),
    [([1, 2, 3], [2, 1, 3], "osa", {}, 1), ([1, 2, 3], [2, 1, 3], "lv", {}, 2), ([2, 1], [1, 3, 2], "dl", {}, 2), ([1, 2, 3], [1, 0, 3], "hamming", {}, 1), ([1, 2, 3], [1, 0, 3], "lcs", {}, 2), ([1, 2, 3], [1, 0, 3], "qgram", {"q": 2}, 4), ([], [], "osa", {}, 0), ([None], [1], "osa", {}, None)],
)
def test_sequences(spark, a, b, method, how, expected):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert df.select(seq_dist("a", "b", method, **how)).first()[0] == expected


def test_sequences_equal_strings(spark):
    rng = random.Random(2)
    rows = [([rng.randint(97, 100) for _ in range(rng.randint(0, 6))], [rng.randint(97, 100) for _ in range(rng.randint(0, 6))]) for _ in range(60)]
    df = spark.createDataFrame([(a, b, "".join(map(chr, a)), "".join(map(chr, b))) for a, b in rows], "a array<int>, b array<int>, s string, t string")
    for method in ("osa", "dl", "lcs", "jw", "hamming", "jaccard", "qgram"):
        got = df.select(seq_dist("a", "b", method).alias("x"), text_distance("s", "t", method).alias("y"), seq_sim("a", "b", method).alias("u"), text_similarity("s", "t", method).alias("v")).collect()
        assert [r.x for r in got] == pytest.approx([r.y for r in got]) and [r.u for r in got] == pytest.approx([r.v for r in got], nan_ok=True)
    with pytest.raises(ValueError):
        seq_dist("a", "b", "soundex")


@pytest.mark.parametrize("how", [{"weight": (0, 1, 1, 1)}, {"weight": (2, 1, 1, 1)}, {"weight": (1, 1)}, {"q": -1}, {"p": 0.3}, {"nthread": 0}, {"nthread": "two"}, {"method": "nothing"}, {"use_bytes": "yes"}])
def test_argument_errors(how):
    with pytest.raises(ValueError):
        options(**how)


def test_method_by_its_start():
    assert options("h").method == "hamming" and options("jw").method == "jw"
    with pytest.raises(ValueError):
        options("running_cosine")
