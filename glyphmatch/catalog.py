"""Registered queries over the driver tables and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .functions.metrics import seq_dist, seq_sim, text_distance, text_similarity
from .functions.phonetic import phonetic, printable_ascii
from .operators import grams, match, pairs, search
from .sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Distances are compared to this many digits.
DIGITS = 9
_NAMES = "n AS (SELECT DISTINCT p_name AS s FROM part)"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


# ---- distances and similarities of all pairs of part names ----


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names repeat over parts; distinct ones are paired, dealt over the tasks."""
    names = table(spark, sf_dir, "part", "p_name").distinct()
    return pairs._spread(names.select(F.col("p_name").alias("a"))).crossJoin(pairs._small(names.select(F.col("p_name").alias("b"))))


def _pair_query(of: Callable[[str, str], Column], name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _name_pairs(spark, sf_dir).select("a", "b", F.round(of("a", "b"), DIGITS).alias(name))


def _pair_sql(value: str, name: str) -> str:
    return f"WITH {_NAMES} SELECT x.s AS a, y.s AS b, round({value}, {DIGITS})::DOUBLE AS {name} FROM n x, n y"


_SQL_OF: dict[str, Callable[..., str]] = {
    "osa": lambda a, b, of=oracle.Text, weight=(1, 1, 1, 1), q=1: oracle.edit(a, b, weight, swaps=True, of=of),
    "lv": lambda a, b, of=oracle.Text, weight=(1, 1, 1, 1), q=1: oracle.edit(a, b, weight, of=of),
    "lcs": lambda a, b, of=oracle.Text, weight=None, q=1: oracle.edit(a, b, changes=False, of=of),
    "hamming": lambda a, b, of=oracle.Text, weight=None, q=1: oracle.hamming(a, b, of),
    "qgram": lambda a, b, of=oracle.Text, weight=None, q=1: oracle.gram_distance(a, b, "qgram", q, of),
    "cosine": lambda a, b, of=oracle.Text, weight=None, q=1: oracle.gram_distance(a, b, "cosine", q, of),
    "jaccard": lambda a, b, of=oracle.Text, weight=None, q=1: oracle.gram_distance(a, b, "jaccard", q, of),
    "soundex": lambda a, b, of=oracle.Text, weight=None, q=1: f"(CASE WHEN {oracle.soundex(a)} = {oracle.soundex(b)} THEN 0.0 ELSE 1.0 END)",
    "dl": lambda a, b, of=oracle.Text, weight=None, q=1: f"damerau_levenshtein({a}, {b})",  # of bytes: exact for ASCII
}

for _name, _method, _how in (
    ("dist_osa", "osa", {}),
    ("dist_lv", "lv", {}),
    ("dist_dl", "dl", {}),
    ("dist_lcs", "lcs", {}),
    ("dist_lv_weighted", "lv", {"weight": (0.5, 0.25, 0.75, 1)}),
    ("dist_osa_weighted", "osa", {"weight": (0.5, 1, 0.75, 0.25)}),
    ("dist_qgram_q2", "qgram", {"q": 2}),
    ("dist_cosine_q2", "cosine", {"q": 2}),
    ("dist_jaccard_q2", "jaccard", {"q": 2}),
    ("dist_soundex", "soundex", {}),
):
    _add(_name, _pair_query(lambda a, b, m=_method, h=_how: text_distance(a, b, m, **h), "dist"), _pair_sql(_SQL_OF[_method]("x.s", "y.s", **_how), "dist"))

_add("dist_qgram_q0", _pair_query(lambda a, b: text_distance(a, b, "qgram", q=0), "dist"), _pair_sql("0", "dist"))
_add("dist_dl_weighted", _pair_query(lambda a, b: text_distance(a, b, "dl", weight=(1, 1, 1, 0.5)), "dist"), _pair_sql(oracle.damerau("x.s", "y.s", (1, 1, 1, 0.5)), "dist"))

for _name, _how in (("dist_jaro", {}), ("dist_jw_p01", {"p": 0.1}), ("dist_jw_bt", {"p": 0.1, "bt": 0.3}), ("dist_jw_weighted", {"weight": (0.5, 1, 0.75)})):
    _query = oracle.jaro("(SELECT x.s AS a, y.s AS b FROM n x, n y)", "a", "b", **_how)
    _add(_name, _pair_query(lambda a, b, h=_how: text_distance(a, b, "jw", **h), "dist"), f"WITH {_NAMES} SELECT a, b, round(jw, {DIGITS})::DOUBLE AS dist FROM ({_query})")
_query = oracle.jaro("(SELECT x.s AS a, y.s AS b FROM n x, n y)", "a", "b")
_add("sim_jw", _pair_query(lambda a, b: text_similarity(a, b, "jw"), "sim"), f"WITH {_NAMES} SELECT a, b, round(1 - jw, {DIGITS})::DOUBLE AS sim FROM ({_query})")

for _method in ("osa", "lv", "dl", "lcs", "qgram", "cosine", "jaccard", "soundex"):
    _q = 2 if _method in ("qgram", "cosine", "jaccard") else 1
    _add(f"sim_{_method}", _pair_query(lambda a, b, m=_method, q=_q: text_similarity(a, b, m, q=q), "sim"), _pair_sql(oracle.similarity(_SQL_OF[_method]("x.s", "y.s", q=_q), "x.s", "y.s", _method, _q), "sim"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name with the next one's by key: names of one size."""
    names = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    other = names.select((F.col("c_custkey") - F.lit(1)).alias("c_custkey"), F.col("c_name").alias("b"))
    return names.withColumnRenamed("c_name", "a").join(other, "c_custkey")


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands on each line of an order with what stands on the next: pairs that grow with the tables."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part", "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("a"))
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_partkey").alias("q_partkey"))
    met = lines.join(following, ["l_orderkey", "l_linenumber"]).join(parts, "p_partkey")
    return met.join(parts.select(F.col("p_partkey").alias("q_partkey"), F.col("a").alias("b")), "q_partkey").select("l_orderkey", "l_linenumber", "a", "b")


_LINES = "FROM lineitem l JOIN lineitem m ON m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber + 1 JOIN part p ON p.p_partkey = l.l_partkey JOIN part r ON r.p_partkey = m.l_partkey"
_A, _B = (f"concat_ws(' ', {t}.p_name, {t}.p_type, {t}.p_brand)" for t in "pr")
for _method, _sql in (("lv", f"levenshtein({_A}, {_B})"), ("dl", f"damerau_levenshtein({_A}, {_B})")):
    _add(
        f"lines_{_method}",
        lambda spark, sf_dir, m=_method: _line_pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", text_distance("a", "b", m).alias("dist")),
        f"SELECT l.l_orderkey, l.l_linenumber, {_sql}::DOUBLE AS dist {_LINES}",
    )

_CUSTOMERS = "FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1"
for _name, _of, _label in (("dist_hamming", text_distance, "dist"), ("sim_hamming", text_similarity, "sim")):
    _value = oracle.hamming("x.c_name", "y.c_name")
    _value = _value if _label == "dist" else oracle.similarity(_value, "x.c_name", "y.c_name", "hamming")
    _add(
        _name,
        lambda spark, sf_dir, of=_of, label=_label: _customers(spark, sf_dir).select("c_custkey", "a", "b", F.round(of("a", "b", "hamming"), DIGITS).alias(label)),
        f"SELECT x.c_custkey, x.c_name AS a, y.c_name AS b, round({_value}, {DIGITS})::DOUBLE AS {_label} {_CUSTOMERS}",
    )


def bytes_lv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's whole text with the next one's."""
    talk = table(spark, sf_dir, "conversations", "conv_id", "turn", F.col("text").alias("a"))
    following = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return talk.join(following, ["conv_id", "turn"]).select("conv_id", "turn", text_distance("a", "b", "lv", use_bytes=True).alias("dist"), F.round(text_similarity("a", "b", "lv", use_bytes=True), DIGITS).alias("sim"))


_bytes = "levenshtein(x.text, y.text)"
_add(
    "bytes_lv",
    bytes_lv,
    f"SELECT x.conv_id, x.turn, {_bytes}::DOUBLE AS dist, round(1 - {_bytes} / greatest(strlen(x.text), strlen(y.text), 1), {DIGITS})::DOUBLE AS sim FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1",
)

# ---- matrices ----


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation", F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("s"))


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part", "p_brand").distinct()
    return brands.select(F.row_number().over(Window.orderBy("p_brand")).cast("long").alias("pos"), F.col("p_brand").alias("s"))  # some tens of rows


_NATIONS = "n AS (SELECT n_nationkey::BIGINT AS pos, n_name AS s FROM nation)"
_BRANDS = "m AS (SELECT row_number() OVER (ORDER BY p_brand) AS pos, p_brand AS s FROM (SELECT DISTINCT p_brand FROM part))"
_add(
    "distmatrix",
    lambda spark, sf_dir: pairs.distance_matrix(_nations(spark, sf_dir), _brands(spark, sf_dir), method="osa", use_names="strings"),
    f"WITH {_NATIONS}, {_BRANDS} SELECT n.pos AS i, m.pos AS j, n.s AS label_i, m.s AS label_j, {oracle.edit('n.s', 'm.s', swaps=True)} AS dist FROM n, m",
)
_add(
    "distmatrix_lower",
    lambda spark, sf_dir: pairs.distance_matrix(_brands(spark, sf_dir), method="lv", weight=(0.5, 1, 0.75)),
    f"WITH {_BRANDS} SELECT x.pos AS i, y.pos AS j, {oracle.edit('y.s', 'x.s', (0.5, 1, 0.75, 1))} AS dist FROM m x JOIN m y ON x.pos > y.pos",
)
_add(
    "simmatrix",
    lambda spark, sf_dir: pairs.similarity_matrix(_brands(spark, sf_dir), method="lv").withColumn("sim", F.round("sim", DIGITS)),
    f"WITH {_BRANDS} SELECT x.pos AS i, y.pos AS j, round(1 - levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s)), {DIGITS})::DOUBLE AS sim FROM m x, m y",
)


def recycle_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = spark.createDataFrame([(1, "red bolt"), (2, "blue widget"), (3, "small ring")], "pos long, s string")
    return pairs.pairwise(table(spark, sf_dir, "part", F.col("p_partkey").alias("pos"), F.col("p_name").alias("s")).filter("pos > 0"), three, method="lv")


_add("recycle_pairwise", recycle_pairwise, "SELECT p_partkey AS pos, levenshtein(p_name, ['red bolt', 'blue widget', 'small ring'][((p_partkey - 1) % 3) + 1])::DOUBLE AS dist FROM part WHERE p_partkey > 0")

# ---- nearest match and membership ----


def _lookup(spark: SparkSession, sf_dir: str, nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Part names without their fourth character, and the distinct names by position."""
    parts = table(spark, sf_dir, "part", F.col("p_partkey").alias("id"), F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 100)).alias("x"))
    names = table(spark, sf_dir, "part", "p_name").distinct()
    names = names.select(F.row_number().over(Window.orderBy("p_name")).cast("long").alias("pos"), F.col("p_name").alias("t"))  # 64 rows
    if nulls:
        parts = parts.withColumn("x", F.when(F.col("id") % 5 != 0, F.col("x")))
        names = names.withColumn("t", F.when(F.col("pos") % 7 != 0, F.col("t")))
    return parts, names


def _lookup_sql(nulls: bool = False) -> str:
    x, t = "substr(p_name, 1, 3) || substr(p_name, 5, 100)", "p_name"
    if nulls:
        x, t = f"CASE WHEN p_partkey % 5 <> 0 THEN {x} END", "CASE WHEN pos % 7 <> 0 THEN p_name END"
    names = "(SELECT row_number() OVER (ORDER BY p_name) AS pos, p_name FROM (SELECT DISTINCT p_name FROM part))"
    return f"l AS (SELECT p_partkey AS id, {x} AS x FROM part), m AS (SELECT pos, {t} AS t FROM {names})"


def _amatch_sql(d: str, most: float, result: str, nulls: bool = False) -> str:
    best = f"SELECT x, arg_min(pos, d * 1000000 + pos) AS pos, min(d) AS d FROM (SELECT a.x, m.pos, {d} AS d FROM (SELECT DISTINCT x FROM l WHERE x IS NOT NULL) a, m WHERE m.t IS NOT NULL) WHERE d <= {most} GROUP BY x"
    return f"WITH {_lookup_sql(nulls)}, best AS ({best}) SELECT l.id, {result} FROM l LEFT JOIN best ON l.x = best.x"


_DISTANCE = f"round(best.d, {DIGITS})::DOUBLE AS dist"
for _name, _method, _most, _how in (
    ("amatch_osa", "osa", 2, {}),
    ("amatch_lv", "lv", 1, {}),
    ("amatch_dl", "dl", 2, {}),
    ("amatch_lcs", "lcs", 3, {}),
    ("amatch_jaccard", "jaccard", 0.5, {"q": 2}),
    ("amatch_cosine", "cosine", 0.3, {"q": 2}),
    ("amatch_qgram", "qgram", 4, {"q": 2}),
    ("amatch_soundex", "soundex", 0.5, {}),
):
    _add(
        _name,
        lambda spark, sf_dir, m=_method, most=_most, h=_how: match.amatch(*_lookup(spark, sf_dir), max_dist=most, method=m, **h).withColumn("dist", F.round("dist", DIGITS)),
        _amatch_sql(f"({_SQL_OF[_method]('m.t', 'a.x', **_how)})", _most, f"best.pos AS match, {_DISTANCE}"),
    )
_add(
    "amatch_nomatch",
    lambda spark, sf_dir: match.amatch(*_lookup(spark, sf_dir), max_dist=0.5, method="lv", nomatch=0).select("id", "match"),
    _amatch_sql("levenshtein(m.t, a.x)", 0.5, "coalesce(best.pos, 0) AS match"),
)
_add(
    "amatch_null",
    lambda spark, sf_dir: match.amatch(*_lookup(spark, sf_dir, nulls=True), max_dist=2, method="osa").select("id", "match"),
    _amatch_sql(oracle.edit("m.t", "a.x", swaps=True), 2, "CASE WHEN l.x IS NULL THEN (SELECT min(pos) FROM m WHERE t IS NULL) ELSE best.pos END AS match", nulls=True),
)
_add(
    "ain_lv",
    lambda spark, sf_dir: match.ain(*_lookup(spark, sf_dir, nulls=True), max_dist=1, method="lv", match_na=False),
    _amatch_sql("levenshtein(m.t, a.x)", 1, "best.pos IS NOT NULL AS found", nulls=True),
)
_add(
    "ain_anti",
    lambda spark, sf_dir: match.ain(*_lookup(spark, sf_dir, nulls=True), max_dist=1, method="lv").filter("not found").select("id"),
    _amatch_sql("levenshtein(m.t, a.x)", 1, "best.pos, l.x", nulls=True).replace("SELECT l.id, best.pos, l.x FROM l LEFT JOIN best ON l.x = best.x", "SELECT l.id FROM l LEFT JOIN best ON l.x = best.x WHERE best.pos IS NULL AND l.x IS NOT NULL"),
)

# ---- search in texts ----

_PATTERNS = ["exmaple", "spam", "/en/1"]


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    urls = table(spark, sf_dir, "pages", F.col("page_id").alias("i"), F.col("url").alias("x"))
    return urls, spark.createDataFrame([(k, p) for k, p in enumerate(_PATTERNS, 1)], "j long, pattern string")


def _windows_sql(d: Callable[[str, str], str], patterns: list[str]) -> str:
    values = ", ".join(f"({k}, '{p}')" for k, p in enumerate(patterns, 1))
    windows = "SELECT page_id AS i, j, pattern, k, substr(url, k::INT, length(pattern)) AS w FROM pages, p, unnest(range(1, greatest(length(url) - length(pattern), 0) + 2)) AS u(k)"
    best = "SELECT i, j, k, w, d, row_number() OVER (PARTITION BY i, j ORDER BY d, k) AS r FROM (SELECT *, " + d("pattern", "w") + f" AS d FROM ({windows}))"
    return f"WITH p AS (SELECT j::BIGINT AS j, pattern FROM (VALUES {values}) v(j, pattern)), best AS (SELECT * FROM ({best}) WHERE r = 1)"


for _name, _method, _how in (("afind_osa", "osa", {}), ("afind_lv", "lv", {}), ("afind_cosine_q3", "cosine", {"q": 3}), ("afind_running_cosine_q3", "running_cosine", {"q": 3})):
    _add(
        _name,
        lambda spark, sf_dir, m=_method, h=_how: search.afind(*_search(spark, sf_dir), method=m, **h).withColumn("distance", F.round("distance", DIGITS)),
        _windows_sql(lambda a, b, m=_method, h=_how: f"round({_SQL_OF[m.removeprefix('running_')](a, b, **h)}, 12)", _PATTERNS) + f" SELECT i, j, k::INT AS location, round(d, {DIGITS})::DOUBLE AS distance, w AS match FROM best",
    )
_one = _windows_sql(_SQL_OF["osa"], ["casino"])
_add("grab", lambda spark, sf_dir: search.grab(_search(spark, sf_dir)[0], "casino", max_dist=2, value=True), f"{_one} SELECT i, w AS match FROM best WHERE d <= 2")
_add("grabl", lambda spark, sf_dir: search.grabl(_search(spark, sf_dir)[0], "casino", max_dist=2), f"{_one} SELECT i, d <= 2 AS found FROM best")
_add("extract", lambda spark, sf_dir: search.extract(_search(spark, sf_dir)[0], "casino", max_dist=2), f"{_one} SELECT i, CASE WHEN d <= 2 THEN w END AS match FROM best")

# ---- q-grams, phonetic codes, ASCII ----


def _gram_sql(q: int) -> str:
    letters = " || ".join(f"c[y + {k}]" if k else "c[y]" for k in range(q))
    return f"unnest(list_transform(range(1, len(c) - {q} + 2), lambda y: {letters}))"


_add(
    "qgrams_q2",
    lambda spark, sf_dir: grams.qgrams(table(spark, sf_dir, "part", "p_brand", "p_name"), 2, "p_brand", "p_name"),
    f"SELECT name, qgram, count(*) AS n FROM (SELECT p_brand AS name, {_gram_sql(2)} AS qgram FROM (SELECT p_brand, string_split(p_name, '') AS c FROM part)) GROUP BY ALL",
)
_add(
    "qgrams_by_lang",
    lambda spark, sf_dir: grams.qgrams(table(spark, sf_dir, "documents", "lang", "text"), 3, "lang", "text"),
    f"SELECT name, qgram, count(*) AS n FROM (SELECT lang AS name, {_gram_sql(3)} AS qgram FROM (SELECT lang, string_split(text, '') AS c FROM documents)) GROUP BY ALL",
)
_add(
    "qgrams_q0",
    lambda spark, sf_dir: grams.qgrams(table(spark, sf_dir, "part", "p_brand", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("s")), 0, "p_brand", "s"),
    "SELECT p_brand AS name, '' AS qgram, count(*) FILTER (p_partkey % 3 = 0) AS n FROM part GROUP BY p_brand",
)
_add("phonetic", lambda spark, sf_dir: table(spark, sf_dir, "conversations", "conv_id", "turn", phonetic("text").alias("code")), f"SELECT conv_id, turn, {oracle.soundex('text')} AS code FROM conversations")
_add(
    "phonetic_bytes",
    lambda spark, sf_dir: table(spark, sf_dir, "conversations", "conv_id", "turn", phonetic("text", use_bytes=True).alias("code")).filter("turn = 0"),
    f"SELECT conv_id, turn, {oracle.soundex('t')} AS code FROM (SELECT conv_id, turn, {oracle.latin('text')} AS t FROM conversations WHERE turn = 0)",
)
_add("printable_ascii", lambda spark, sf_dir: table(spark, sf_dir, "documents", "doc_id", printable_ascii("text").alias("printable")), "SELECT doc_id, NOT regexp_matches(text, '[^ -~]') AS printable FROM documents")

# ---- integer sequences: the kinds of each user's and each day's events in order ----

_KINDS = ["click", "error", "purchase", "signup", "view"]


def _sequences(spark: SparkSession, sf_dir: str, by: Column) -> DataFrame:
    """(pos, s): positions in the order of the key."""
    kind = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("event_type")).cast("int")
    events = table(spark, sf_dir, "events", by.alias("key"), "ts", "event_id", kind.alias("kind"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "kind"))), lambda e: e.kind)
    found = events.groupBy("key").agg(in_order.alias("s"))
    keys = found.select("key", F.row_number().over(Window.orderBy("key")).cast("long").alias("pos"))  # one row for each user or day
    return found.join(keys, "key").select("pos", "s")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir, F.col("user_id"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir, F.to_date("ts"))


def _sequences_sql(name: str, key: str) -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY k) AS pos, s FROM (SELECT {key} AS k, list(list_position({_KINDS}, event_type)::INT ORDER BY ts, event_id) AS s FROM events GROUP BY {key}))"


_USERS, _DAYS = _sequences_sql("v", "user_id"), _sequences_sql("t", "ts::DATE")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user with the next."""
    s = _users(spark, sf_dir)
    return s.select(F.col("pos").alias("i"), F.col("s").alias("a")).join(s.select((F.col("pos") - 1).alias("i"), F.col("pos").alias("j"), F.col("s").alias("b")), "i")


_NEIGHBOURS = "FROM v x JOIN v y ON y.pos = x.pos + 1"
for _method in ("osa", "lv", "lcs", "hamming", "qgram", "cosine", "jaccard"):
    _how = {"q": 2} if _method in ("qgram", "jaccard") else {}
    _add(
        f"seq_dist_{_method}",
        lambda spark, sf_dir, m=_method, h=_how: _neighbours(spark, sf_dir).select("i", "j", F.round(seq_dist("a", "b", m, **h), DIGITS).alias("dist")),
        f"WITH {_USERS} SELECT x.pos AS i, y.pos AS j, round({_SQL_OF[_method]('x.s', 'y.s', of=oracle.Items, **_how)}, {DIGITS})::DOUBLE AS dist {_NEIGHBOURS}",
    )
# A letter for each number: Damerau-Levenshtein of plain letters is built in, Jaro is written for texts.
_letters = "array_to_string(list_transform(s, lambda z: chr(96 + z)), '')"
_pairs_of_letters = f"SELECT x.pos AS i, y.pos AS j, x.t AS a, y.t AS b FROM (SELECT pos, {_letters} AS t FROM v) x JOIN (SELECT pos, {_letters} AS t FROM v) y ON y.pos = x.pos + 1"
for _method, _sql in (
    ("dl", f"WITH {_USERS} SELECT i, j, damerau_levenshtein(a, b)::DOUBLE AS dist FROM ({_pairs_of_letters})"),
    ("jw", f"WITH {_USERS} SELECT i, j, round(jw, {DIGITS})::DOUBLE AS dist FROM ({oracle.jaro(f'({_pairs_of_letters})', 'a', 'b')})"),
):
    _add(f"seq_dist_{_method}", lambda spark, sf_dir, m=_method: _neighbours(spark, sf_dir).select("i", "j", F.round(seq_dist("a", "b", m), DIGITS).alias("dist")), _sql)
_add(
    "seq_simmatrix",
    lambda spark, sf_dir: pairs.seq_simmatrix(_days(spark, sf_dir), _days(spark, sf_dir), method="jaccard", q=2).withColumn("sim", F.round("sim", DIGITS)),
    f"WITH {_DAYS} SELECT x.pos AS i, y.pos AS j, round(1 - {oracle.gram_distance('x.s', 'y.s', 'jaccard', 2, oracle.Items)}, {DIGITS})::DOUBLE AS sim FROM t x, t y",
)
_add(
    "seq_sim",
    lambda spark, sf_dir: _neighbours(spark, sf_dir).select("i", "j", F.round(seq_sim("a", "b", "osa"), DIGITS).alias("sim")),
    f"WITH {_USERS} SELECT x.pos AS i, y.pos AS j, round({oracle.similarity(oracle.edit('x.s', 'y.s', swaps=True, of=oracle.Items), 'x.s', 'y.s', 'osa', of=oracle.Items)}, {DIGITS})::DOUBLE AS sim {_NEIGHBOURS}",
)
_add(
    "seq_distmatrix",
    lambda spark, sf_dir: pairs.seq_distmatrix(_users(spark, sf_dir), method="jaccard", q=2).withColumn("dist", F.round("dist", DIGITS)),
    f"WITH {_USERS} SELECT x.pos AS i, y.pos AS j, round({oracle.gram_distance('x.s', 'y.s', 'jaccard', 2, oracle.Items)}, {DIGITS})::DOUBLE AS dist FROM v x JOIN v y ON x.pos > y.pos",
)
_counts = lambda name: f"{name}c AS (SELECT pos, list_transform(range(1, {len(_KINDS) + 1}), lambda k: len(list_filter(s, lambda z: z = k))::DOUBLE) AS c FROM {name})"
_cosine = "round(abs(1 - list_dot_product(vc.c, tc.c) / (sqrt(list_dot_product(vc.c, vc.c)) * sqrt(list_dot_product(tc.c, tc.c)))), 12)"
_nearest = f"WITH {_USERS}, {_DAYS}, {_counts('v')}, {_counts('t')}, near AS (SELECT vc.pos AS id, tc.pos AS tp, {_cosine} AS d FROM vc, tc), best AS (SELECT id, tp FROM (SELECT id, tp, row_number() OVER (PARTITION BY id ORDER BY d, tp) AS r FROM near WHERE d <= 0.02) WHERE r = 1)"
for _name, _of, _result in (("seq_amatch", match.seq_amatch, "best.tp AS match"), ("seq_ain", match.seq_ain, "best.tp IS NOT NULL AS found")):
    _add(
        _name,
        lambda spark, sf_dir, of=_of: of(_users(spark, sf_dir).select(F.col("pos").alias("id"), F.col("s").alias("x")), _days(spark, sf_dir).withColumnRenamed("s", "t"), max_dist=0.02, method="cosine").drop("dist"),
        f"{_nearest} SELECT v.pos AS id, {_result} FROM v LEFT JOIN best ON v.pos = best.id",
    )
_add(
    "seq_qgrams",
    lambda spark, sf_dir: grams.seq_qgrams(_users(spark, sf_dir), 2, "pos", "s").select("name", F.array_join(F.col("qgram").cast("array<string>"), ",").alias("qgram"), "n"),
    f"WITH {_USERS} SELECT name, qgram, count(*) AS n FROM (SELECT pos AS name, unnest(list_transform(range(1, len(s)), lambda y: s[y]::VARCHAR || ',' || s[y + 1]::VARCHAR)) AS qgram FROM v) GROUP BY ALL",
)
