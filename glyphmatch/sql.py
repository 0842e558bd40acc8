"""The functions under SQL names."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .functions.encode import from_texts
from .functions.phonetic import LETTER_CLASSES
from .options import METHODS, Options, options

#: Parameters that take their usual values where they are left out.
_HOW = "method string default 'osa', weight array<double> default null, q int default 1, p double default 0.0, bt double default 0.0, use_bytes boolean default false"


def _compared(a: list[str], b: list[str], o: Options) -> np.ndarray:
    if o.use_bytes:
        a, b = ([x.encode().decode("latin-1") for x in side] for side in (a, b))
    return kernels.distances(from_texts(a), from_texts(b), o)


def _by_options(columns: list[list]) -> dict[Options, list[int]]:
    """Rows by their checked options; there is mostly one kind in a batch."""
    kinds, known = defaultdict(list), {}
    for row, how in enumerate(zip(*columns)):
        key = (how[0], tuple(how[1]) if how[1] is not None else None, *how[2:])
        if key not in known:
            known[key] = options(key[0], key[1], *key[2:])
        kinds[known[key]].append(row)
    return kinds


def _distances(a: list, b: list, how: list[list]) -> list[float | None]:
    found: list[float | None] = [None] * len(a)
    for o, rows in _by_options(how).items():
        rows = [r for r in rows if a[r] is not None and b[r] is not None]
        for r, d in zip(rows, _compared([a[r] for r in rows], [b[r] for r in rows], o).tolist() if rows else ()):
            found[r] = d
    return found


def _nearest(x: list, tables: list, most: list, how: list[list]) -> list[int | None]:
    """Position from 1 of the nearest entry of each row's table, the first on ties; a null meets a null."""
    found: list[int | None] = [None] * len(x)
    for o, rows in _by_options(how).items():
        for r in rows:
            entries = tables[r] or []
            if x[r] is None:
                found[r] = next((k for k, t in enumerate(entries, 1) if t is None), None)
                continue
            places = [k for k, t in enumerate(entries) if t is not None]
            if places:
                d = _compared([entries[k] for k in places], [x[r]] * len(places), o)
                d = np.where(np.isnan(d) | (d > most[r]), np.inf, np.where(np.abs(d) < 1e-14, 0, d))
                k = int(d.argmin())
                found[r] = places[k] + 1 if d[k] < np.inf else None
    return found


def _triangles(values: list, how: list[list]) -> list[list[float | None] | None]:
    """Distances of the pairs i > j of each row's values, column by column, where the cost runs from i to j."""
    found: list[list[float | None] | None] = [None] * len(values)
    for o, rows in _by_options(how).items():
        for r in rows:
            if (v := values[r]) is not None:
                pairs = [(i, j) for j in range(len(v)) for i in range(j + 1, len(v))]
                found[r] = _distances([v[j] for _, j in pairs], [v[i] for i, _ in pairs], [[x] * len(pairs) for x in (o.method, o.weight, o.q, o.p, o.bt, o.use_bytes)])
    return found


def register(spark: SparkSession) -> None:
    """SQL names, with the options of the Python functions as parameters that can be left out or named.

    sd_distance, sd_similarity (a, b, ...); sd_amatch(x, table, max_dist, ...): position in an array; sd_lower_tri(values, ...): the distances of an array's
    pairs; sd_qgrams(s, q): counts; sd_{method}(a, b) for each method at its defaults; sd_phonetic(s, use_bytes), sd_printable_ascii(s), sd_afind(text, pattern).
    The parameters `...` are method, weight, q, p, bt and use_bytes.
    """
    from .operators.search import best_windows

    def publish(name: str, returns: str, of, inputs: int) -> None:
        arguments = [f"c{k}" for k in range(inputs)]
        scope = {"of": of}
        exec(f"def run({', '.join(arguments)}): return of({', '.join(arguments)})", scope)  # noqa: S102  an Arrow function needs its own parameters
        scope["run"].__annotations__ = dict.fromkeys([*arguments, "return"], pa.Array)
        spark.udf.register(name, F.arrow_udf(scope["run"], returns))

    lists = lambda columns: [c.to_pylist() for c in columns]
    publish("sd_kernel", "double", lambda a, b, *how: pa.array(_distances(a.to_pylist(), b.to_pylist(), lists(how)), pa.float64(), from_pandas=False), 8)
    publish("sd_nearest", "int", lambda x, t, most, *how: pa.array(_nearest(x.to_pylist(), t.to_pylist(), most.to_pylist(), lists(how)), pa.int32()), 9)
    publish("sd_triangle", "array<double>", lambda v, *how: pa.array(_triangles(v.to_pylist(), lists(how)), pa.list_(pa.float64())), 7)
    publish("sd_afind", "location int, distance double", lambda x, y: best_windows(x.to_pylist(), y.to_pylist(), [y_ and len(y_) if y_ != "" else 0 for y_ in y.to_pylist()], options("osa")), 2)

    def counted(s: pa.Array, q: pa.Array) -> pa.Array:
        of = lambda x, n: list(Counter(x[k : k + n] for k in range(len(x) - n + 1)).items()) if n else [("", 1)] if x == "" else []
        return pa.array([None if x is None else of(x, n) for x, n in zip(s.to_pylist(), q.to_pylist())], pa.map_(pa.string(), pa.int64()))

    publish("sd_counts", "map<string,bigint>", counted, 2)
    letters, classes = "abcdefghijklmnopqrstuvwxyz", LETTER_CLASSES
    define = lambda signature, returns, body: spark.sql(f"create or replace temporary function {signature} returns {returns} return {body}")
    define(
        "sd_code(s string)",
        "string",
        "(select case when s is null then null when s = '' then '0000' else "
        "(case when translate(substring(s, 1, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + letters + "') rlike '[a-z]' then upper(substring(s, 1, 1)) else substring(s, 1, 1) end) || "
        "rpad(substring(replace(substring(regexp_replace(translate(substring(c, 1, 1), 'h', 'a') || replace(substring(c, 2), 'h', ''), r'(.)\\1+', '$1'), 2), 'a', ''), 1, 3), 3, '0') end "
        "from (select translate(regexp_replace(translate(regexp_replace(translate(s, '?', '!'), '[^ -~]', '?'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + letters + "'), '[^a-z?]', 'h'), '" + letters + "', '" + classes + "') c))",
    )
    in_bytes = lambda s: f"if(use_bytes, decode(encode({s}, 'UTF-8'), 'ISO-8859-1'), {s})"
    how = "method, weight, q, p, bt, use_bytes"
    define("sd_phonetic(s string, use_bytes boolean default false)", "string", f"sd_code({in_bytes('s')})")
    define("sd_printable_ascii(s string)", "boolean", "coalesce(not rlike(s, '[^ -~]'), true)")
    define(f"sd_distance(a string, b string, {_HOW})", "double", f"if(method = 'soundex', if(sd_code({in_bytes('a')}) = sd_code({in_bytes('b')}), 0d, 1d) + if(a is null or b is null, null, 0d), sd_kernel(a, b, if(method = 'soundex', 'osa', method), weight, q, p, bt, use_bytes))")
    size = lambda s: f"if(use_bytes, octet_length({s}), char_length({s}))"
    x, y = size("a"), size("b")
    most = f"case when method in ('osa', 'lv', 'dl') then greatest({x}, {y}, 1) when method = 'hamming' then greatest({x}, 1) when method = 'lcs' then greatest({x} + {y}, 1) when method = 'qgram' then if({x} + {y} - 2 * q + 2 < 0, 1, {x} + {y} - 2 * q + 2) else 1 end"
    define("sd_share(d double, most double)", "double", "case when most = 0 then if(d = 0, double('NaN'), 0d) when isnan(1 - d / most) then double('NaN') else greatest(1 - d / most, 0d) end")
    define(f"sd_similarity(a string, b string, {_HOW})", "double", f"sd_share(sd_distance(a, b, {how}), double({most}))")
    define(f"sd_amatch(x string, entries array<string>, max_dist double default 0.1, {_HOW})", "int", f"sd_nearest(x, entries, max_dist, {how})")
    define(f"sd_lower_tri(entries array<string>, {_HOW})", "array<double>", f"sd_triangle(entries, {how})")
    define("sd_qgrams(s string, q int default 1)", "map<string, bigint>", "sd_counts(s, q)")
    native = {
        "lv": "double(levenshtein(a, b))",
        "hamming": "if(char_length(a) != char_length(b), double('Infinity'), double(aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> if(x = y, 0, 1)), 0, (n, d) -> n + d)))",
        "jaccard": "1 - coalesce(try_divide(size(array_intersect(filter(split(a, ''), c -> c != ''), filter(split(b, ''), c -> c != ''))), size(array_union(filter(split(a, ''), c -> c != ''), filter(split(b, ''), c -> c != '')))), if(a is null or b is null, null, 1))",
        "soundex": "if(a is null or b is null, null, if(sd_code(a) = sd_code(b), 0d, 1d))",
    }
    for method in METHODS:
        define(f"sd_{method}(a string, b string)", "double", native.get(method, f"sd_distance(a, b, '{method}')"))
