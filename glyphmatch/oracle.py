"""SQL of the distances for DuckDB, made from their definitions: an independent check of the operators."""

from __future__ import annotations


class Text:
    """Access to a string's characters in SQL."""

    @staticmethod
    def size(s: str) -> str:
        return f"length({s})"

    @staticmethod
    def at(s: str, k: str) -> str:
        return f"substr({s}, {k}, 1)"

    @staticmethod
    def gram(s: str, k: str, q: int) -> str:
        return f"substr({s}, {k}, {q})"


class Items:
    """Access to a list's elements in SQL."""

    @staticmethod
    def size(s: str) -> str:
        return f"len({s})"

    @staticmethod
    def at(s: str, k: str) -> str:
        return f"{s}[{k}]"

    @staticmethod
    def gram(s: str, k: str, q: int) -> str:
        return f"{s}[{k}:{k} + {q - 1}]"


def edit(a: str, b: str, weight: tuple = (1, 1, 1, 1), swaps: bool = False, changes: bool = True, of=Text) -> str:
    """Cost of turning b into a: rows of the table are lists, reduced over b, each reduced over a."""
    d, i, s, t = weight
    j, k = "x[1]::INT", "e.now[1]::INT"
    change = f"CASE WHEN {of.at(a, j)} = {of.at(b, k)} THEN 0 ELSE {s if changes else 1e9} END"
    options = [f"r[len(r)] + {i}", f"acc.now[{j} + 1] + {d}", f"acc.now[{j}] + {change}"]
    if swaps:
        crossed = f"{k} > 1 AND {j} > 1 AND {of.at(a, j)} = {of.at(b, k + ' - 1')} AND {of.at(a, j + ' - 1')} = {of.at(b, k)}"
        same = f"{of.at(a, j)} = {of.at(b, k)}"
        options.append(f"CASE WHEN {crossed} THEN acc.before[{j} - 1] + CASE WHEN {same} THEN 0 ELSE {t} END ELSE 1e9 END")
    row = f"list_reduce(list_transform(range(1, {of.size(a)} + 1), lambda y: [y::DOUBLE]), lambda r, x: list_append(r, least({', '.join(options)})), [e.now[1] * {d}::DOUBLE])"
    start = f"{{'before': []::DOUBLE[], 'now': list_transform(range(0, {of.size(a)} + 1), lambda y: (y * {i})::DOUBLE)}}"
    steps = f"list_transform(range(1, {of.size(b)} + 1), lambda y: {{'before': []::DOUBLE[], 'now': [y::DOUBLE]}})"
    return f"(list_reduce({steps}, lambda acc, e: {{'before': acc.now, 'now': {row}}}, {start})).now[{of.size(a)} + 1]"


def damerau(a: str, b: str, weight: tuple = (1, 1, 1, 1)) -> str:
    """Weighted Damerau-Levenshtein from b to a: rows of the table are gathered in a list, the last equal letters looked up in the texts."""
    delete, insert, change, swap = weight
    letter = lambda s, k: f"substr({s}, {k}, 1)"
    i, j = "e[1][1]::INT", "f[1]::INT"
    last_i = f"list_max(list_filter(range(1, {i}), lambda k: {letter(b, 'k::INT')} = {letter(a, j)}))::INT"
    last_j = f"list_max(list_filter(range(1, {j}), lambda k: {letter(a, 'k::INT')} = {letter(b, i)}))::INT"
    swapped = f"coalesce(rows[{last_i}][{last_j}] + (({i} - {last_i} - 1) + ({j} - {last_j} - 1) + 1) * {swap}, 1e9)"
    value = f"CASE WHEN {letter(b, i)} = {letter(a, j)} THEN least(rows[{i}][{j}], {swapped}) ELSE least({swapped}, rows[{i}][{j} + 1] + {delete}, acc[{j}] + {insert}, rows[{i}][{j}] + {change}) END"
    row = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda y: [y::DOUBLE]), lambda acc, f: list_append(acc, ({value})::DOUBLE), [({i} * {delete})::DOUBLE])"
    first = f"list_transform(range(0, length({a}) + 1), lambda y: (y * {insert})::DOUBLE)"
    return f"list_reduce(list_transform(range(1, length({b}) + 1), lambda y: [[y::DOUBLE]]), lambda rows, e: list_append(rows, {row}), [{first}])[-1][-1]"


def hamming(a: str, b: str, of=Text) -> str:
    differing = f"coalesce(list_sum(list_transform(range(1, {of.size(a)} + 1), lambda y: CASE WHEN {of.at(a, 'y')} = {of.at(b, 'y')} THEN 0 ELSE 1 END)), 0)"
    return f"CASE WHEN {of.size(a)} <> {of.size(b)} THEN 'Infinity'::DOUBLE ELSE {differing}::DOUBLE END"


def grams(s: str, q: int, of=Text) -> str:
    return f"list_transform(range(1, {of.size(s)} - {q} + 2), lambda y: {of.gram(s, 'y', q)})"


def gram_distance(a: str, b: str, method: str, q: int, of=Text) -> str:
    ga, gb = grams(a, q, of), grams(b, q, of)
    kinds = f"list_distinct(list_concat({ga}, {gb}))"
    na, nb = (f"len(list_filter({g}, lambda z: z = g))" for g in (ga, gb))
    total = lambda inner: f"coalesce(list_sum(list_transform({kinds}, lambda g: {inner})), 0)"
    if method == "qgram":
        return f"{total(f'abs({na} - {nb})')}::DOUBLE"
    if method == "jaccard":
        both = total(f"CASE WHEN {na} > 0 AND {nb} > 0 THEN 1 ELSE 0 END")
        return f"CASE WHEN len({kinds}) = 0 THEN 0 ELSE 1 - {both}::DOUBLE / len({kinds}) END"
    return f"abs(1 - {total(f'{na} * {nb}')}::DOUBLE / (sqrt({total(f'{na} * {na}')}::DOUBLE) * sqrt({total(f'{nb} * {nb}')}::DOUBLE)))"


def jaro(source: str, a: str, b: str, weight: tuple = (1, 1, 1), p: float = 0.0, bt: float = 0.0) -> str:
    """A query (of all columns of `source`, and `jw`): matches of b's characters in a are gathered in a list of 1000 * place + place."""
    span = f"greatest(greatest(length({a}), length({b})) // 2 - 1, 0)"
    i = "e[1]::INT"
    free = f"list_filter(range(greatest(1, {i} - span), least(length({a}), {i} + span) + 1), lambda j: substr({a}, j, 1) = substr({b}, {i}, 1) AND NOT list_contains(list_transform(acc, lambda v: v % 1000), j))"
    met = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda y: [y::BIGINT]), lambda acc, e: list_concat(acc, list_transform(({free})[1:1], lambda j: {i} * 1000 + j)), []::BIGINT[])"
    moved = f"0.5 * coalesce(list_sum(list_transform(range(1, len(met) + 1), lambda y: CASE WHEN substr({b}, (met[y] // 1000)::INT, 1) = substr({a}, list_sort(list_transform(met, lambda v: v % 1000))[y]::INT, 1) THEN 0 ELSE 1 END)), 0)"
    d = f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 0.0 WHEN len(met) = 0 THEN 1.0 ELSE 1 - ({weight[0]} * len(met)::DOUBLE / length({a}) + {weight[1]} * len(met)::DOUBLE / length({b}) + {weight[2]} * (len(met) - {moved}) / len(met)) / 3 END"
    common = f"len(list_filter(range(1, least(length({a}), length({b}), 4) + 1), lambda y: substr({a}, 1, y::INT) = substr({b}, 1, y::INT)))"
    boosted = f"CASE WHEN d > {bt} THEN d - {common} * {p} * d ELSE d END" if p > 0 else "d"
    return f"SELECT *, {boosted} AS jw FROM (SELECT *, {d} AS d FROM (SELECT *, {met} AS met FROM (SELECT *, {span} AS span FROM {source})))"


def soundex(s: str) -> str:
    """Code of a text that isn't null; runs are collapsed letter by letter."""
    upper, lower, classes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "a123a12ha22455a12623a1h2a2"
    seen = f"translate(regexp_replace(translate(regexp_replace(translate({s}, '?', '!'), '[^ -~]', '?', 'g'), '{upper}', '{lower}'), '[^a-z?]', 'h', 'g'), '{lower}', '{classes}')"
    joined = f"translate(substr({seen}, 1, 1), 'h', 'a') || replace(substr({seen}, 2), 'h', '')"
    for c in "a123456":
        joined = f"regexp_replace({joined}, '{c}+', '{c}', 'g')"
    joined = f"regexp_replace({joined}, '[?]+', '?', 'g')"
    first = f"CASE WHEN regexp_matches(substr({s}, 1, 1), '[a-z]') THEN upper(substr({s}, 1, 1)) ELSE substr({s}, 1, 1) END"
    return f"CASE WHEN {s} = '' THEN '0000' ELSE {first} || rpad(substr(replace(substr({joined}, 2), 'a', ''), 1, 3), 3, '0') END"


def similarity(d: str, a: str, b: str, method: str, q: int = 1, of=Text) -> str:
    x, y = of.size(a), of.size(b)
    most = {
        "osa": f"greatest({x}, {y}, 1)",
        "lv": f"greatest({x}, {y}, 1)",
        "dl": f"greatest({x}, {y}, 1)",
        "hamming": f"greatest({x}, 1)",
        "lcs": f"greatest({x} + {y}, 1)",
        "qgram": f"(CASE WHEN {x} + {y} - {2 * q} + 2 < 0 THEN 1 ELSE {x} + {y} - {2 * q} + 2 END)",
    }.get(method, "1")
    return f"greatest(0, 1 - ({d}) / {most})"


def latin(s: str) -> str:
    """The text with a character for each byte of its UTF-8 form."""
    hexed = f"hex(encode({s}))"
    return f"array_to_string(list_transform(range(0, length({hexed}) // 2), lambda y: chr(('0x' || substr({hexed}, y::INT * 2 + 1, 2))::INT)), '')"
