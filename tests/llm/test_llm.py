"""The training-data operators against brute force on small tables, with the awkward rows that each must survive."""

import base64
import hashlib
import json
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmatch.llm import bpe, common, components, fingerprint, induced, line_dedup, minhash, packing, quality, queries, suffix, toxicity, url_filter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages and lines, nulls, empty, blank and long texts, in no order."""
    rng = random.Random(17)
    texts = [words_of(rng, rng.randint(1, 120)) for _ in range(60)]
    base = words_of(rng, 150).split()
    for k in range(25):
        edited = list(base)
        for at in rng.sample(range(150), k % 6):
            edited[at] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(edited))
    passage = words_of(rng, 60)
    texts += [words_of(rng, 20) + passage + words_of(rng, 20) for _ in range(8)]
    line = "a line that many documents share, more or less word for word"
    texts += ["\n".join([words_of(rng, 12), line if k % 2 else line.replace("word for word", "word by word"), "", words_of(rng, 9)]) for k in range(10)]
    texts += [texts[3]] * 4 + ["", None, " \t\n ", "ö" * 150, "ab" * 400, "é", "Und " * 60, "A b c\nA b c\nA b c", words_of(rng, 4000), "a\x1cb\x85c d", "x" * 199, "x" * 200]
    rows = [(k * 3 - 5, t, "en", "s", 0) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    """With a column too many, and one whose name clashes with those used inside."""
    clashes = ("id", "th", "_id", "_th", "id_", "place", "line", "component", "h1", "h2", "places", "anchor", "region", "cuts", "kept", "n_bytes", "n", "key", "votes", "p_good", "dropped", "bucket", "D", "r.id")
    return spark.createDataFrame(rows, DOCS).withColumns({"text_2": F.lit(None).cast("string")} | {c: F.lit(f"clash {c}") for c in clashes})


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


def roots(parent):
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return find


# ---- helpers ----


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2200)] + [(7, 7), (3, None)]
    parent = {n: n for link in links for n in link if n is not None}
    find = roots(parent)
    for a, b in links:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if b is not None and a != b for n in (a, b)}
    assert found == {n: find(n) for n in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


class Session:
    """A session of a cluster that names a shared folder, or doesn't."""

    def __init__(self, conf, master="yarn"):
        self.conf, self.sparkContext, self.master, self.folder = conf, self, master, None

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_shared_folder_follows_the_session(spark):
    named = Session({"spark.checkpoint.dir": "hdfs://shared/x/"})
    assert common.shared_dir(named) == "hdfs://shared/x" and named.folder == "hdfs://shared/x/"
    with pytest.raises(ValueError):
        common.shared_dir(Session({}))
    local = Session({}, "local[2]")
    assert common.shared_dir(local) == common.shared_dir(local) == local.folder
    assert common.stored(spark.range(3), "t").count() == 3


# ---- 1: archives ----


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/%0A\r\n", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "ö" * 200_000), (7, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.register(spark)
    warc.with_revisits(pages).write.format("warc").mode("append").save(str(tmp_path))
    found = {int(r.record_id.rsplit(":", 1)[1]): r for r in spark.read.format("warc").load(str(tmp_path)).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7]
    for k, url, html in rows:
        raw = (html or "").encode()
        last = max(j for j, _, h in rows if (h or "") == (html or ""))
        assert (found[k].payload_bytes, found[k].payload_digest, found[k].target_uri) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), url)
        assert found[k].record_type == ("response" if last == k else "revisit")
        assert found[k].refers_to == (None if last == k else f"urn:page:{last}")
        assert found[k].payload == (raw if last == k else None)
    read = spark.read.format("warc").load(str(tmp_path))
    assert read.filter("record_type = 'revisit'").count() == 3 and read.filter(F.col("target_uri").isin("http://a/", "u")).select("record_id").count() == 5
    assert spark.read.format("warc").schema("record_id string, target_uri string").load(str(tmp_path)).filter("target_uri = 'u'").count() == 4
    none = warc.with_revisits(pages.limit(0))
    none.write.format("warc").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0
    for mode, records in (("append", 14), ("overwrite", 7)):
        warc.with_revisits(pages).write.format("warc").mode(mode).save(str(tmp_path))
        assert spark.read.format("warc").load(str(tmp_path)).count() == records
    named = {x["name"] for x in json.loads((tmp_path / warc._MANIFEST).read_text())}
    assert {f.name for f in tmp_path.glob("part-*.gz")} == named
    large = warc.with_revisits(pages, least_bytes=5).filter("record_type = 'revisit'")
    assert large.count() == 2


def test_warc_of_others(spark, tmp_path):
    """Files without a manifest, of one gzip member for all records or none."""
    import gzip

    body = "".join(
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
        for k, (kind, mime, block) in enumerate([("warcinfo", "application/warc-fields", "a: b"), ("response", "application/http", "HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"), ("resource", "text/plain", "z" * 100_000)])
    ).encode()
    (tmp_path / "a.warc").write_bytes(body)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(body))
    warc.register(spark)
    found = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r.record_type, r.payload_bytes) for r in found.collect()) == [("resource", 100_000)] * 2 + [("response", 5)] * 2 + [("warcinfo", 4)] * 2
    assert [bytes(r.payload) for r in found.filter("record_type = 'response'").collect()] == [b"hello"] * 2


# ---- 2: lines ----


def line_set(line):
    return {line[i : i + 8] for i in range(len(line) - 7)} if len(line) >= 8 else {("short", line)}


def test_lines_by_brute_force(spark, corpus):
    docs = {d: t for d, t, *_ in corpus}
    blank = lambda x: not x.strip(" \t\x0b\x0c\r")
    places = defaultdict(list)
    for d, t in docs.items():
        for k, x in enumerate((t.split("\n") if t is not None else [])):
            if not blank(x):
                places[x].append((d, k))
    lines = list(places)
    parent = {x: x for x in lines}
    find, sets = roots(parent), {x: line_set(x) for x in lines}
    for i, x in enumerate(lines):
        for y in lines[:i]:
            both = len(sets[x] & sets[y])
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    first = {}
    for x in lines:
        first[find(x)] = min([*places[x], first.get(find(x), (10**9, 0))])
    expected = {}
    for d, t in docs.items():
        kept = [x for k, x in enumerate(t.split("\n")) if blank(x) or first[find(x)] == (d, k)] if t is not None else None
        n = sum(not blank(x) for x in t.split("\n")) if t is not None else 0
        expected[d] = ("\n".join(kept) if kept is not None else None, n, n - sum(not blank(x) for x in kept or []))
    found = line_dedup.deduplicated(table(spark, corpus))
    assert by_id(found, "text", "n_lines", "n_removed") == expected
    assert {"lang", "id", "th", "text_2", "r.id"} <= set(found.columns)
    again = line_dedup.deduplicated(table(spark, corpus).withColumns({"n_lines": F.lit(-1), "n_removed": F.lit(-2)}), counts=False)
    assert {(r.n_lines, r.n_removed) for r in again.collect()} == {(-1, -2)}


def test_line_bands_meet_near_lines_and_few_others():
    rows, bands = line_dedup.ROWS, line_dedup.BANDS
    assert (1 - 0.8**rows) ** bands <= 2e-4
    assert bands * 0.1**rows <= 2e-3  # lines that share a tenth rarely meet; those that do by chance grow with the square of the lines


def test_line_dedup_leaves_few_tables(spark, corpus):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    line_dedup.deduplicated(table(spark, corpus[:40])).count()
    left = {x.split("-", 1)[1].rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if x.startswith("glyphmatch-")}
    assert not left & {"buckets", "several", "met", "shared", "line-texts", "line-sketches", "placed", "mixed"}
    assert "removed" in left


def test_families_list_members_once_and_lose_no_pair(spark, monkeypatch):
    """Twenty buckets of the same members become one; buckets that overlap little stay; blocks hold each pair once, and no key a whole bucket."""
    monkeypatch.setattr(components, "BLOCK", 10)
    rng = random.Random(3)
    rows = {(b, m) for b in range(1000, 1020) for m in rng.sample(range(60), 55)} | {(2000 + k, m) for k in range(8) for m in range(100 + 9 * k, 110 + 9 * k)}
    members = spark.createDataFrame([(b, m, m, 1) for b, m in sorted(rows)], "bucket long, id long, component long, band int")
    found = components.by_families(members)
    listed = defaultdict(set)
    for r in found.collect():
        listed[r.bucket].add(r.id)
    assert found.columns == members.columns and sum(map(len, listed.values())) == 60 + 80
    pairs_in = lambda by: {(x, y) for ids in by.values() for x in ids for y in ids if x > y}
    before = defaultdict(set)
    for b, m in rows:
        before[b].add(m)
    assert pairs_in(before) <= pairs_in(listed)
    blocks = components.in_blocks(found, 1000)
    assert blocks.groupBy("bucket").count().agg(F.max("count")).first()[0] < 45
    met = components.crossing_pairs(blocks, lambda x, y: F.lit(True)).collect()
    assert sorted((r.a, r.b) for r in met) == sorted(pairs_in(listed))


def test_few_links_need_one_task_a_step(spark, monkeypatch):
    plans, before = [], components.stored

    def stored(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return before(df, name)

    monkeypatch.setattr(components, "stored", stored)
    found = components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == {(k, 0) for k in range(41)}
    assert [name for name, plan in plans if name != "links" and "Exchange" in plan.replace("BroadcastExchange", "")] == []


def test_near_duplicates_of_a_family_below_the_threshold(spark, monkeypatch):
    """Nearly all pairs of large buckets lie just below the threshold: no rows for them, and the same result as brute force."""
    rng = random.Random(5)
    base, texts = [f"w{k}" for k in range(300)], []
    for k in range(110):
        edited = list(base)
        for at in rng.sample(range(300), 5):
            edited[at] = f"x{k}_{at}"
        texts.append(" ".join(edited))
    texts.append(texts[40] + " more")
    docs, seen, before = table(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)]), [], minhash.confirmed

    def confirmed(pairs, *rest):
        seen.append(pairs.count())
        return before(pairs, *rest)

    monkeypatch.setattr(minhash, "confirmed", confirmed)
    found = by_id(minhash.near_duplicates(docs), "component_id")
    sets, parent, below = [set(minhash.shingle_set(t, 3).tolist()) for t in texts], list(range(len(texts))), 0
    find = roots(parent)
    for x in range(len(texts)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            union = len(sets[x]) + len(sets[y]) - both
            below += 80 * union <= 100 * both < 85 * union
            if 100 * both >= 85 * union:
                low, high = sorted((find(x), find(y)))
                parent[high] = low
    assert found == {k: (find(k),) for k in range(len(texts))}
    assert find(110) == find(40) and below > 3000
    assert 3 * seen[-1] < below, (seen, below)  # the pass after the stars


def test_line_buckets_are_shuffled_once(spark, monkeypatch):
    """Rows of bands are by far the most rows: they are dealt once, by a bucket and one hash, however many buckets there are."""
    plans, before = {}, line_dedup.stored

    def stored(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return before(df, name)

    monkeypatch.setattr(line_dedup, "stored", stored)
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    rng = random.Random(8)
    texts = ["\n".join(words_of(rng, 12) for _ in range(4)) for _ in range(6)]
    rows = [(k, t, "", "", 0) for k, t in enumerate([*texts, texts[2] + " x", texts[4]])]
    found = by_id(line_dedup.deduplicated(table(spark, rows)), "n_lines", "n_removed")
    assert found == {**{k: (4, 0) for k in range(6)}, 6: (4, 4), 7: (4, 4)}
    assert plans["met"].count("Exchange hashpartitioning") == 1
    assert "several" not in plans


def test_lines_are_shuffled_in_slices(spark, monkeypatch):
    """No write shuffles all texts of lines or all rows of bands; slices together hold each row once and lines meet across them."""
    rows, before = defaultdict(list), line_dedup.stored

    def stored(df, name):
        found = before(df, name)
        if name in ("buckets", "met"):
            rows[name].append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "stored", stored)
    rng = random.Random(9)
    texts = ["\n".join(words_of(rng, 12) for _ in range(4)) for _ in range(20)]
    given = [(k, t, "", "", 0) for k, t in enumerate([*texts, *(t + " x" for t in texts)])]
    found = by_id(line_dedup.deduplicated(table(spark, given)), "n_lines", "n_removed")
    assert found == {k: (4, 4 * (k >= 20)) for k in range(40)}
    assert len(rows["buckets"]) > 1 and max(rows["buckets"]) < 0.75 * sum(rows["buckets"]), rows
    assert len(rows["met"]) > 2 and max(rows["met"]) < 0.5 * sum(rows["met"]), rows


def test_shingles_are_looked_up_in_one_table(spark, monkeypatch):
    """The aggregations of shingles have far more groups than the small table of compiled code holds: they go without it, the session as before."""
    name, seen, before = "spark.sql.codegen.aggregate.map.twolevel.enabled", defaultdict(set), line_dedup.stored

    def stored(df, table):
        seen[table].add(spark.conf.get(name, None))
        return before(df, table)

    monkeypatch.setattr(line_dedup, "stored", stored)
    own = spark.conf.get(name, None)
    rng = random.Random(10)
    texts = ["\n".join(words_of(rng, 12) for _ in range(4)) for _ in range(4)]
    found = by_id(line_dedup.deduplicated(table(spark, [(k, t, "", "", 0) for k, t in enumerate([*texts, texts[1] + " x"])])), "n_lines", "n_removed")
    assert found == {**{k: (4, 0) for k in range(4)}, 4: (4, 4)}
    assert all(seen[x] == {"false"} for x in ("buckets", "line-sketches", "line-links")), seen
    assert seen["line-texts"] == {own} == {spark.conf.get(name, None)}


def test_lines_of_nothing(spark):
    assert line_dedup.deduplicated(table(spark, [])).count() == 0
    found = line_dedup.deduplicated(table(spark, [(1, None, "", "", 0), (None, "a b", "", "", 0), (None, "a b", "", "", 0), (2, "\n\n", "", "", 0)])).collect()
    assert len(found) == 4 and {r.text for r in found if r.doc_id == 2} == {"\n\n"}


# ---- 3: toxicity ----


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = words_of(rng, rng.randint(5, 60)).split()
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["Grumble", "grumbling,", "GRUMBLED"])
        rows.append((k, " ".join(text), "de" if k % 3 else "en", "s", 0))
        labels.append((k, int(bad)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "grumble " * 30_000, "en", "s", 0)]
    docs, labels = table(spark, rows), spark.createDataFrame([*labels, (5000, 1), (901, None)], "doc_id long, toxic int")
    model, thresholds = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    found = by_id(toxicity.scored(docs, model, thresholds), "score", "toxic")
    apart = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((found[k][0] >= 0.3) == (k % 4 == 0) for k in apart) >= 0.95 * len(apart)
    assert all(0 <= s <= 1 for s, _ in found.values()) and found[900][0] == found[901][0] < found[902][0]
    assert toxicity.scored(docs.limit(0), model, thresholds).count() == 0
    one_class, cuts = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.scored(docs, one_class, cuts).count() == len(rows)
    nothing, cuts = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scored(docs, nothing, cuts).count() == len(rows)


# ---- 4: URLs ----

RULES = [url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"), url_filter.Rule("example.org", "/en/1", "block"), url_filter.Rule("com", "/fr/", "allow"), url_filter.Rule("com", "/de/", "block")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def best_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)




def test_urls(spark):
    rng = random.Random(6)
    urls = [f"http://{rng.choice(['a', 'b.c', 'www.Shop'])}{rng.randint(0, 9)}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randint(0, 300)}{rng.choice(['', '?q=1', '#x'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "x://", "http://ORG", "http://org/", "http://org?x", "http://borg/", "http://example.org/en/15", "http://sub.example.org/es/", "http://é.com/fr/ö", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(0), "text": F.lit(0)})
    found = {r.page_id: r for r in url_filter.judged(pages, RULES).collect()}
    assert len(found) == len(urls)
    for k, u in enumerate(urls):
        host, path = split_url(u)
        rule = best_rule(host, path)
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule.text if rule else None), u
        assert found[k].verdict in ("allow", "block") and (rule is None or found[k].verdict == rule.verdict)
    nets = [found[k] for k, u in enumerate(urls) if u and ".net/" in u]
    share = lambda lang: np.mean([r.verdict == "allow" for r in nets if r.path.startswith(f"/{lang}/")])
    assert share("fr") > share("es")
    assert url_filter.judged(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judged(pages, []).collect()} == {"allow"}


def test_url_scores_by_brute_force(spark):
    """Scores of the open URLs from counts of all examples."""
    urls = ["http://a.org/en/2", "http://b.org/fr/3", "http://c.com/de/1", "http://d.com/de/2", "http://e.net/de/4", "http://f.net/fr/5"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r.score for r in url_filter.judged(pages, RULES).collect()}
    texts = ["".join(split_url(u)) for u in urls]
    kinds = [best_rule(*split_url(u)) for u in urls]

    def log_likelihood(text, examples):
        counts = Counter()
        for t in examples:
            padded = "\x02" * 4 + t + "\x03"
            for i in range(4, len(padded)):
                for k in range(5):
                    counts[padded[i - k : i], padded[i]] += 1
        total, padded = 0.0, "\x02" * 4 + text + "\x03"
        for i in range(4, len(padded)):
            p = 1 / 1024
            for k in range(5):
                following = {c: n for (x, c), n in counts.items() if x == padded[i - k : i]}
                if following:
                    p = (following.get(padded[i], 0) + len(following) * p) / (sum(following.values()) + len(following))
            total += np.log(p)
        return total / (len(text) + 1)

    for k in (4, 5):
        allowed, blocked = ([t for t, r in zip(texts, kinds) if r and r.verdict == v] for v in ("allow", "block"))
        assert found[k] == pytest.approx(log_likelihood(texts[k], allowed) - log_likelihood(texts[k], blocked))
    assert all(found[k] is None for k in range(4))


# ---- 5: near duplicates ----


def test_near_duplicates_by_brute_force(spark, corpus):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t, *_ in corpus:
        w = re.findall(common.WORD_PATTERN, (t or "").translate(lower))
        sets[d] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}
    find = roots(parent)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    found = by_id(minhash.near_duplicates(table(spark, corpus)), "n_shingles", "component_id", "kept")
    assert found == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates_between_components(spark):
    """A family where many pairs lie just below and some just above the threshold."""
    rng = random.Random(3)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(150):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(2, 4)):
            own[at] = f"y{rng.randint(0, 3)}"
        rows.append((k, " ".join(own), "", "", 0))
    sets = {d: set(zip(w, w[1:], w[2:])) for d, t, *_ in rows for w in [t.split()]}
    parent = {d: d for d in sets}
    find = roots(parent)
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    found = by_id(minhash.near_duplicates(table(spark, rows)), "component_id")
    assert {d: c for d, (c,) in found.items()} == {d: find(d) for d in sets}


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    rows = [(None, "a b c d", "", "", 0), (1, "a b c d", "", "", 0), (2, "A  b\nc d", "", "", 0), (2, "A  b\nc d", "", "", 0), (3, "", "", "", 0), (4, None, "", "", 0)]
    found = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()]
    assert Counter(found) == Counter([(None, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True)])
    once = minhash.one_of_each(table(spark, [(5, "a b c d e f", "", "", 0), (5, "a b c d e f", "", "", 0), (6, "g h", "", "", 0), (7, "a b c d e f", "", "", 0)]))
    assert sorted(r.doc_id for r in once.collect()) == [5, 6]


# ---- 6: suffix arrays ----


@pytest.mark.parametrize("large", [0.01, 16, 1e9])
def test_suffix_array(monkeypatch, large):
    monkeypatch.setattr(induced, "_LARGE_BUCKET", large)
    rng = random.Random(1)
    for _ in range(150):
        sigma = rng.choice([2, 3, 5, 27])
        text = [rng.randint(1, sigma) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.3:
            text = (text[: max(1, len(text) // 5)] * 6)[: len(text)]
        text.append(0)
        assert induced.suffix_array(np.array(text), sigma + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_long_text():
    """Deep recursion over many names, beside an array by doubling the compared length."""
    rng = random.Random(8)
    text = np.array([ord(c) for c in " ".join(rng.choice(["an", "other", "word", "words", "and", "the", "then"]) for _ in range(6_000))] * 2 + [0])
    rank, length = text.astype(np.int64), 1
    while True:
        key = rank * (len(text) + 300) + np.append(rank[length:] + 1, np.zeros(min(length, len(text)), np.int64))[: len(text)]
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), np.int64)
        rank[order] = np.append(0, np.cumsum(np.diff(key[order]) > 0))
        if rank.max() == len(text) - 1:
            break
        length *= 2
    assert (induced.suffix_array(text, 256) == order).all()


def test_names_are_sorted_without_plain_loops(monkeypatch):
    """A long text with copies has many names at the second level: none of its levels goes suffix by suffix."""

    def slow(*_):
        raise AssertionError("a plain loop over suffixes")

    monkeypatch.setattr(induced, "_induce_loop", slow)
    rng = random.Random(6)
    part = bytes(rng.choices(b"abcdefghij ", k=6_000))
    raw = part + b"!" + part + bytes(rng.choices(b"ab", k=500)) + b"a" * 300 + part[:3_000]
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0)
    assert induced.suffix_array(text, 258)[1:].tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_keys_of_many_bits():
    rng = np.random.default_rng(7)
    columns = [rng.choice([0, 5, 1 << 29, 1 << 30], 400) for _ in range(4)]
    rows = list(zip(*(c.tolist() for c in columns)))
    key = induced._packed(columns)
    assert [rows[k] for k in key.argsort(kind="stable")] == sorted(rows) and len(np.unique(key)) == len(set(rows))


def test_windows_that_regions_begin_alike():
    """Copies, regions that share a beginning only, and regions whose inner parts repeat, beside brute force."""
    rng = random.Random(3)
    for width in (8, 20):
        bits = [bytes(rng.choices(b"abc", k=rng.randint(width, 3 * width))) for _ in range(12)]
        raws = [*bits, *bits[:5], *(x + b"zz" for x in bits[3:7]), *(b"y" + x[:-1] for x in bits[5:9] if len(x) > width), *(x[2:] + b"q" * width for x in bits[9:])]
        counts = Counter(x[i : i + width] for x in raws for i in range(len(x) - width + 1))
        found = suffix.repeated_windows(raws, [len(x) - width + 1 for x in raws], width)
        assert [h.tolist() for h in found] == [[counts[x[i : i + width]] > 1 for i in range(len(x) - width + 1)] for x in raws]


def test_common_prefixes():
    rng = random.Random(2)
    raw = bytes(rng.choice(b"ab") for _ in range(400)) + b"ab" * 100
    array = induced.suffix_array(np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0), 258)[1:]
    wanted = np.zeros(len(raw), bool)
    wanted[: len(raw) - 20] = True
    found = induced.common_prefixes(np.frombuffer(raw, np.uint8), array, wanted, 20)
    order = [i for i in array if wanted[i]]
    for before, i in zip(order, order[1:]):
        n = next((k for k in range(20) if raw[before + k] != raw[i + k]), 20)
        assert found[i] == n


def test_windows_in_small_blocks(monkeypatch):
    """Blocks change nothing: neither an array nor which windows repeat, also where runs of one letter cross them."""
    rng = random.Random(11)
    bits = [bytes(rng.choices(b"ab", k=rng.randint(20, 60))) for _ in range(9)] + [b"a" * 70, b"b" * 45 + b"a" * 30]
    raws = [*bits, *bits[2:6], *(x[3:] + b"c" * 20 for x in bits[:4])]
    text = np.append(np.frombuffer(b"-".join(raws), np.uint8).astype(np.uint16), 0)
    for block in (1, 7, 64):
        monkeypatch.setattr(induced, "BLOCK", block)
        assert induced.suffix_array(text, 258).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        counts = Counter(x[i : i + 20] for x in raws for i in range(len(x) - 19))
        found = suffix.repeated_windows(raws, [len(x) - 19 for x in raws], 20)
        assert [h.tolist() for h in found] == [[counts[x[i : i + 20]] > 1 for i in range(len(x) - 19)] for x in raws]


def test_shards_take_little_memory():
    """Two workers sort shards beside an executor's heap: what a shard takes is a small multiple of its text."""
    rng = random.Random(12)
    raws = [words_of(rng, 70).encode() for _ in range(6_000)]
    raws += raws[:2_000]
    size = sum(map(len, raws))
    tracemalloc.start()
    try:
        suffix.repeated_windows(raws, [len(x) - 199 for x in raws], 200)
        assert tracemalloc.get_traced_memory()[1] < 30 * size
    finally:
        tracemalloc.stop()


def brute_repeats(texts, width):
    counts = Counter(x[i : i + width] for x in texts.values() for i in range(len(x) - width + 1))
    found = {}
    for d, x in texts.items():
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if counts[x[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(x, gone) if not g)
        found[d] = (len(x), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone))), kept)
    return found


@pytest.mark.parametrize(("width", "most"), [(200, 2_000), (40, 2_000), (40, 1)])
def test_repeats_by_brute_force(spark, corpus, monkeypatch, width, most):
    monkeypatch.setattr(suffix, "MOST_REGIONS", most)
    expected = brute_repeats({d: (t or "").encode() for d, t, *_ in corpus}, width)
    found = by_id(suffix.without_repeats(table(spark, corpus), width=width), "n_bytes", "n_removed", "n_spans", "kept")
    assert {d: (*x[:3], bytes(x[3])) for d, x in found.items()} == expected


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 300)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 2_000)
    rng = random.Random(5)
    part = "".join(rng.choices("abcdö", k=300))
    rows = [(1, "".join(rng.choices("abcd", k=900)) + part + "".join(rng.choices("abcd", k=700)), "", "", 0), (2, part + part[:250], "", "", 0), (3, "a" * 900, "", "", 0)]
    expected = brute_repeats({d: t.encode() for d, t, *_ in rows}, 200)
    found = by_id(suffix.without_repeats(table(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept")
    assert {d: (*x[:3], bytes(x[3])) for d, x in found.items()} == expected


def test_repeats_of_nothing(spark):
    assert suffix.without_repeats(table(spark, [])).count() == 0
    rows = [(1, "ab" * 150, "", "", 0), (1, "ab" * 150, "", "", 0), (None, "ab" * 150, "", "", 0), (2, "é" * 120, "", "", 0), (3, "xé" + "é" * 120, "", "", 0)]
    found = suffix.without_repeats(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in found) == Counter([(1, 300), (1, 300), (None, 300), (2, 240), (3, 242)])
    rows = [(4, "x" + "é" * 120, "", "", 0), (5, "é" * 100 + "a", "", "", 0), (6, "\u0129" + "\u00e9" * 99 + "y", "", "", 0), (7, "\u0169" + "\u00e9" * 99 + "z", "", "", 0)]
    docs = table(spark, rows).withColumns({"kept": F.lit(1), "cuts": F.lit(2), "n_bytes": F.lit(3), "keep_0": F.lit(4)})
    found = suffix.deduplicated(docs)
    assert found.columns == docs.columns and {(r.kept, r.cuts, r.n_bytes, r.keep_0) for r in found.collect()} == {(1, 2, 3, 4)}
    assert {r.doc_id: r.text for r in found.collect()} == {4: "x", 5: "a", 6: "\u0129" + "\u00e9" * 99 + "y", 7: "\u0169" + "\u00e9" * 99 + "z"}


# ---- 7: byte pairs ----


def test_byte_pairs(spark, corpus):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = list("abcdeEST 's'tll  \n\t\r\x0b\x0c\x1c\x1d\x85\xa0 　1234½²éü漢字한🎉👩‍👩-_*́!?<|>▁Ġ\x00")
    rows = [*corpus, *((10_000 + k, "".join(rng.choices(letters, k=rng.randint(0, 40))), "", "", 0) for k in range(1500)), (20_000, " " * 5000 + "x" * 3000, "", "", 0)]
    encoded = bpe.encode(table(spark, rows), path, public_tokenizers.PATTERN)
    found = by_id(bpe.decode(encoded, path, public_tokenizers.PATTERN), "ids", "decoded")
    for d, t, *_ in rows:
        assert found[d][0] == reference.encode_ordinary(t or "") and bytes(found[d][1]) == (t or "").encode()
    assert bpe.encode(table(spark, []), path, public_tokenizers.PATTERN).count() == 0


# ---- 8: packing ----


def test_plan_is_sound_and_tight():
    rng = random.Random(9)
    for _ in range(150):
        size = rng.choice([8, 16, 64, 256])
        lengths = [rng.randint(1, size if rng.random() < 0.5 else max(1, size // 4)) for _ in range(rng.randint(0, 400))]
        slots, sequences = packing.plan_slots(dict(Counter(lengths)), size)
        used, taken = defaultdict(list), Counter()
        for length, first, end, sequence, offset in slots:
            assert taken[length] == first
            taken[length] = end
            for r in range(end - first):
                used[sequence + r].append((offset, length))
        assert taken == Counter(lengths) and len(used) == sequences
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        large = sum(x > size // 2 for x in lengths)
        assert sequences <= max(-(-sum(lengths) // size), large) * 1.25 + 1
    with pytest.raises(ValueError):
        packing.plan_slots({9: 1}, 8)


def test_packed_documents(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = [chr(i) for i in range(1, 0x180)] + list("abcxyzABC") * 30 + [" "] * 40 + list(".,;:!?'") * 8 + list("ΣσςΑİı漢é🎉")
    rows = [*corpus, *((10_000 + k, "".join(rng.choices(letters, k=rng.randint(0, 40))), "", "", 0) for k in range(800)), (20_000, "x<|endoftext|> a", "", "", 0)]
    size = 256
    found = packing.packed_documents(table(spark, rows), path, size).collect()
    expected = {}
    for d, t, *_ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            expected[d, k // size] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == expected
    used = defaultdict(list)
    for r in found:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(used) <= -(-sum(x[1] for x in expected.values()) // size) + 1
    assert packing.packed_documents(table(spark, []), path).count() == 0


def test_words_are_remembered_once(monkeypatch):
    """Line ends, capitals and what follows them give the tokenizer's ids, and no words of their own."""
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    reference, words = tokenizers.Tokenizer.from_file(path), packing._Words(open(path, "rb").read())
    rng = random.Random(12)
    letters = list("abcXYZ\u00c9\u00e9\u00df\u0178\u017f\u0130\u01c5\u0301\u03a3") + [" ", "\n", "\n\n", "\r\n", " \n", "\t", "\x85", "\u2028", "'S", "'ll", "\n'T", "I.", "9", "<|ENDOFTEXT|>", "<|endoftext|>", "<|", "|>", ".\n"]
    for few in (4, 12, len(letters)):
        for _ in range(1500):
            text = "".join(rng.choices(rng.sample(letters, few), k=rng.randint(0, 24)))
            assert np.frombuffer(words.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
    words.clear()
    lines = [f"{a}.\n{b} {a}" for a in ("one", "One", "two", "Two") for b in ("three", "Three", "four", "Four")]
    for line in lines:
        assert np.frombuffer(words.encode(line), "<u4").tolist() == reference.encode(line, add_special_tokens=False).ids
    assert set(words) == {"one.", "two.", "three", "four", "one", "two", "."}


# ---- 9: fingerprints ----


def test_fingerprints(spark, corpus):
    for parts in (1, 3, 40):
        rows = sorted(corpus)
        found = by_id(fingerprint.compared_with_next(table(spark, corpus), parts), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        assert len(found) == len(rows)
        for k, (d, t, *_) in enumerate(rows):
            text, following = t or "", rows[(k + 1) % len(rows)][1] or ""
            half = len(text) // 2
            other = text[: len(text) - half] + following[:half]
            own, e, n = fingerprint.digest(text.encode()), fingerprint.digest(other.encode()), fingerprint.digest(following.encode())
            assert found[d] == (len(text), hashlib.sha256(other.encode()).hexdigest(), own, e, fingerprint.likeness(own, e), fingerprint.likeness(own, n))
    alone = fingerprint.compared_with_next(table(spark, [(None, "abc" * 50, "", "", 0)])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert fingerprint.compared_with_next(table(spark, [])).count() == 0
    twice = fingerprint.compared_with_next(table(spark, [(1, "abc", "", "", 0), (1, "abc", "", "", 0), (2, "d", "", "", 0)]), 2).collect()
    assert len(twice) == 3
    assert {r.doc_id for r in fingerprint.fingerprints(table(spark, corpus)).collect()} == {d for d, *_ in corpus}


def test_fingerprints_tell_texts_apart():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300)) for _ in range(30)]
    digests = [fingerprint.digest(t.encode()) for t in texts]
    near = [fingerprint.likeness(d, fingerprint.digest(fingerprint.edited(t, texts[k - 1]).encode())) for k, (t, d) in enumerate(zip(texts, digests))]
    far = [fingerprint.likeness(a, b) for a, b in zip(digests, digests[1:])]
    assert all(n > f for n, f in zip(near, far)) and np.mean(near) > np.mean(far) + 0.1
    assert fingerprint.digest(b"a" * 600_000) == fingerprint.digest(b"a" * 600_000)


# ---- 10: quality rules ----


def brute_counts(text):
    words = re.findall(common.WORD_PATTERN, text)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(common.WORD_PATTERN, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark, corpus):
    found = by_id(quality.judged(table(spark, corpus)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t, *_ in corpus:
        counts = brute_counts(t or "")
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert found[d][:6] == (*counts, failed) and not (failed and found[d][6])
    assert quality.judged(table(spark, [])).count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(2)
    prose = lambda: ". ".join(" ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(9)).capitalize() for _ in range(12)) + "."
    rows, good = [], {}
    for k in range(300):
        text = prose()
        if k % 10 == 0:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split())
        elif k % 10 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif k % 10 == 2:
            text = " | ".join(text.replace(".", "").split())
        rows.append((k, text, "", "", 0))
        good[k] = k % 10 > 2
    found = by_id(quality.judged(table(spark, rows)), "kept")
    assert {d: kept for d, (kept,) in found.items()} == good
    kept = quality.accepted(table(spark, [*rows, (None, None, "", "", 0)]))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, g in good.items() if g} and kept.columns == table(spark, []).columns


# ---- models and digests beside plain loops ----


def test_digest_by_brute_force():
    """Counts, quartiles, length step and likeness of the digest with whole numbers of Python."""
    rng = random.Random(21)
    mask, triplets = (1 << 32) - 1, ((0, 3, 11), (0, 5, 13), (0, 7, 17), (0, 2, 19), (0, 9, 21), (0, 11, 23))
    factors = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)

    def slow(raw):
        counts, padded = [0] * 256, raw + bytes(23)
        for at in range(len(raw)):
            for (i, j, k), f in zip(triplets, factors):
                key = (padded[at + i] | padded[at + j] << 8 | padded[at + k] << 16) * f & mask
                counts[(key ^ key >> 15) * (f ^ 0x5BD1E994) % (1 << 32) >> 24] += 1
        cuts = [sorted(counts)[k] for k in (63, 127, 191)]
        steps = [sum(c > cut for cut in cuts) for c in counts]
        length = min(255, round(np.log(len(raw) + 1) / np.log(1.1)))
        return f"{length:02x}" + bytes(steps[k] | steps[k + 1] << 2 | steps[k + 2] << 4 | steps[k + 3] << 6 for k in range(0, 256, 4)).hex(), steps, length

    raws = [b"", b"x", "öä".encode() * 9, *(bytes(rng.choices(b"etaoin shrdlu", k=rng.randint(30, 900))) for _ in range(12))]
    made = [slow(raw) for raw in raws]
    assert [fingerprint.digest(raw) for raw in raws] == [d for d, *_ in made]
    cost = lambda x, y: 6 if abs(x - y) == 3 else abs(x - y)
    for a, x, n in made:
        for b, y, m in made:
            unrelated = sum(cost(p, q) for p in x for q in y) / 256
            apart = sum(map(cost, x, y)) + max(0, abs(n - m) - 1)
            assert fingerprint.likeness(a, b) == pytest.approx(1 if a == b else max(0, 1 - apart / unrelated) if unrelated else 0)


def test_expectation_maximisation_by_document():
    """The posterior from patterns equals one that goes document by document, and finds the classes that votes were made from."""
    rng = random.Random(22)
    truth = [rng.random() < 0.6 for _ in range(400)]
    right = (0.95, 0.9, 0.9, 0.85)
    votes = [tuple(0 if rng.random() < 0.3 else (1 if t else 2) if rng.random() < r else (2 if t else 1) for r in right) for t in truth]
    found, share, table = quality.estimate(sorted(Counter(votes).items()))
    by_pattern = {p: q for (p, _), q in zip(sorted(Counter(votes).items()), found)}
    post = []
    for v in votes:
        good, bad = v.count(1), v.count(2)
        post.append(0.99 if not bad else 0.02 if bad >= 2 else good / (good + 6))
    for _ in range(200):
        prior = [(sum(1 - q for q in post) + 1) / (len(post) + 2), (sum(post) + 1) / (len(post) + 2)]
        chance = [[[0.0] * 3 for _ in right] for _ in (0, 1)]
        for c in (0, 1):
            for r in range(len(right)):
                for vote in range(3):
                    chance[c][r][vote] = sum((q if c else 1 - q) for v, q in zip(votes, post) if v[r] == vote) + 1 + (vote == 2 - c)
                whole = sum(chance[c][r])
                chance[c][r] = [x / whole for x in chance[c][r]]
        new = []
        for v in votes:
            weight = [prior[c] * np.prod([chance[c][r][v[r]] for r in range(len(right))]) for c in (0, 1)]
            new.append(weight[1] / sum(weight))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    assert [by_pattern[v] for v in votes] == pytest.approx(post, abs=1e-5)
    assert np.mean([(by_pattern[v] > 0.5) == t for v, t in zip(votes, truth)]) > 0.85
    assert share[1] == pytest.approx(np.mean(post), abs=0.02) and table.shape == (2, 4, 3)


def test_convolution_by_loops():
    """Embeddings, filters of each width at each place, pooling over places, the output: a score by plain loops."""
    rng = random.Random(23)
    bad = ["vile thing", "awful person", "nasty lot"]
    texts = [words_of(rng, rng.randint(1, 30)) + (" " + rng.choice(bad) if k % 2 else "") for k in range(60)]
    model = toxicity.train(texts, np.array([k % 2 for k in range(60)]))
    for text in [*texts[:6], "", "one", "vile thing", "A, b!"]:
        words = [toxicity.plain(w) for w in text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
        vectors = []
        for w in words:
            parts = [w, *(b"<%d" % n + w[:n] for n in (3, 4, 5, 6) if n < len(w)), *(b">%d" % n + w[-n:] for n in (3, 4) if n < len(w))]
            vectors.append(np.mean([model.embeddings[zlib.crc32(x) % toxicity.BUCKETS] for x in parts], 0))
        vectors += [np.zeros(toxicity.SIZE)] * (2 if words else 3)
        pooled, column = [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                at = lambda place: sum(vectors[place + j] @ model.filters[:, column + j * toxicity.FILTERS + f] for j in range(width))  # noqa: E731, B023
                pooled.append(max(at(place) for place in range(max(1, len(words)))))
            column += width * toxicity.FILTERS
        z = sum(max(0.0, x + b) * o for x, b, o in zip(pooled, model.bias, model.out)) + model.out_bias
        assert toxicity.Scorer(model).score([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_beside_sql(spark, name):
    """What SQL can express, over the smallest tables; whole tables at sf0.01 are compared by the driver."""
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    expected = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    rows = sorted((tuple(r[expected.columns.index(c)] for c in columns) for r in expected.fetchall()), key=str)
    assert sorted((tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()), key=str) == rows
