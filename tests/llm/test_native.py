"""The operators that run as DataFrame operations only."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.llm import fingerprints, licenses, sharding, urls
from labelspark.llm.queries import URL_RULES


def plain_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (i, label)
        for label, phrase in licenses.PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({l for _, l in places})))


def scanned(docs):
    return sorted(((r.doc_id, *[r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")]) for r in licenses.scan(docs).collect()), key=repr)


def test_licenses_on_edge_rows(spark, edge_docs, edge_rows, no_docs):
    assert scanned(edge_docs) == sorted(((r[0], *plain_scan(r[1])) for r in edge_rows), key=repr)
    assert licenses.scan(no_docs).count() == 0
    texts = ["MIT License mit license MIT-license", "the GNU General Public general public license", "cc by cc by", "Apache  License. gnu GENERAL public License", "mit licenseé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert scanned(docs) == [(i, *plain_scan(t)) for i, t in enumerate(texts)]


def test_licenses_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert scanned(docs) == sorted(((r.doc_id, *plain_scan(r.text)) for r in docs.collect()), key=repr)


def test_a_template_with_small_changes_is_found(spark):
    notice = dict(licenses.TEMPLATES)["bsd-notice"].split()
    changed = [*notice[:5], "really", *notice[5:]]
    rows = [(0, "x " * 50 + " ".join(changed)), (1, " ".join(notice[:8])), (2, " ".join(reversed(notice)))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].labels == "bsd-notice" and (got[0].spans[0].start, got[0].spans[0].end) == (50, 50 + len(changed))
    assert got[1].labels == got[2].labels == "" and 0 < got[1].score < 0.5 and 0.85 <= got[0].score < 1


def test_shards_are_exact_and_gapless(spark, edge_docs, edge_rows, no_docs):
    rows = sharding.shuffle_into_shards(edge_docs, ["doc_id", "text", "score"], shards=5).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in edge_rows)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert sharding.shuffle_into_shards(no_docs, ["doc_id"]).count() == 0


def test_several_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 6)
    got = sharding.shuffle_into_shards(spark.range(5000).repartition(7), ["id"], shards=3).toPandas()
    assert sorted(got["id"]) == list(range(5000)) and got.groupby("shard").size().tolist() == [1667, 1667, 1666]
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    again = sharding.shuffle_into_shards(spark.range(5000).repartition(7), ["id"], shards=3).toPandas()
    assert len(again) == 5000
    # uniform: neighbours in the input are no neighbours in the output
    order = got.sort_values(["shard", "slot"])["id"].to_numpy()
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.08


def test_the_matrix_has_its_margins_and_the_right_spread():
    counts = np.array([sharding.communication_matrix([40, 0, 25, 35], [34, 33, 33], seed) for seed in range(2000)])
    assert (counts.sum(axis=1) == [34, 33, 33]).all() and (counts.sum(axis=2) == [40, 0, 25, 35]).all()
    assert abs(counts[:, 0, 0].mean() - 13.6) < 0.3
    assert abs(counts[:, 0, 0].var() - 40 * 0.34 * 0.66 * 60 / 99) < 0.8


def test_large_tables_follow_the_same_law(monkeypatch):
    """Drawn rows and numpy's sampler have the same margins, mean and variance; very
    many rows can be drawn from."""
    monkeypatch.setattr(sharding, "SAMPLER_ROWS", 0)
    counts = np.array([sharding.communication_matrix([40, 0, 25, 35], [34, 33, 33], seed) for seed in range(2000)])
    assert (counts.sum(axis=1) == [34, 33, 33]).all() and (counts.sum(axis=2) == [40, 0, 25, 35]).all()
    assert abs(counts[:, 0, 0].mean() - 13.6) < 0.3
    assert abs(counts[:, 0, 0].var() - 40 * 0.34 * 0.66 * 60 / 99) < 0.8
    vast = sharding.communication_matrix([65_536] * 3, [10**15, 3 * 10**15], 5)
    assert (vast.sum(axis=1) == 65_536).all() and abs(vast[:, 0].mean() - 16_384) < 400


@pytest.mark.parametrize("lines", [400, 4_000, 40_000])
def test_likeness_does_not_depend_on_length(spark, lines):
    """Texts that share three quarters of their lines, short or long."""
    own = [f"line {i}" for i in range(lines)]
    other = own[: 3 * lines // 4] + [f"other {i}" for i in range(lines // 4)]
    table = spark.createDataFrame([("\n".join(own), "\n".join(other), "\n".join(f"x{i}" for i in range(lines)))], "a string, b string, c string")
    v = {c: fingerprints.vector(F.col(c)) for c in "abc"}
    near, far = table.select(fingerprints.likeness(v["a"], v["b"]), fingerprints.likeness(v["a"], v["c"])).first()
    assert 0.6 < near < 0.9 and far < 0.35


def test_edited_texts(edge_rows, spark):
    rows = [r for r in edge_rows if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # ids once
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ordered = sorted(rows)
    for i, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        mine = got[r[0]]
        assert mine.n_chars == len(text) and mine.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= mine.near_edited <= 1 and 0 <= mine.near_next <= 1
        if want == text:
            assert mine.fingerprint == mine.edited_fingerprint and mine.near_edited == 1
        if after == text:
            assert mine.near_next == 1
    by_text = {}
    for r in ordered:
        assert by_text.setdefault(r[1] or "", got[r[0]].fingerprint) == got[r[0]].fingerprint


def test_small_blocks_link_alike(spark):
    docs = spark.createDataFrame([(i * 37 - 500, f"t{i}") for i in range(300)], "doc_id long, text string")
    for bits in (1, 4, 13):
        rows = fingerprints.with_next(docs, F.col("text"), bits).orderBy("doc_id").collect()
        assert [(r.own, r.next) for r in rows] == [(f"t{i}", f"t{(i + 1) % 300}") for i in range(300)]


def test_repeated_rows_and_null_ids(edge_docs, edge_rows, no_docs):
    rows = fingerprints.edited_fingerprints(edge_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows)
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


def test_paragraphs_are_added_and_taken_away(spark):
    text = "One. Two!\nThree\nThree\nFour?"
    table = spark.createDataFrame([(text, "Three\nOne.\nFour?", "Two!\nThree", "Four?\nThree\nTwo!\nThree\nOne.")], "w string, a string, b string, o string")
    v = {c: fingerprints.vector(F.col(c)) for c in "wabo"}
    row = table.select(
        (fingerprints.combined(v["a"], v["b"]) == v["w"]).alias("added"),
        (fingerprints.combined(v["w"], fingerprints.inverse(v["b"])) == v["a"]).alias("taken"),
        (v["o"] == v["w"]).alias("order"),
        fingerprints.likeness(v["w"], v["a"]).alias("near"),
        fingerprints.likeness(v["w"], v["w"]).alias("same"),
    ).first()
    assert row.added and row.taken and row.order and row.same == 1 and 0.2 < row.near < 1


def plain_judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
    path = re.split("[?#]", rest[cut:], maxsplit=1)[0]
    best = None
    for action, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return host, path, best


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.fit(spark)


def test_urls(spark, url_model):
    given = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/EN/", "http://a.b.net/es/4", "https://net/fr/", "http://notexample.com/en/",
             "ftp://x.org?q=://z/", "http://Éx.com#/en/", "http://best-casino.example.org/x", "http://u@h:80/p?x/y", "http://example.com"]
    sf = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages = spark.createDataFrame(list(enumerate(given + sf)) + [(None, "http://x.net/fr/1"), (0, None)], "page_id long, url string")
    for r in urls.judge(pages, URL_RULES, url_model).filter("page_id is not null").collect():
        host, path, best = plain_judge((given + sf)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else ("block" if r.block_chance >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0), URL_RULES, url_model).count() == 0


def test_url_model_generalises(spark, url_model):
    bad = ["http://mega-casino.test/en/9", "https://www.pills-online.test/de/2", "http://track-ads.test/3", "https://top-bets.test/fr/8"]
    good = ["http://lake-district.test/en/9", "https://www.inster.test/de/2", "http://thather.test/3"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = [r.verdict for r in urls.judge(pages, [], url_model).orderBy("page_id").collect()]
    assert got == ["block"] * 4 + ["allow"] * 3


def test_lanes_wrap_without_overflow(spark):
    many = spark.createDataFrame([("\n".join(["same"] * 40_000), "\n".join(["same"] * 39_999))], "a string, b string")
    a, b = fingerprints.vector(F.col("a")), fingerprints.vector(F.col("b"))
    one = fingerprints.vector(F.lit("same"))
    assert many.select(fingerprints.combined(b, one) == a, fingerprints.combined(a, fingerprints.inverse(one)) == b).first()[:] == (True, True)
