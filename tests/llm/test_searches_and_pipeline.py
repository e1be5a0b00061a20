import datetime
import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from quantloom.llm import hilbert, html_extract, langid, maxscore, mixing, packing, pii, queries, simhash, url_filter
from quantloom.llm.common import content, drop_saved, saved, with_rank

VECS = "vec_id long, embedding array<float>, label int, uid long, shard int"


def vectors(n=260, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), 0, 1, 2) for i, v in enumerate(rng.normal(size=(n, dim)))]
    data[41] = (41, data[40][1], 0, 1, 2)  # equal vectors tie
    data += [data[20], data[20]]  # repeated rows of a query
    data += [(500, None, 0, 1, 2), (520, [], 0, 1, 2), (540, [None] * dim, 0, 1, 2), (560, [math.nan] * dim, 0, 1, 2), (580, [math.inf] * dim, 0, 1, 2), (600, [0.0] * dim, 0, 1, 2), (620, [1.0], 0, 1, 2)]
    return data + [(None, data[7][1], None, None, None)]


def usable(data, dim=12):
    return [(i, v) for i, v, *_ in data if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


def brute(data, score, zero=True):
    ok = [(i, v) for i, v in usable(data) if zero or any(v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % 20 == 0:
            top = sorted(((-score(q, v), math.inf if j is None else j) for b, (j, v) in enumerate(ok) if b != a))[:20]
            out += [(i, k + 1, None if j == math.inf else j, -s) for k, (s, j) in enumerate(top)]
    return sorted(out, key=str)


def whole(q, v):
    return sum(math.floor(64 * float(a)) * math.floor(64 * float(b)) for a, b in zip(q, v, strict=True))


def test_max_score_is_exact(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    data = vectors()
    got = sorted(map(tuple, maxscore.top_k(spark.createDataFrame(data, VECS)).collect()), key=str)
    assert got == brute(data, whole)


def test_max_score_prunes_exactly():
    rng = np.random.default_rng(3)
    for scale in (3, 50, 10**6):
        x = rng.integers(-scale, scale, (3000, 16)).astype(float) * (rng.random((3000, 16)) < 0.4)
        shard = maxscore.Shard(np.arange(3000), np.arange(3000), x, 20)
        for i in range(0, 3000, 300):
            place, score = shard.top(x[i], i, 20)
            s = x @ x[i]
            s[i] = -np.inf
            want = np.lexsort((np.arange(3000), -s))[:20]
            assert place.tolist() == want.tolist() and score.tolist() == s[want].tolist()


def test_large_components_are_cut_to_a_long(spark):
    data = [(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [1.0, 1.0]), (3, [-1e30, 0.0])]
    got = {r["vec_id"]: r["score"] for r in maxscore.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (1 << 63) - 1 and got[3] == -(1 << 63) and list(got) [0] == 1


def test_empty_vectors(spark):
    none = spark.createDataFrame([], VECS)
    assert maxscore.top_k(none).count() == 0 and hilbert.neighbours(none).count() == 0
    odd = spark.createDataFrame([(0, None, 0, 1, 2), (20, [1.0], 0, 1, 2)], VECS)
    assert maxscore.top_k(odd).count() == 0 and hilbert.neighbours(odd).count() == 0


def test_neighbours_with_all_ranges_are_exact(spark):
    data = vectors()
    got = sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in hilbert.neighbours(spark.createDataFrame(data, VECS), recall=1.0, ranges=2).collect()), key=str)
    want = brute(data, lambda q, v: float(np.dot(np.array(q, float), np.array(v, float))), zero=False)
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in sorted(((a, b, c, round(s, 9)) for a, b, c, s in want), key=str)]


def test_recall_of_windows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in hilbert.neighbours(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-12
    hits = 0
    for q, ids in found.items():
        s = x @ x[q]
        s[q] = -9
        hits += len(ids & set(np.argsort(-s)[:20].tolist()))
    assert len(found) == 150 and hits / (20 * len(found)) >= 0.9


def test_clustered_vectors_of_unequal_norms_need_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(5, 32))
    x = (rng.normal(size=(6000, 5)) @ base + 0.05 * rng.normal(size=(6000, 32))) * rng.uniform(0.9, 1.1, (6000, 1))
    x[:3] *= 20  # a few long ones
    plans, choose = [], hilbert.layout_for
    monkeypatch.setattr(hilbert, "layout_for", lambda *a: plans.append(choose(*a)) or plans[-1])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for y, most in ((x, 0.6), (unit, 0.3)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>")
        found = {}
        for r in hilbert.neighbours(df).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q in range(0, 6000, 20):
            s = y @ y[q]
            s[q] = -np.inf
            hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
        assert hits / 6000 >= 0.9 and plans[-1].scored < most, (hits / 6000, plans[-1].scored)


def test_hilbert_keys_are_a_path():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert.hilbert_key(side, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = side[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_equal_vectors_overfill_a_range(spark):
    data = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(300 + i, [0.0, 1.0, float(i)]) for i in range(50)]
    got = hilbert.neighbours(spark.createDataFrame(data, "vec_id long, embedding array<double>"), largest=32, ranges=4, recall=1.0).collect()
    assert {r["query_id"] for r in got} == set(range(0, 350, 20)) and [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(1, 21))


# URL filter.


def test_url_parts(spark):
    urls = ["http://User@WWW.Example.com.:80/a/b/?q#f", "//x.org", "ftp://h/p", "nothing", None, "", "https://h?x=http://y/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(url_filter.host(df.u), url_filter.path(df.u)).collect()]
    assert got == [("www.example.com", "/a/b"), ("x.org", ""), ("h", "/p"), ("", ""), ("", ""), ("", ""), ("h", "")]


def test_entries_hold_from_date_to_date(spark):
    day = lambda d: datetime.date(2024, 1, d)
    entries = [
        ("example.com", "domain", "block", day(5)), ("example.com", "domain", "lift", day(10)), ("a.example.com", "domain", "allow", day(7)), ("b.com/x", "prefix", "block", day(1)), ("b.com/x", "prefix", "block", day(1)),
        (None, "domain", "block", day(1)), ("c.com", "domain", "block", None), ("d.com", "domain", "block", day(3)), ("d.com", "domain", "allow", day(3)),
    ]
    caps = [
        (1, "http://x.example.com/", day(4), "none"), (2, "http://x.example.com/", day(5), "block"), (3, "http://x.example.com/", day(10), "none"), (4, "http://q.a.example.com/", day(8), "allow"),
        (5, "http://b.com/x/y", day(2), "block"), (6, "http://b.com/xy", day(2), "none"), (7, None, day(2), "none"), (8, "http://b.com/x", None, "none"), (9, "http://notexample.com/", day(6), "none"),
        (2, "http://x.example.com/", day(5), "block"), (None, "http://d.com", day(9), "allow"), (10, "http://c.com/" + "a/" * 5000, day(9), "none"),
    ]
    c = spark.createDataFrame([(i, u, t, "k") for i, u, t, _ in caps], "page_id long, url string, fetched date, kind string")
    e = spark.createDataFrame(entries, "pattern string, kind string, action string, since date")
    got = sorted(((r["id"], r["action"]) for r in url_filter.evaluate(c, e).collect()), key=str)
    assert got == sorted(((i, a) for i, _, _, a in caps), key=str)
    assert url_filter.evaluate(c.limit(0), e).count() == 0 and url_filter.evaluate(c, e.limit(0)).where("action = 'none'").count() == len(caps)


def test_hot_hosts_and_daily_lists(spark, monkeypatch):
    from quantloom.llm import common

    monkeypatch.setattr(common, "HOT", 20)
    first = datetime.date(2024, 1, 1)
    at = lambda i: first + datetime.timedelta(days=i % 60)
    captures = [(i, "http://hot.example.com/a" if i % 3 else f"http://h{i}.org/", at(i)) for i in range(400)]
    entries = [("hot.example.com", "domain", "block" if k < 30 else "allow", at(k)) for k in range(60)] + [("h30.org", "domain", "block", first)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    e = spark.createDataFrame(entries, "pattern string, kind string, action string, since date")
    assert sorted((r["action"], r["until"]) for r in url_filter.intervals(e).where("pattern = 'hot.example.com'").collect()) == [("allow", None), ("block", at(30))] or url_filter.intervals(e).count() == 3
    got = {r["id"]: r["action"] for r in url_filter.evaluate(c, e).collect()}
    assert got == {i: ("block" if i % 60 < 30 else "allow") if i % 3 else "block" if i == 30 else "none" for i, _, _ in captures}


# Helpers and pipeline.


def test_long_hosts_and_deep_paths_meet_their_entries(spark):
    host, path = ".".join(f"l{k}" for k in range(130)), "/".join(f"s{k}" for k in range(40))
    day = datetime.date(2024, 1, 2)
    entries = [(host, "domain", "block", day), (host + "/" + path, "prefix", "allow", day), ("l129", "domain", "block", day), (host + "/s0", "prefix", "block", day)]
    captures = [(1, f"http://{host}/", day), (2, f"http://{host}/{path}/more?q", day), (3, f"http://x.{host}/{path}", day), (4, "http://other.l129/", day), (5, f"http://{host}/s0/s1", day)]
    listed = spark.createDataFrame(entries, "pattern string, kind string, action string, since date")
    got = {r["id"]: (r["pattern"], r["action"]) for r in url_filter.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched date"), listed).collect()}
    assert got == {1: (host, "block"), 2: (host + "/" + path, "allow"), 3: (host, "block"), 4: ("l129", "block"), 5: (host + "/s0", "block")}
    assert {r["action"] for r in url_filter.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched date"), listed.limit(0)).collect()} == {"none"}


def test_rank_is_gapless_in_hot_groups(spark):
    df = saved(spark.createDataFrame([(None if i % 3 else i % 2, i % 4, i) for i in range(500)], "g int, o int, i long"))
    rows = with_rank(df, ["g"], 16, tie="i", order=["o"]).collect()
    for g in (None, 0, 1):
        part = sorted(((r["rank"], r["o"]) for r in rows if r["g"] == g))
        assert [k for k, _ in part] == list(range(len(part))) and [o for _, o in part] == sorted(o for _, o in part)
    drop_saved(df)


def corpus(spark):
    en, de = "the house and the river with the stone are there and it was good", "das haus und der fluss mit dem stein sind dort und es war gut"
    out = [(i, f"{en if i % 2 else de} number {chr(97 + i % 26) * (i % 9 + 1)} {chr(98 + i % 24) * (i % 7 + 2)} end", "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(60)]
    out += [(100, out[3][1], "en", "s0", 1), (101, None, None, None, None), (102, "12345 --", None, "s1", 1), (None, out[4][1], "de", "s1", 1), (103, en + " mail me at a.b@mail1.example.com today please", "en", "s2", 1)]
    return spark.createDataFrame(out + [out[5]], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stages_match_their_operators(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = saved(corpus(spark))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = saved(stages[0](spark, docs, ""))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in kept.collect()} == {101, 102}
    single = saved(stages[1](spark, kept, ""))
    groups = simhash.near_duplicates(kept).select("component").distinct().count()
    assert single.count() == groups and single.columns == docs.columns
    assert single.where("doc_id IS NULL OR doc_id = 100").count() == 0
    clean = saved(stages[2](spark, single, ""))
    assert clean.count() == groups and "<EMAIL>" in clean.where("doc_id = 103").first()["text"]
    untouched = {r["doc_id"]: r["text"] for r in single.where("doc_id <> 103").collect()}
    assert {r["doc_id"]: r["text"] for r in clean.where("doc_id <> 103").collect()} == untouched
    mix = saved(stages[3](spark, clean, ""))
    copies = {(r["doc_id"]): r["copies"] for r in mixing.mix(clean, mixing.words("text"), keep=["doc_id"]).collect()}
    counted = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert counted == {k: n for k, n in copies.items() if n} and mix.columns == docs.columns
    pieces = stages[4](spark, mix, "")
    assert pieces.where("piece = 0").count() == mix.count()
    empty = docs.limit(0)
    for f in stages:
        assert f(spark, empty, "").count() == 0


def test_stages_keep_columns_whose_names_clash(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["lang_pred", "LANG_SCORE", "row_number", "__row", "__pii_email", "found", "k0", "email", "new", "size", "copies", "tie", "component"]
    docs = corpus(spark).where("doc_id < 60")
    docs = saved(docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.select("doc_id", *names).collect()
        assert got and all(r[n] == f"{n} {r['doc_id']}" for r in got for n in names)


def test_rows_with_one_id_are_told_apart_by_what_they_hold(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, None, "some words of one text here", "s", 1), (1, "some words of one text here", None, "s", 1), (1, "quite another text stands in this row", None, "s", 1), (1, "quite another text stands in this row", None, "s", 1), (2, "quite another text stands in this row", None, "t", 1)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = sorted(map(tuple, corpus_pipeline.deduplicated(spark, docs, "").collect()), key=str)
    assert got == sorted({r for r in rows if r[0] == 1}, key=str)


def test_pipeline_matches_a_plain_one(spark, tmp_path):
    """The whole run against plain versions of the five stages."""
    import re
    import zlib

    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = corpus(spark)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    kept = []
    for r in docs.collect():
        lang, cosine = plain.nearest(r["text"], model.idf, model.langs, model.centroids, langid.BITS)
        letters = sum(ch.isalpha() for ch in r["text"] or "")
        if lang != "und" and cosine >= model.floors[int(langid.length_class(np.array([letters]))[0])]:
            kept.append((r["doc_id"], r["text"], lang, r["source"], r["n_chars"]))
    fps = [plain.fingerprint(t) for _, t, *_ in kept]
    label, first = plain.components(list(set(fps))), {}
    for row, fp in zip(kept, fps):
        key = (row[0] is None, row[0])
        if label[fp] not in first or key < first[label[fp]][0]:
            first[label[fp]] = (key, row)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")  # the one kind of personal data in this corpus
    clean = []
    for _, (i, text, lang, source, n) in first.values():
        new = email.sub("<EMAIL>", text)
        clean.append((i, new, lang, source, len(new) if new != text else n))
    table = spark.createDataFrame(clean, docs.schema)
    cells, tie = 16, content(table)[0]
    place = F.struct(F.floor(F.log2(mixing.words("text") + 1) * 64), F.pmod(F.xxhash64(tie), F.lit(cells)), tie)
    copies = plain.sampled([(r["doc_id"], r["source"], plain.words(r["text"]), tuple(r["place"])) for r in table.withColumn("place", place).collect()])
    tok, want = Tokenizer.from_file(queries.tokenizer_path()), []
    for i, text, *_ in clean:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want += [(i, s // 2048, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] * copies[i]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and len(want) > 30
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in fill.values())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert html_extract.extract("") == "" and pii.KINDS[0] == "email" and packing.plan({}, 4)[1] == 0
