import random
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from quantloom.llm import common, html_extract, langid, mixing, packing, queries, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp string, __at long"
WORDS = "alpha beta gamma delta one two three four house tree river stone".split()


def rows(n=60, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 8, 40, 300])))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ß", None]), len(text), 1, 2, "x", 3))
    out += [(100, None, None, None, None, None, None, None, None), (None, "alpha beta", "en", "a", 10, 1, 2, "x", 3), (101, "", "en", "a", 0, 1, 1, "", 1)]
    out += [out[5], out[5], (102, "long " * 30000, "en", "b", 150000, 1, 1, "", 1), (103, " \t\n", "en", "b", 3, 1, 1, "", 1), (104, "Ärger ÉTÉ 😀 <|endoftext|>", "de", "a", 9, 1, 1, "", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Packing.


def test_plan_places_every_piece_once_and_tightly():
    rng = random.Random(1)
    for _ in range(150):
        cap = rng.choice([12, 30, 100, 2048])
        counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
        runs, n = packing.plan(counts, cap)
        fill, seen = {}, dict.fromkeys(counts, 0)
        for k, first, many, per, seq, off in runs:
            assert first == seen[k]
            seen[k] += many
            for j in range(many):
                fill.setdefault(seq + j // per, []).append((off + j % per * k, k))
        assert seen == counts and sorted(fill) == list(range(n))
        for parts in fill.values():
            parts.sort()
            assert [o for o, _ in parts] == list(np.cumsum([0, *[k for _, k in parts]])[:-1]) and sum(k for _, k in parts) <= cap
            assert sum(3 * k > cap for _, k in parts) <= 2
        assert n <= 1.3 * -(-sum(k * m for k, m in counts.items()) // cap) + 1 or any(2 * k > cap for k in counts)


def test_matching_is_optimal_for_pairs():
    assert packing.plan({70: 1, 60: 1, 40: 1, 35: 1}, 100)[1] == 3 and packing.plan({60: 1, 50: 1, 40: 1}, 100)[1] == 2
    assert packing.plan({}, 10) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_pack_matches_the_tokenizer(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in rows():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        want = {(k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(pieces)}
        assert want == {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[doc_id]}
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    assert packing.pack(empty, path).count() == 0


def test_ids_of_letters_that_change_when_normalised():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, ids = Tokenizer.from_file(path), packing._ids_of(path)
    rng = random.Random(11)
    some = "İıßŞşÇç\u0958\u0345\u0307éÅΣς\u1e9eaIiZ09" + "".join(chr(rng.randrange(0xA1, 0x3000)) for _ in range(60))
    texts = ["İ.", "Aİ,", "İZMİR'İ.", "\u0958!", "ﬁ.", "a\u0301."]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(1, 6))) + "".join(rng.choice(".,;'!?-=<") for _ in range(rng.randint(0, 3))) + rng.choice(["", " x", "\u0338"]) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(packing.token_bytes(t.encode(), ids), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_places_hold_when_executors_change(spark):
    """Two scans of one table that are split in other ways still agree."""
    texts = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id % 7, repeat(' x', CAST(id % 50 AS INT))) AS text", "'s' AS source").repartition(3)
    conf, path = spark.conf, queries.tokenizer_path()
    packed, cut = packing.pack(texts, path), sharding.shard_by_bytes(texts)
    seen = []
    try:
        for parts in (1, 16):
            conf.set("spark.sql.files.openCostInBytes", "64")
            conf.set("spark.sql.files.maxPartitionBytes", "2000" if parts > 1 else "128MB")
            conf.set("spark.sql.files.minPartitionNum", parts)
            for df in (packed, cut):
                fresh = df.select("*")  # planned anew, over the same written tables
                seen.append(sorted(tuple(r) for r in fresh.select(*[c for c in fresh.columns if c != "grown_shard"]).collect()))
    finally:
        for c in ("openCostInBytes", "maxPartitionBytes", "minPartitionNum"):
            conf.unset(f"spark.sql.files.{c}")
    assert seen[0] == seen[2] and seen[1] == seen[3] and len(seen[0]) == 3000
    slots = {}
    for r in seen[1]:
        slots.setdefault(r[4], []).append(r[5])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


# SimHash.


def test_near_duplicates_match_brute_force(spark, empty):
    data = rows()
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(400)).split()
    for k in range(40):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed"
        data.append((1000 + k, " ".join(w), "en", "a", 1, 1, 1, "", 1))
    docs = spark.createDataFrame(data, DOCS)
    fps = {}
    for i, text, *_ in data:
        fps.setdefault(plain.fingerprint(text), []).append(i)
    label = plain.components(list(fps))
    least = {}
    for f, ids in fps.items():
        known = [i for i in ids if i is not None]
        if known:
            least[label[f]] = min([least.get(label[f], min(known)), *known])
    want = sorted((str(i), f, least.get(label[f])) for f, ids in fps.items() for i in ids)
    got = sorted((str(r["id"]), r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_large_groups_are_dealt_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = random.Random(9)
    center = rng.getrandbits(64)
    codes = {center ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 5))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(df, len(codes))).collect()}
    label = plain.components(list(codes))
    groups = lambda f: {frozenset(x for x in codes if f(x) == k) for k in {f(x) for x in codes}}
    assert groups(lambda c: roots.get(c, c)) == groups(label.get)


def test_block_choices_miss_no_pair():
    rng = random.Random(2)
    for blocks in (5, 6, 7):
        masks = simhash.choices(4, blocks)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not x & m for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 400}


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    monkeypatch.setattr(common, "MOST_HOT", 5)
    edges = spark.createDataFrame([(i, 0) for i in range(1, 120)] + [(i, i + 1) for i in range(200, 230)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 120)} | {i: 200 for i in range(201, 231)}
    docs = spark.createDataFrame([(i, "same text in many rows" if i % 3 else f"text {i} of {i * i} its {i * 7} own {i * 31}") for i in range(300)] + [(900, None)], "doc_id long, text string")
    got = {r["id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 301 and all(got[i][1] == 1 for i in range(300) if i % 3)
    label = plain.components(list({f for f, _ in got.values()}))
    assert len({c for _, c in got.values()}) == len(set(label.values()))


# Language.


def test_language_ids(spark, empty):
    en, de = "the house and the river with the stone are there", "das haus und der fluss mit dem stein sind dort"
    data = [(i, f"{en if i % 2 else de} {'and then ' * (i % 5) if i % 2 else 'und dann ' * (i % 5)}", "en" if i % 2 else "de") for i in range(80)]
    train = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(train)
    test = spark.createDataFrame([(1, "the stone and the house", "x"), (2, "das haus und der stein", "x"), (3, None, "x"), (4, "123 -- !!", "x"), (5, "", "x"), (5, "", "x"), (None, "the " * 50000, None)], "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"], r["lang_rejected"]) for r in langid.identify(test, model).orderBy(F.desc("doc_id")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "en", False), (2, "de", False), (3, "und", True), (4, "und", True), (5, "und", True), (5, "und", True), (None, "en", got[-1][2])]))
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(train.where("false"))
    assert {r["lang_pred"] for r in langid.identify(test, nothing).collect()} == {"und"}
    scores = [r["lang_score"] for r in langid.identify(test, model).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_long_foreign_texts_are_rejected_and_short_clean_ones_are_not(spark):
    path = "/root/testdata/sf0.01"
    import os

    if not os.path.isdir(path):
        pytest.skip("no test tables")
    model = langid.fit(spark.read.parquet(f"{path}/documents.parquet").where(~langid.held_out("doc_id")))
    rng = random.Random(3)
    foreign = []
    for first, n in ((0x430, 32), (0x4E00, 3000), (0x3B1, 24), (0x627, 28)):
        for words in (500, 3000):
            foreign += [" ".join("".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(2, 9))) for _ in range(words)) for _ in range(3)]
    assert all(model.predict(foreign)[2])
    assert not any(model.predict(["The house and the river", "Das Haus und der Fluss", "La maison et la rivière", "La casa y el río"])[2])


def test_no_language_is_left_out_in_silence(spark):
    docs = spark.createDataFrame([(i, "alpha beta", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.fit(docs, most_langs=3)
    assert set(langid.fit(docs, most_langs=4).langs) == {"l0", "l1", "l2", "l3"}
    many = spark.createDataFrame([(i, " ".join(chr(0x4E00 + 40 * (i % 230) + (i + k) % 40) * 2 for k in range(20)), f"l{i % 230}") for i in range(460)], "doc_id long, text string, lang string")
    model = langid.fit(many)
    assert set(model.langs) == {f"l{i}" for i in range(230)}
    assert model.predict([many.where("doc_id = 229").first()["text"]])[0] == ["l229"]


def test_predictions_match_a_plain_nearest_centroid(spark):
    model = langid.fit(spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, (_, t, *_) in enumerate(rows()) if t], "doc_id long, text string, lang string"))
    texts = [t for _, t, *_ in rows()] + ["Zwölf Boxkämpfer jagen Viktor", "a", "ab", "東京 都", "x1y2 z", "ß" * 40]
    langs, scores, _ = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        name, cosine = plain.nearest(text, model.idf, model.langs, model.centroids, langid.BITS)
        assert abs(score - cosine) < 1e-4 and (lang == name or text and cosine < 1e-6)


def test_a_sample_is_bounded_by_repeated_rows_too(spark):
    docs = spark.createDataFrame([(7, f"alpha beta {'x' * (i % 5)}", "en") for i in range(300)], "doc_id long, text string, lang string")
    assert set(langid.fit(docs, sample_per_lang=20).langs) <= {"en"}


def test_grams_do_not_cross_documents():
    both, _ = langid.counts(["abc def", "ghi"])
    one, two = langid.counts(["abc def"])[0], langid.counts(["ghi"])[0]
    assert (both[0] == one[0]).all() and (both[1] == two[0]).all()
    assert (langid.counts(["ABC, def!"])[0] == langid.counts(["abc def"])[0]).all()


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(path):
        pytest.skip("no test tables")
    found = queries.op4_centroid_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.9 * found.count()


# Sharding.


def test_shards_are_minimax_and_keep_groups(spark, docs, empty):
    got = sharding.shard_by_bytes(docs).collect()
    data = rows()
    assert len(got) == len(data)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert set(per) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert all(len({r["shard"] for r in got if r["text_crc32"] == c}) == 1 for c in {r["text_crc32"] for r in got})
    assert sharding.shard_by_bytes(empty).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 30) if rng.random() < 0.9 else rng.randint(50, 300) for _ in range(rng.randint(0, 30))]
        prefix, k = sharding.Prefix([(10 * i, 10 * i + 10, s, True) for i, s in enumerate(sizes)]), rng.randint(1, 8)
        least = prefix.least(k, max([-(-prefix.total // k), *sizes]), prefix.total)
        sums, best = np.cumsum([0, *sizes]), [0] + [10**9] * len(sizes)
        for _ in range(k):
            best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
        assert best[-1] == least
        ends = [0, *prefix.cut(least, k), len(sizes)]
        assert max(sums[b] - sums[a] for a, b in zip(ends, ends[1:])) <= least


def test_refined_cuts_equal_exact_ones(spark):
    rng = random.Random(4)
    groups = [((rng.getrandbits(20) << 44) - (1 << 63), rng.randint(1, 500)) for _ in range(400)]
    groups = list({k: (k, s) for k, s in groups}.values())
    cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, size long"), 5)
    order = sorted((k % (1 << 64), s) for k, s in groups)
    prefix = sharding.Prefix([(k, k + 1, s, True) for k, s in order])
    least = prefix.least(5, 1, prefix.total)
    bounds = [0, *cuts, 1 << 64]
    assert max(sum(s for k, s in order if a <= k < b) for a, b in zip(bounds, bounds[1:])) == least


# Mixing.


def test_targets_are_filled_by_weight():
    t = mixing.targets({"a": 100, "b": 10, "c": 400, None: 50})
    assert sum(t.values()) == 560 and t["b"] == 30 and all(t[k] <= 3 * v for k, v in {"a": 100, "b": 10, "c": 400, None: 50}.items())
    assert t["c"] / 3 == t["a"] == t[None]
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_mix_meets_targets_and_repeats(spark, docs, empty):
    big = spark.createDataFrame([(i, "w " * (1 + i % 50), "en", "abc"[min(2, i % 7)], 1, 1, 1, "", 1) for i in range(3000)], DOCS)
    run = lambda d: mixing.mix(d, mixing.words("text"), keep=["doc_id", "size"])
    got = run(big).collect()
    per = {}
    for r in got:
        per.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * (1 + r["doc_id"] % 50)
    assert all(abs(t - n) <= 0.01 * t for t, n in per.values())
    assert sorted(got) == sorted(run(big.repartition(7, "size")).collect())
    assert run(docs).count() == docs.count() and run(empty).count() == 0


def test_mix_matches_a_plain_sampler(spark, docs):
    from pyspark.sql import functions as F

    listed = docs.dropDuplicates()
    cells, tie = common.cells_for(listed.count(), 20_000, 16), common.content(listed)[0]
    place = F.struct(F.floor(F.log2(F.coalesce(mixing.words("text"), F.lit(0)) + 1) * 64), F.pmod(F.xxhash64(tie), F.lit(cells)), tie)
    rows_ = [((r["doc_id"], r["text"]), r["source"], plain.words(r["text"]), tuple(r["place"])) for r in listed.withColumn("place", place).collect()]
    want = plain.sampled(rows_)
    got = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mix(listed, mixing.words("text"), keep=["doc_id", "text"]).collect()}
    assert got == want and sum(got.values()) > 0


# Pages.


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<", ""), ("<script>var t='</p>';</script>", ""),
        ("<nav><a href=/x>Home</a></nav><article><h1>A  title</h1><p><b>One &amp; two are\n here.<p>Three, four.</article><footer>&copy; me</footer>", "A title\nOne & two are here.\nThree, four."),
        ("<div class='cookie-notice'>We use cookies on this site for many things that you like.</div><main><p>The main text is here and is long.</p></main><aside>See also these other pages.</aside>", "The main text is here and is long."),
        ("<article><p>Real text is here for you to read.</p></article><div id=comments><p>I liked it very much and will come again.</p></div>", "Real text is here for you to read."),
        ("<form><p>Your name and your address please, so that we can write.</p></form>", ""),
        ("<p>a line &lt;b&gt; with &eacute;&#233; and a sign that is not a tag: 1 < 2 and so on.</p>", "a line <b> with éé and a sign that is not a tag: 1 < 2 and so on."),
        ("<!-- <p>not this one, it is a comment and long enough.</p> --><p>This one is the text of the page, of course.</p>", "This one is the text of the page, of course."),
    ],
)
def test_extraction(page, text):
    assert html_extract.extract(page) == text


def test_the_cut_decides_where_a_block_alone_would_not():
    body = "<p>This paragraph has enough words of its own to be the text of a page, as anyone can see.</p>"
    caption = f"<div>{body}<p>A caption</p>{body}</div>"
    found = html_extract.blocks(caption)
    assert [html_extract.score(b) > 0 for b in found] == [True, False, True] and html_extract.labels(found) == [True] * 3
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(4))
    menu = f"<ul>{links}<li>More words are here.</li>{links}</ul>{body}"
    found = html_extract.blocks(menu)
    assert html_extract.score(found[4]) > 0 and html_extract.labels(found) == [False] * 9 + [True]


def test_unclosed_players_do_not_hide_the_rest():
    text = "The text of the page comes after an element that is never closed."
    for tag in ("<video src=x>", "<canvas id=c />", "<object data=x>", "<audio>", "<svg>"):
        assert html_extract.extract(f"<body>{tag}<article><p>{text}</p></article>") == text
    assert html_extract.extract(f"<body><script>var x = 1;<article><p>{text}</p></article>") == ""


def test_min_cut_matches_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 8)
        src, snk = ([rng.randint(0, 20) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.randint(0, 15)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda s: sum(snk[i] if s >> i & 1 else src[i] for i in range(n)) + sum(c for a, b, c in edges if (s >> a & 1) != (s >> b & 1))  # noqa: B023, E731
        side = html_extract.min_cut(src, snk, edges)
        assert cost(sum(1 << i for i, x in enumerate(side) if x)) == min(map(cost, range(1 << n)))


def test_pages_keep_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Some words that make a sentence here.</p>", "old"), (None, None, None, None), (1, "u", "<div>" * 3000 + "x" * 10, "old")], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 3
    assert sorted(r["text"] for r in got.collect())[-1] == "Some words that make a sentence here."
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
