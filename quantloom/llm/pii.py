"""Personal data by candidate generation and gradient-boosted trees, in DataFrame operations alone.

Base spans follow fixed rules. Besides, wide generators propose overlapping candidates (spelled-out addresses, odd separators). A candidate is
described by ten yes/no features of format and context for its kind, so all candidates of all documents aggregate to
at most 4 x 1024 x 4 counts; the driver boosts trees on these counts and calibrates a threshold for each kind.

Labels come from the base rules and validators, from evidence apart from them, and from a bounded list of labelled
sentences (``SEEDS``), which stand for what a corpus may not show: national and spelled-out forms, versions, dates and part numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_table

KINDS = ("email", "ip", "card", "phone")

# Leftmost matches of the stated patterns. Possessive loops give the same matches without a growing stack, and the look at
# the character before keeps a run that failed from being tried again at each of its places.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of these has no match of the pattern that counts.
MAYBE = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]{7}"}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:[.,]|\x20?[(\[](?:\.|dot)[)\]]\x20?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9])\+?\(?[0-9][0-9\x20().-]{6,}[0-9]",
}
MAYBE_WIDE = {
    "email": r"@[A-Za-z0-9\x20-]|[(\[{]at[)\]}]",
    "ip": r"[0-9][.,][0-9]{1,3}[.,][0-9]|[0-9]\x20?[(\[](?:\.|dot)[)\]]",
    "card": r"[0-9](?:[\x20.-]{0,2}[0-9]){11}",
    "phone": r"[0-9][0-9\x20().-]{6}",
}
SPAN = "struct<s:int,e:int,v:string,b:string,a:string>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, with ``x`` evaluated once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers. Steps of 1, 2, 4, ... places make n log n operations of a fold that would copy n arrays."""

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, combine(x, F.get(acc, i - back))).otherwise(x))

    rounds = lambda v: F.sequence(F.lit(0), F.floor(F.log2(F.size(v))).cast("int"))
    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(rounds(v), v, step)))


def located(text: Column, pattern: str, maybe: str) -> Column:
    """Matches from left to right as (s, e, v, b, a): code points, the match, and 24 and 8 characters around it.

    Splitting at the matches gives what lies between them; running sums of the lengths give their places.
    """
    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))

    def spans(p: Column) -> Column:
        lengths = F.zip_with(F.slice(p["g"], F.lit(1), F.size(p["h"])), p["h"], lambda g, h: F.char_length(g) + F.char_length(h))
        one = lambda ends: lambda h, i: F.struct(
            (F.get(ends, i) - F.char_length(h)).alias("s"), F.get(ends, i).alias("e"), h.alias("v"), F.right(F.get(p["g"], i), F.lit(24)).alias("b"),
            F.left(F.coalesce(F.get(p["g"], i + 1), F.lit("")), F.lit(8)).alias("a"),
        )
        return let(running(lengths, lambda x, y: x + y), lambda ends: F.transform(p["h"], one(ends)))

    return F.when(text.rlike(maybe), let(both, spans)).otherwise(F.expr("array()")).cast(f"array<{SPAN}>")


def starting_before(spans: Column, x: Column) -> Column:
    """How many of ``spans``, which lie in order, start before ``x``: a binary search."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        less = F.get(spans, mid)["s"] < x
        return F.struct(F.when(open_ & less, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~less, mid).otherwise(acc["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(spans))).cast("int") + 1)
    return F.when(F.size(spans) == 0, 0).otherwise(F.aggregate(rounds, zero, step, lambda acc: acc["lo"]))


def touches(spans: Column, x: Column) -> Column:
    """Whether ``x`` has a place in common with one of ``spans``, which lie in order and apart from each other."""
    return F.coalesce(F.get(spans, starting_before(spans, x["e"]) - 1)["e"] > x["s"], F.lit(False))


def equals(spans: Column, x: Column) -> Column:
    return let(F.get(spans, starting_before(spans, x["s"])), lambda y: F.coalesce((y["s"] == x["s"]) & (y["e"] == x["e"]), F.lit(False)))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]+", "")


def luhn(v: Column) -> Column:
    d = F.reverse(digits(v))

    def add(acc: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPELLED = r"\x20?[(\[{](?:\.|dot)[)\]}]\x20?"
OCTETS = rf"^(?:{BYTE}|0+)(?:(?:[.,]|{SPELLED})(?:{BYTE}|0+)){{3}}$"
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(OCTETS),
    "card": lambda v: F.length(digits(v)).between(12, 19) & luhn(v),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    valid = lambda k: lambda x: VALID[k](x["v"])
    return {k: F.filter(located(text, BASE[k], MAYBE[k]), valid(k)) for k in KINDS}


def features(kind: str, x: Column) -> list[Column]:
    """Ten yes/no features of a candidate."""
    v, before, after = x["v"], x["b"], x["a"]
    n = F.length(digits(v))
    glued = [before.rlike(r"[\p{L}\p{N}_]$"), after.rlike(r"^[\p{L}\p{N}_]")]
    word = lambda w: before.rlike(rf"(?i)\b(?:{w})\b[^\p{{L}}]*$")
    return {
        "email": lambda: [
            v.rlike(r"\.[A-Za-z0-9-]+\."), v.rlike(r"^[A-Za-z0-9]"), v.rlike(r"[A-Za-z]{2,}$"), v.rlike(r"^[^@(\[{]*[0-9]"), v.rlike(SPELLED), v.rlike(r"^[A-Za-z]+\."), *glued,
            word("e-?mail|mail|contact|write|to|correo|courriel"), v.contains(" "),
        ],
        "ip": lambda: [
            v.rlike(OCTETS), v.contains(","), v.rlike(r"^[1-9]"), v.rlike(r"(?:^|[.,])0[0-9]"), before.rlike(r"[0-9][.,]$|\.$"), after.rlike(r"^[.,][0-9]"), v.rlike(SPELLED), reduce(or_, glued),
            word("ip|host|server|address|login|from"), word("v|version|section|rev|release"),
        ],
        "card": lambda: [
            luhn(v), n.between(13, 16), v.rlike(r"^[3-6]"), v.rlike(r"^[0-9]{4}(?:[\x20-][0-9]{4}){2,3}$"), v.rlike(r"^[0-9]+$"), v.contains("."), v.rlike(r"[\x20.-]{2}"), *glued,
            word("card|visa|credit|account|karte|tarjeta|carte|no"),
        ],
        "phone": lambda: [
            before.rlike(r"[:\n]\x20?$|^$"), v.contains("("), v.rlike(r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"), n.between(9, 15), n.between(10, 11), v.rlike(r"^[0-9.]+$"), before.rlike(r"[0-9].{0,2}$"),
            *glued, word("tel|phone|call|fax|mobile|telefon|teléfono|cell"),
        ],
    }[kind]()


def evident(kind: str, x: Column) -> Column:
    """Evidence apart from the base rules that a candidate of valid format is of its kind."""
    v, f = x["v"], features(kind, x)
    return {
        # A spelled-out sign in brackets with a spelled-out dot or a word for it, and a domain that ends as domains do.
        "email": lambda: v.rlike(r"[(\[{]at[)\]}]") & v.rlike(r"(?:\.|[)\]}]\x20?)[A-Za-z]{2,}$") & (f[4] | f[8]),
        "ip": lambda: (f[8] | f[6]) & ~f[9] & ~v.contains(","),
        "card": lambda: f[9] & f[1] & ~f[7] & ~f[8],
        # A national number in groups of 3, 3 and 4, in brackets or after a word for it.
        "phone": lambda: v.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{0,2}[0-9]{3}[\x20.-][0-9]{4}$") & (f[1] | f[9]) & ~f[7] & ~f[8],
    }[kind]()


def candidates(text: Column, base: dict[str, Column]) -> Column:
    """All candidates as (k, s, e, mask, label): 1 equals a base span or has evidence of its own, 0 breaks a rule or lies on another kind, null is open."""

    def described(i: int, k: str) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            same = equals(base[k], x)
            cross = reduce(or_, [touches(base[o], x) for o in KINDS if o != k])
            wrong = cross | ~VALID[k](x["v"]) if k != "email" else cross
            mask = sum((F.when(f, 1 << b).otherwise(0) for b, f in enumerate(features(k, x))), F.lit(0))
            return F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), mask.alias("mask"), F.when(same, 1).when(wrong, 0).when(evident(k, x), 1).alias("label"))

        return one

    return F.concat(*[F.transform(located(text, WIDE[k], MAYBE_WIDE[k]), described(i, k)) for i, k in enumerate(KINDS)])


def numbered(base: dict[str, Column]) -> Column:
    """Base spans of all kinds as (s, k, e), k the kind's place."""
    plain = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))
    return F.concat(*[F.transform(base[k], plain(i)) for i, k in enumerate(KINDS)])


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, damp: float = 1.0):
    """A regression tree over yes/no columns: (feature, no, yes) or a leaf value."""
    g, h = grad.sum(), hess.sum()
    leaf = -g / (h + damp)
    if not depth:
        return leaf
    gy, hy = x.T @ grad, x.T @ hess
    gain = gy**2 / (hy + damp) + (g - gy) ** 2 / (h - hy + damp) - g**2 / (h + damp)
    best = int(gain.argmax())
    if gain[best] < 1e-6:
        return leaf
    yes = x[:, best]
    return best, _tree(x[~yes], grad[~yes], hess[~yes], depth - 1), _tree(x[yes], grad[yes], hess[yes], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]], _value(tree[2], x), _value(tree[1], x))


def boost(masks: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> np.ndarray:
    """Probability of each of the 1024 masks from trees boosted on weighted counts of good and bad candidates."""
    bits = lambda m: ((m[:, None] >> np.arange(10)) & 1).astype(bool)
    x, everything = bits(masks), bits(np.arange(1024))
    prior = math.log((good.sum() + 0.5) / (bad.sum() + 0.5))
    f, out, n = np.full(len(x), prior), np.full(1024, prior), good + bad
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = _tree(x, n * p - good, n * p * (1 - p), depth)
        f, out = f + rate * _value(tree, x), out + rate * _value(tree, everything)
    return 1 / (1 + np.exp(-out))


def choose(counts: list[tuple[int, int, int | None, bool, float]], precision: float = 0.99) -> dict[int, list[int]]:
    """For each kind the masks that pass. ``counts``: kind, mask, label, whether it calibrates, candidates.

    Open candidates teach nothing. The threshold is the least probability at which, among the
    candidates kept for calibration, at least ``precision`` of the weight is good; without such there is none.
    """
    out: dict[int, list[int]] = {}
    for i in range(len(KINDS)):
        sums = np.zeros((2, 2, 1024))  # fit or calibrate; bad or good
        for k, mask, label, calibrates, n in counts:
            if k == i and label is not None:
                sums[int(calibrates), int(label == 1), mask] += n
        seen = np.flatnonzero(sums[0].sum(0))
        out[i] = []
        if not len(seen) or not sums[0, 1].sum():
            continue
        p = boost(seen, sums[0, 1, seen], sums[0, 0, seen])
        order = np.argsort(-p, kind="stable")
        good, bad = np.cumsum(sums[1, 1, order]), np.cumsum(sums[1, 0, order])
        fine = np.flatnonzero((good > 0) & (good >= precision * (good + bad)))
        if len(fine):
            least = max(0.5, p[order[fine[-1]]])
            out[i] = [int(m) for m in np.flatnonzero(p >= least)]
    return out


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns as k0, k1, ...; base spans by kind; candidates; the fold. Whole texts are read; null is empty."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumns(base_spans(F.col("t")))
    rows = rows.withColumn("found", candidates(F.col("t"), {k: F.col(k) for k in KINDS}))
    return rows.withColumn("calibrates", F.pmod(F.xxhash64("t"), F.lit(4)) == 0).drop("t")


# Labelled sentences: what stands in «» is personal data of the kind before it, any other candidate in them is not.
SEEDS = """
Write to email«john.smith (at) example (dot) com» today.
You get me under email«anna[at]firma[dot]de» on most days.
Kontakt: email«m.weber {at} uni-mail {dot} edu» oder im Büro.
contact email«sales(at)shop.example.org» for a price
e-mail email«k99 [at] post.example.net» please
She looked (at) this.one and went on.
We meet [at] noon.then we eat.
It stood (at) 3.14 and rose (at) 2.71 later.
Turn [at] 10.30 or (at) page.12 as you like.
The host ip«10[.]0[.]0[.]17» was blocked.
They came in from ip«192(dot)168(dot)4(dot)20» at night.
traffic to ip«203 [.] 0 [.] 113 [.] 9» was dropped
Version 1,2,3,4 came out and section 4,1,0,2 was cut.
Scores of 12,40,7,33 and 1,1,2,3 were read out.
Sizes 10,20,30,40 are held in stock.
release 3[.]4[.]0[.]1 is old
card card«4111.1111.1111.1111» was charged
visa card«4012 8888  8888 1881» on file
Carte : card«5105.1051.0510.5100» merci
Serial 4111.1111.1111.1111.2 of the pump
Call phone«(604) 555-8016» after six.
tel phone«604-555-8016» or fax phone«604 555 8017»
Phone: phone«604.555.8018» in the week
Rufen Sie an: Telefon phone«(030) 555-1234» bitte.
My number is phone«(212) 555-0100», ring me.
mobile phone«312-555-0123» is best
On 2024.11.28 10.30 and on 2024-11-28 it rained.
Dates 28.11.2024 08.15 and 01-02-2023 12.00 are free.
Part 7001555012 and order 2023 1145 9987 were sent.
About 1 000 000 000 people and 12.345.678.901 coins.
It is 3.1415926535 and 2.7182818284 to ten places.
ISBN 978-3-16-148410-0 and 0-306-40615-2 are books.
Tracking 12 3456 7890 1234 56 and lot 555-0100-22-33.
Rows 100-200-3000 and 604-555-80161 are codes; so is 1604-555-8016.
doi 10.1000.182.2020 and 10.1234.5678 lead to papers.
"""
MARK = r"(?:(email|ip|card|phone)«([^»]*)»)"
_SEEDED: list[list[tuple[int, int, int]]] = []


def seeded(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(kind, mask, label) of all candidates of the labelled sentences, from the same scan as that of the documents."""
    if not _SEEDED:
        lines, good = [], set()
        for i, line in enumerate(SEEDS.strip().split("\n")):
            text, end = "", 0
            for m in re.finditer(MARK, line):
                text += line[end : m.start()]
                good.add((i, KINDS.index(m[1]), len(text), len(text) + len(m[2])))
                text, end = text + m[2], m.end()
            lines.append((i, text + line[end:]))
        found = scan(small_table(spark, lines, "i int, text string"), ["i"]).select("k0", F.explode("found").alias("x")).select("k0", "x.*").collect()
        _SEEDED.append([(r["k"], r["mask"], int((r["k0"], r["k"], r["s"], r["e"]) in good)) for r in found])
    return _SEEDED[0]


def learn(scanned: DataFrame) -> dict[int, list[int]]:
    """Fit and calibrate on all candidates; only their bounded counts reach the driver. The labelled sentences weigh as much as
    all labelled candidates of their kind together, and 50 candidates each at least.
    """
    each = scanned.select("calibrates", F.explode("found").alias("x")).groupBy("x.k", "x.mask", "x.label", "calibrates").agg(F.count(F.lit(1)).alias("n"))
    counts = [tuple(r) for r in each.collect()]
    seeds = seeded(scanned.sparkSession)
    for i in range(len(KINDS)):
        own = [(mask, label) for k, mask, label in seeds if k == i]
        for fold in (False, True):
            weight = max(50.0, sum(c[4] for c in counts if c[0] == i and c[2] is not None and c[3] == fold) / max(1, len(own)))
            counts += [(i, mask, label, fold, weight) for mask, label in own]
    return choose(counts)


def all_spans(model: dict[int, list[int]], base: dict[str, Column], found: Column) -> Column:
    """Base spans and the candidates that pass and touch none of them, as (s, k, e) by start and kind."""
    passes = lambda x: reduce(or_, [(x["k"] == i) & x["mask"].isin(m) for i, m in model.items() if m], F.lit(False))
    new = F.filter(found, lambda x: passes(x) & ~reduce(or_, [touches(base[k], x) for k in KINDS]))
    return F.array_sort(F.concat(numbered(base), F.transform(new, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))


def listed(spans: Column) -> Column:
    """kind:start:end of (s, k, e) spans, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"], x["e"])), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans): one row for each row of ``docs``.

    A null or empty text has no span. Copies get equal spans; null ids and repeated rows stay; other columns are not
    read; an empty table gives no rows.
    """
    scanned = saved(scan(docs, [id_col], text_col))
    model = learn(scanned)
    base = {k: F.col(k) for k in KINDS}
    return scanned.select(
        F.col("k0").alias("id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], listed(F.array_sort(numbered(base))).alias("base"), listed(all_spans(model, base, F.col("found"))).alias("spans")
    )


CHUNK = 1024


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that (s, k, e) spans cover replaced by the kind of its first span in angle brackets.

    ``spans`` lie in order. What lies between them is cut from chunks of the text, so that no cut walks through the whole of it.
    """
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def replaced(p: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            near = F.array_join(F.slice(p["chunks"], first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(b > a, near.substr(a - first * CHUNK + 1, b - a)).otherwise(F.lit(""))

        before = lambda i: F.coalesce(F.when(i > 0, F.get(p["reach"], i - 1)), F.lit(0))
        one = lambda x, i: F.when(x["s"] >= before(i), F.concat(part(before(i), x["s"]), F.element_at(name, x["k"] + 1))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(p["spans"], one), ""), part(F.element_at(p["reach"], -1), F.char_length(text)))

    reach = lambda v: running(F.transform(v, lambda x: x["e"]), F.greatest)
    all_of = lambda v: F.struct(v.alias("spans"), reach(v).alias("reach"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"))
    return let(spans, lambda v: F.when(F.size(v) == 0, text).otherwise(let(all_of(v), replaced)))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; null texts, all other columns and all rows stay.

    ``length_col``, if given, is the length of the new text where that changed. Copies change alike, null ids and repeated rows
    stay; an empty table gives no rows. The rows are written once, with what was found, under names that cannot clash.
    """
    kept = docs.columns
    scanned = saved(scan(docs, kept, text_col))
    spans = all_spans(learn(scanned), {k: F.col(k) for k in KINDS}, F.col("found"))
    old = F.col(f"k{kept.index(text_col)}")
    out = scanned.withColumn("new", F.when(old.isNotNull(), redacted(old, spans)))

    def column(i: int, c: str) -> Column:
        if c == text_col:
            return F.col("new").alias(c)
        if c == length_col:
            return F.when(F.col("new") != old, F.char_length("new").cast(docs.schema[c].dataType)).otherwise(F.col(f"k{i}")).alias(c)
        return F.col(f"k{i}").alias(c)

    return out.select(*[column(i, c) for i, c in enumerate(kept)])
