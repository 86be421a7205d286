"""Personal data by weak supervision (DataFrame functions only).

Fixed patterns give the base spans, which always stay.  Looser patterns, and base matches that
failed their test, are candidates where plausible; the rest teach what a miss looks like.  Five
labelers vote on every span: shape, checksum, gazetteer, context and boundary.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; the posteriors train a naive Bayes classifier over span
features, and candidates that it accepts are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import documents, let, materialise

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns.  A run is entered at its first character or where the last match
# ended, and never given back, so long runs take linear time; the matches are the same.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NEEDS = ("@", ".", "", "+")
#: Looser forms: an address spelled out; an address defanged, or of version 6; a card number parted
#: by other signs; a telephone number without its plus.
LOOSE = {
    0: r"[A-Za-z0-9._-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,24}){1,3}",
    1: r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,3}){3}(?![0-9])|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:]))",
    2: r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/])",
    3: r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold for a looser form to be looked for.
HINTS = {0: r"[\[(]at[\])]", 1: r"[0-9]\x20?[\[(](?:\.|dot)[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", 2: r"[0-9]{4}[._/][0-9]{4}[._/]", 3: "[0-9]{3}[\\x20.-][0-9]{4}"}
DOT = r"\x20?[\[(](?:\.|dot)[\])]\x20?"
# Words that speak for each kind just before a span, and against any.
CUES = (
    r"(?i)(e-?mail|mail|contact|write to|reach|address|adresse|correo|kontakt)\W*$",
    r"(?i)(ip|address|adresse|host|server|from|login|gateway|dns|ping|client)\W*$",
    r"(?i)(card|carte|karte|tarjeta|visa|mastercard|amex|credit|debit|payment|account)\W*$",
    r"(?i)(tel|phone|call|mobile|cell|fax|contact|whatsapp|telefon|téléphone|teléfono|handy)\W*$",
)
AGAINST = r"(?i)(version|release|build|order|invoice|isbn|issn|doi|serial|sku|ref|page|section|chapter|id|no|total|figure|table|rfc)\W*$"
# Generic top-level domains; every two letters are a country's.
DOMAINS = r"(?i)[. )\]](com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|site|shop|store|tech|blog|news|xyz|eu|[a-z]{2})$"
# Networks that no host on the internet has (this, private, loopback, link-local, test, multicast and above).
RESERVED = r"^(0|10|127|22[4-9]|2[34][0-9]|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\."
# Leading digits that card issuers have, and how many digits their cards have.
ISSUERS = r"^(4([0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(0[0-5]|[68][0-9])[0-9]{11}|6(011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35(2[89]|[3-8][0-9])[0-9]{12}|62[0-9]{14,17})$"
# Country calling codes.
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])"
LABELERS = 5
ROUNDS = 40
CONTEXTS = 64
#: Values that are summed up in one go.
STRETCH = 128
#: Least posterior odds (as a logarithm) at which a candidate is added.
THRESHOLD = 2.2


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    back = F.reverse(d)

    def add(total: Column, i: Column) -> Column:
        n = back.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def passes(kind: int, match: Column) -> Column:
    """The contract's test of a base match."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    n = F.length(digits(match))
    if kind == 2:
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    return n.between(10, 15)


def plausible(kind: int, match: Column) -> Column:
    """Whether a match that is no base span may be added at all.

    Other failed matches only teach the labelers' reliabilities.
    """
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.when(match.contains(":"), True).otherwise(match.rlike(DOT) & passes(1, F.regexp_replace(match, DOT, ".")))
    n = F.length(digits(match))
    if kind == 2:
        return F.when((n == 13) | match.rlike("[._/]"), luhn(digits(match))).otherwise(False)
    return n.between(8, 15)


def prefix_sums(values: Column) -> Column:
    """For each value, the sum of those before it.

    An array grows by copying, so the sums are taken in stretches: of each stretch, then inside.
    """
    zero = F.array().cast("array<int>")

    def running(x: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), zero.alias("sums"))
        return F.aggregate(x, start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["sums"], a["at"]).alias("sums")))["sums"]

    def stretch(i: Column) -> Column:
        return F.slice(values, i * STRETCH + 1, F.lit(STRETCH))

    numbers = F.sequence(F.lit(0), F.call_function("div", F.size(values) - 1, F.lit(STRETCH)).cast("int"))
    sums = F.transform(numbers, lambda i: F.aggregate(stretch(i), F.lit(0), lambda a, v: a + v))
    many = let(let(sums, lambda x: running(x, F.lit(0))), lambda begins: F.flatten(F.transform(numbers, lambda i: running(stretch(i), begins[i]))))
    return F.when(F.size(values) <= STRETCH, running(values, F.lit(0))).otherwise(many)


def located(text: Column, pattern: str, make) -> Column:
    """``make(start, end, match, before, after)`` for every match, offsets in code points.

    The text between matches gives the offsets: piece, match, piece, match, ...
    """

    def walk(found: Column, pieces: Column) -> Column:
        begins = let(F.transform(found, lambda m, i: F.length(pieces[i]) + F.length(m)), prefix_sums)
        starts = F.transform(begins, lambda b, i: b + F.length(pieces[i]))
        return F.transform(starts, lambda s, i: make(s, s + F.length(found[i]), found[i], F.right(pieces[i], F.lit(24)), F.left(pieces[i + 1], F.lit(2))))

    def split(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda p: walk(found, p)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: int, match: Column, before: Column, after: Column) -> Column:
    """What the labelers say: 1 for, -1 against, 0 nothing."""
    nothing = F.lit(False)
    shape = (
        vote(match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$"), match.rlike(r"\.\.|^[.%+-]")),
        vote(match.rlike(r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$|:"), match.rlike(r"(^|\.)0[0-9]|[0-9]{4}")),
        vote(match.rlike(r"^([0-9]{15,16}|[0-9]{4}([\x20-][0-9]{4}){3})$"), match.rlike(r"\x20.*-|-.*\x20")),
        vote(match.rlike(r"^(\+[0-9]{1,3}[\x20-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,6}$"), match.rlike(r"[().-]{3}")),
    )[kind]
    if kind == 1:
        match = F.regexp_replace(match, DOT, ".")
    elif kind == 2:
        match = F.regexp_replace(match, "[._/]", "-")
    test = passes(kind, match) | match.contains(":") if kind == 1 else passes(kind, match)
    check = (vote(nothing, nothing), vote(test, ~test), vote(test, ~test), vote(test, ~test))[kind]
    gazetteer = (
        vote(match.rlike(DOMAINS), match.rlike(r"[0-9]$")),
        vote(~match.rlike(RESERVED), match.rlike(r"^(0|127|255)\.")),
        vote(digits(match).rlike(ISSUERS), match.rlike(r"^[07-9]")),
        vote(match.rlike(CALLING) | match.rlike(r"555"), match.rlike(r"^\+?0{2}")),
    )[kind]
    context = vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
    edge = vote((before == "") | before.rlike(r"[\s(\"'<:,]$"), before.rlike(r"[\p{L}\p{N}#/=_]$") | after.rlike(r"^[\p{L}\p{N}/=_]|^[.-][0-9]"))
    return F.array(shape, check, gazetteer, context, edge)


SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,able:boolean,votes:array<int>,features:array<int>>>"


def spans_of(text: Column) -> Column:
    """``struct<base, spare>``: base spans of a text, and candidates that overlap none of them."""

    def maker(kind: int, loose: bool):
        def make(start, end, match, before, after):
            base = F.lit(False) if loose else passes(kind, match)
            last_word = F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))
            features = F.array(F.least(F.length(digits(match)), F.lit(20)).cast("int"), F.pmod(F.xxhash64(last_word), F.lit(CONTEXTS)).cast("int"),
                               F.size(F.regexp_extract_all(match, F.lit(r"[^A-Za-z0-9]"), F.lit(0))).cast("int"))
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), base.alias("base"), plausible(kind, match).alias("able"), votes(kind, match, before, after).alias("votes"), features.alias("features"))

        return make

    digit = text.rlike("[0-9]")
    found = []
    for kind, pattern in enumerate(BASE):
        present = F.contains(text, F.lit(NEEDS[kind])) & (digit if kind else F.lit(True))
        found.append(F.when(present, located(text, pattern, maker(kind, False))))
    for kind, pattern in LOOSE.items():
        found.append(F.when(text.rlike(HINTS[kind]), located(text, pattern, maker(kind, True))))
    none = F.array().cast(SPANS)
    every = F.concat(*(F.coalesce(x, none) for x in found))

    def split(spans: Column) -> Column:
        def free(base: Column) -> Column:
            spare = F.filter(spans, lambda s: ~s["base"] & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
            return F.struct(F.array_sort(base).alias("base"), spare.alias("spare"))

        return let(F.filter(spans, lambda s: s["base"]), free)

    return let(every, split)


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of every vote pattern from its count, by expectation-maximisation.

    ``counts`` has at most ``len(KINDS) * 3 ** LABELERS`` entries.  Labelers start out better
    than chance, which fixes which class is which.
    """
    prior = [0.5] * len(KINDS)
    rate = [[{y: {v: (0.5 if v == y else 0.2 if v == -y else 0.3) for v in (-1, 0, 1)} for y in (-1, 1)} for _ in range(LABELERS)] for _ in KINDS]
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(ROUNDS):
        for kind, pattern, _n in counts:
            like = {y: math.log(prior[kind] if y == 1 else 1 - prior[kind]) + sum(math.log(rate[kind][j][y][v]) for j, v in enumerate(pattern)) for y in (-1, 1)}
            post[kind, pattern] = 1 / (1 + math.exp(min(700.0, like[-1] - like[1])))
        for kind in range(len(KINDS)):
            mine = [(p, n, post[kind, p]) for k, p, n in counts if k == kind]
            total = sum(n for _, n, _ in mine)
            prior[kind] = min(0.99, max(0.01, (1 + sum(n * q for _, n, q in mine)) / (2 + total)))
            for j in range(LABELERS):
                for y in (-1, 1):
                    weight = {v: 1.0 + 2.0 * (v == y) for v in (-1, 0, 1)}  # a mild belief in the labeler
                    for p, n, q in mine:
                        weight[p[j]] += n * (q if y == 1 else 1 - q)
                    whole = sum(weight.values())
                    rate[kind][j][y] = {v: w / whole for v, w in weight.items()}
    return post


def fitted(spans: DataFrame, threshold: float):
    """Train on ``spans`` (``base, spare``); a function from ``spare`` to the spans to add."""
    spark = spans.sparkSession
    each = spans.select(F.explode(F.concat("base", "spare")).alias("s")).select("s.kind", "s.votes", "s.features")
    each = materialise(each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")))
    counts = [(r["kind"], tuple(r["votes"]), r["n"]) for r in each.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()]  # at most 4 * 3**5
    post = reliabilities(counts)
    if not post:
        return lambda spare: F.array().cast(SPANS)
    table = ", ".join(f"({k}, array({', '.join(map(str, p))}), {q!r}D)" for (k, p), q in sorted(post.items()))
    believed = each.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {table} AS t(kind, votes, q)")), ["kind", "votes"])  # the same bound
    values = believed.select("kind", "n", "q", F.posexplode("features").alias("slot", "value"))
    sums = values.groupBy("kind", "slot", "value").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).where("slot < 3").collect()
    whole: dict[tuple[int, int], list[float]] = {}
    for r in sums:
        w = whole.setdefault((r["kind"], r["slot"]), [0.0, 0.0, 0.0])
        w[0], w[1], w[2] = w[0] + r["yes"], w[1] + r["no"], w[2] + 1
    weights = {f"{r['kind']}:{r['slot']}:{r['value']}": math.log((r["yes"] + 1) / (whole[r["kind"], r["slot"]][0] + whole[r["kind"], r["slot"]][2]))
               - math.log((r["no"] + 1) / (whole[r["kind"], r["slot"]][1] + whole[r["kind"], r["slot"]][2])) for r in sums}
    odds = {k: math.log((whole[k, 0][0] + 1) / (whole[k, 0][1] + 1)) for k, s in whole if s == 0}
    belief = {f"{k}:{','.join(map(str, p))}": math.log(max(q, 1e-9) / max(1 - q, 1e-9)) for (k, p), q in post.items()}
    weight_of = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    odds_of = F.create_map(*(x for k, v in odds.items() for x in (F.lit(k), F.lit(v))))
    belief_of = F.create_map(*(x for k, v in belief.items() for x in (F.lit(k), F.lit(v))))

    def score(s: Column) -> Column:
        """Classifier's log odds; a span that its votes speak against is held back."""
        parts = F.transform(s["features"], lambda v, i: F.coalesce(F.try_element_at(weight_of, F.concat_ws(":", s["kind"], i, v)), F.lit(0.0)))
        learned = odds_of[s["kind"]] + F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        voted = F.coalesce(F.try_element_at(belief_of, F.concat_ws(":", s["kind"], F.array_join(F.transform(s["votes"], lambda v: v.cast("string")), ","))), F.lit(0.0))
        return F.least(learned, voted)

    return lambda spare: F.filter(spare, lambda s: s["able"] & (score(s) >= threshold))


def detect(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base and added spans per document.

    A null text is empty; null ids and repeated rows are kept as they are; an empty table
    gives no rows and trains nothing; spans that start together are listed by kind; other columns
    are left out, whatever their names; texts may be of any length that a row can hold.
    ``n_spans`` counts all spans, ``n_added`` those beyond the base ones.
    """
    found = df.select("doc_id", spans_of(F.coalesce(F.col("text"), F.lit(""))).alias("s"))
    spans = materialise(found.select("doc_id", "s.base", "s.spare"))
    added = fitted(spans, threshold)(F.col("spare"))
    kinds = F.array(*(F.lit(k) for k in KINDS))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(x), lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return spans.withColumn("added", added).select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                                                   joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
                                                   (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def redact(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with every span of its ``text`` replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the first one's kind.  All columns stay as
    they are but ``text``, and ``n_chars`` if there is one; a null text stays null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = materialise(df.select(spans_of(text).alias("s")).select("s.base", "s.spare"))
    add = fitted(spans, threshold)
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def masked(every: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, s: Column) -> Column:
            piece = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), kinds[s["kind"]])
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], piece).otherwise(a["out"]).alias("out"))

        return F.aggregate(every, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    def sorted_spans(s: Column) -> Column:
        return F.array_sort(F.concat(s["base"], add(s["spare"])))

    clean = F.when(F.col("text").isNotNull(), let(spans_of(text), lambda s: let(sorted_spans(s), masked)))
    sizes = {c: F.length("text").cast(t) for c, t in df.dtypes if c == "n_chars"}
    return df.withColumn("text", clean).withColumns(sizes) if sizes else df.withColumn("text", clean)


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
