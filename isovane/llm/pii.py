"""Personal data in whole texts: wide generators, boosted trees, calibrated thresholds; DataFrame functions alone.

Base patterns give the spans that always stay. They lose data that stands side by side: a telephone number before a
card number is one run of digits that passes no check. Generators therefore look at every place where a span could begin,
and propose spans that overlap each other. Boosted trees (logistic loss, two levels, sums of gradients by feature value) rate
the proposals by their format and context. They learn from the corpus itself: proposals equal to a base span are right; those that
cut through one, that are a match which failed its check, or that meet no match of their kind are wrong; the others,
inside a run that failed, are left out of learning. On texts set aside, thresholds are put so that the proposals
above them are nearly all right. Written-out marks ("(at)", "[dot]") are rated as the marks themselves. Of proposals above that overlap, the best stays.

Patterns are possessive or of bounded length and begin only where a run begins, so that their time grows with the
text and Java's matcher needs no deep stack.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.plans.lineage import cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Only possessive forms and looks behind differ from how they are dealt; the matches are the same.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: (kind, what may not stand before, body) of each generator.
GENERATORS = (
    (0, r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]{1,64}+(?:@| ?[(\[{][Aa][Tt][)\]}] ?)[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[(\[{][Dd][Oo][Tt][)\]}] ?)[A-Za-z0-9-]{1,63}+){1,8}+"),
    (1, r"[0-9]", r"[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])"),
    (1, r"[0-9]", r"[0-9]{1,3}+(?:[(\[{](?:\.|[Dd][Oo][Tt])[)\]}][0-9]{1,3}+){3}(?![0-9])"),
    (2, r"[0-9]", r"[0-9]{13,19}(?![0-9])"),
    (2, r"[0-9]", r"[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])"),
    (3, r"[0-9+]", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    (3, r"[0-9+]", r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"),
    (3, r"[0-9+(]", r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
#: Words before a span that speak for and against personal data.
FOR = r"(?i)\b(?:tel|phone|call|mobile|fax|mail|contact|card|visa|telefon|téléphone|teléfono|handy|kontakt|correo|tarjeta|carte|karte|host|ip)\b"
AGAINST = r"(?i)\b(?:order|invoice|version|isbn|token|password|key|total|price|page|id|nr|no|part)\b"
CONTEXT = 24
WRITTEN_AT, WRITTEN_DOT = r" ?[(\[{][Aa][Tt][)\]}] ?", r" ?[(\[{](?:\.|[Dd][Oo][Tt])[)\]}] ?"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
FEATURES = ("source", "digits", "luhn", "octets", "lead", "marks", "letters", "tail", "left", "right", "words")
ROUNDS = 8
RATE = 0.6
SHRINK = 1.0
#: Share of right ones that all proposals above a threshold must reach, and steps in which scores are looked at.
PRECISION = 0.98
STEPS = 200


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the check sum; false for other lengths."""
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _hits(texts: DataFrame) -> DataFrame:
    """All columns of ``texts`` but ``_text``, and ``hits``: matches of base patterns and proposals of generators in one array.

    A hit is (source, at, skip, body, before, after); ``skip`` is the way from the start of the match before to this one's.
    Generators look ahead at every place, so their bodies overlap; a line break put around the text gives every body
    a neighbour on both sides. Bodies and gaps are columns first: what a lambda function holds is computed for every element.
    """
    text, kept = F.col("_text"), [c for c in texts.columns if c != "_text"]
    wide = F.concat(F.lit("\n"), text, F.lit("\n"))
    has_digit, plus = text.rlike("[0-9]"), F.contains(text, F.lit("+"))
    at, dotted = F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]")
    likely = [at, dotted, has_digit, plus, at | text.rlike(r"[(\[{][Aa][Tt][)\]}]"), dotted, text.rlike(r"[0-9][(\[{](?:\.|[Dd])"), has_digit, has_digit, plus, plus, has_digit]
    patterns = [(text, p, 0) for p in BASE] + [(wide, f"(?<!{banned})(?=({body}(?s:.)))", 1) for _, banned, body in GENERATORS]
    found = {f"_b{n}": F.when(likely[n], F.regexp_extract_all(of, F.lit(p), F.lit(group))) for n, (of, p, group) in enumerate(patterns)}
    found |= {f"_g{n}": F.when(likely[n], F.split(of, p, -1)) for n, (of, p, _) in enumerate(patterns)}

    def rows(source: int) -> Column:
        """A struct for each body; a generator's last character is the neighbour, and its gaps run from start to start."""
        bodies, gaps, ahead = F.col(f"_b{source}"), F.col(f"_g{source}"), source >= len(BASE)

        def row(b: Column, i: Column) -> Column:
            gap = F.length(F.get(gaps, i))
            skip = gap - F.when(i == 0, 1).otherwise(0) if ahead else gap + F.coalesce(F.length(F.get(bodies, i - 1)), F.lit(0))
            body, after = (F.substring(b, F.lit(1), F.length(b) - 1), F.substring(b, -1, 1)) if ahead else (b, F.lit(""))
            before = F.substring(F.get(gaps, i), -CONTEXT, CONTEXT) if ahead else F.lit("")
            return F.struct(F.lit(source).alias("source"), i.alias("at"), skip.alias("skip"), body.alias("body"), before.alias("before"), after.alias("after"))

        return F.transform(F.coalesce(bodies, F.expr("CAST(array() AS array<string>)")), row)

    return texts.withColumns(found).select(*kept, F.concat(*[rows(n) for n in range(len(patterns))]).alias("hits"))


def _side(symbol: Column) -> Column:
    """Class of a neighbouring character."""
    classes = ((r"^[0-9]$", 1), (r"^[\x09-\x0D\x20]?$", 2), (r"^[.,;:!?)]$", 3), (r"^[\"'=_/#&-]$", 4), (r"^[A-Za-z]$", 5))
    out = F.lit(6)
    for pattern, n in reversed(classes):
        out = F.when(symbol.rlike(pattern), n).otherwise(out)
    return out


def propose(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): all documents with a row number, and every match and proposal with its features and label.

    spans: row, source, kind, start, end (code points, end exclusive), ``sure`` (a base match that passes its check), ``covered``
    (a proposal that overlaps a sure match), ``label`` (1, 0 or null), ``fold`` (1: set aside), FEATURES.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fold = (F.pmod(F.xxhash64(text), F.lit(4)) == 3).cast("int")
    held = cut(_hits(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", fold.alias("fold"), text.alias("_text"))))
    flat = held.where(F.size("hits") > 0).select("row", "fold", F.inline("hits")).repartition("row")
    order = Window.partitionBy("row", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    digits = F.regexp_replace("body", "[^0-9]", "")
    kinds = F.array(*[F.lit(k) for k in [*range(len(KINDS)), *[g[0] for g in GENERATORS]]])
    placed = flat.select(
        "row", "fold", "source", F.get(kinds, F.col("source")).alias("kind"), F.sum("skip").over(order).cast("long").alias("start"), "body", "before", "after", digits.alias("number"), F.length(digits).alias("n")
    ).withColumn("end", F.col("start") + F.length("body"))
    base = F.col("source") < len(BASE)
    octets = F.col("body").rlike(r"^" + r"[^0-9]+".join([OCTET] * 4) + "$")
    passes = F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, octets).when(F.col("kind") == 2, F.col("n").between(16, 19) & F.col("luhn")).otherwise(F.col("n").between(8, 15))
    known = placed.withColumn("luhn", _luhn(F.col("number"))).withColumn("sure", base & passes).withColumn("match", base)

    def meets(which: str, keys: list[str]) -> Column:
        """Whether a span overlaps one of ``which``: the farthest end of those that begin before it, the next begin of the others."""
        before = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
        after = Window.partitionBy(*keys).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
        reach = F.max(F.when(F.col(which), F.col("end"))).over(before) > F.col("start")
        return F.coalesce(reach, F.lit(False)) | F.coalesce(F.min(F.when(F.col(which), F.col("start"))).over(after) < F.col("end"), F.lit(False))

    same = Window.partitionBy("row", "kind", "start", "end")
    told = known.select(
        "*", meets("sure", ["row"]).alias("covered"), meets("match", ["row", "kind"]).alias("touched"),
        F.max("sure").over(same).alias("right"), F.max("match").over(same).alias("whole"),
    ).where(~F.col("match") | F.col("sure"))
    label = F.when(F.col("match"), None).when(F.col("right"), 1).when(F.col("covered") | F.col("whole") | ~F.col("touched"), 0)
    # what is written out is rated as if it were not; the base patterns can't say whether it is right, so it is left out of learning
    signs = F.regexp_replace(F.regexp_replace("body", WRITTEN_AT, "@"), WRITTEN_DOT, ".")
    label = F.when(signs == F.col("body"), label)
    letters, marks = F.length(F.regexp_replace(signs, "[^A-Za-z]", "")), F.length(F.regexp_replace(signs, "[A-Za-z0-9]", ""))
    features = {
        "source": F.when(F.col("source") == 6, 5).otherwise(F.col("source")), "digits": F.least("n", F.lit(20)), "luhn": F.col("luhn").cast("int"), "octets": octets.cast("int"),
        "lead": F.coalesce(F.substring("number", 1, 1).try_cast("int"), F.lit(10)), "marks": F.least(marks, F.lit(12)), "letters": F.least(F.floor(letters / 4), F.lit(12)),
        "tail": F.least(F.length(F.regexp_extract(signs, "([A-Za-z0-9]*)$", 1)), F.lit(20)), "left": _side(F.substring("before", -1, 1)), "right": _side(F.col("after")),
        "words": F.when(F.col("before").rlike(AGAINST), 2).when(F.col("before").rlike(FOR), 1).otherwise(0),
    }
    values = F.array(*[features[f].cast("int") for f in FEATURES]).alias("f")
    spans = cut(told.select("row", "fold", "source", "kind", "start", "end", "sure", "covered", label.alias("label"), values))
    return held.select("row", "doc_id"), spans


@dataclass(frozen=True)
class Tree:
    """Two levels: feature and value of the first cut, then of the cut on either side, then four weights."""

    top: tuple[int, int]
    below: tuple[tuple[int, int], tuple[int, int]]
    weights: tuple[float, float, float, float]

    def margin(self, f: Column) -> Column:
        def side(at: tuple[int, int], low: float, high: float) -> Column:
            return F.when(F.get(f, F.lit(at[0])) <= at[1], low).otherwise(high)

        a, b, c, d = self.weights
        return F.when(F.get(f, F.lit(self.top[0])) <= self.top[1], side(self.below[0], a, b)).otherwise(side(self.below[1], c, d))


@dataclass(frozen=True)
class Model:
    """Of fixed size: a constant, trees, and a threshold for each kind (2: nothing of that kind is added)."""

    base: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]

    def score(self, f: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.base) + sum((t.margin(f) for t in self.trees), F.lit(0.0)))))


def _best(sums: dict[tuple[int, int], tuple[float, float]]) -> tuple[float, tuple[int, int], float, float]:
    """(gain, cut, weight below, weight above) of the best cut, from sums (gradient, curvature) by (feature, value)."""
    best = (-1.0, (0, 1 << 20), 0.0, 0.0)
    for feature in sorted({k[0] for k in sums}):
        values = sorted(v for i, v in sums if i == feature)
        total = [sum(sums[feature, v][j] for v in values) for j in (0, 1)]
        low = [0.0, 0.0]
        for v in values:
            low = [a + b for a, b in zip(low, sums[feature, v], strict=True)]
            high = [a - b for a, b in zip(total, low, strict=True)]
            gain = low[0] ** 2 / (low[1] + SHRINK) + high[0] ** 2 / (high[1] + SHRINK)
            if gain > best[0] + 1e-9:
                best = (gain, (feature, v), RATE * low[0] / (low[1] + SHRINK), RATE * high[0] / (high[1] + SHRINK))
    return best


def fit(spans: DataFrame, rounds: int = ROUNDS) -> Model:
    """Boosted trees from all labelled proposals. The driver gets sums by feature value, of fixed size, never spans."""
    cells = cut(spans.where(F.col("label").isNotNull()).groupBy("f", "kind", "label", "fold").agg(F.count("*").alias("n")))
    learn = cells.where("fold = 0")
    n, right = learn.agg(F.sum("n"), F.sum(F.col("n") * F.col("label"))).first()
    if not right:
        return Model(0.0, (), (2.0,) * len(KINDS))
    model = Model(log((right + 0.5) / (n - right + 0.5)), (), (2.0,) * len(KINDS))
    for _ in range(rounds):
        p = model.score(F.col("f"))
        state = learn.select("f", (F.col("n") * (F.col("label") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))

        def summed(side: Column) -> dict[int, dict]:
            out: dict[int, dict] = {0: {}, 1: {}}
            each = state.select(side.alias("side"), "g", "h", F.posexplode("f").alias("i", "v"))
            for r in each.groupBy("side", "i", "v").agg(F.round(F.sum("g"), 9).alias("g"), F.round(F.sum("h"), 9).alias("h")).collect():  # a row for each value
                out[r.side][r.i, r.v] = (r.g, r.h)
            return out

        _, top, _, _ = _best(summed(F.lit(0))[0])
        sides = summed(F.when(F.get("f", F.lit(top[0])) <= top[1], 0).otherwise(1))
        found = [_best(sides[k]) for k in (0, 1)]
        model = Model(model.base, (*model.trees, Tree(top, (found[0][1], found[1][1]), (found[0][2], found[0][3], found[1][2], found[1][3]))), model.thresholds)
    step = F.floor(model.score(F.col("f")) * STEPS).cast("int")
    aside = cells.where("fold = 1").groupBy("kind", step.alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).collect()  # KINDS x STEPS rows
    return Model(model.base, model.trees, tuple(_threshold([(r.step, r.n, r.right) for r in aside if r.kind == k]) for k in range(len(KINDS))))


def _threshold(steps: list[tuple[int, int, int]]) -> float:
    """Between the least step from which on PRECISION of all that lies above is right and the next one below it; 2 where nothing is."""
    n = right = 0
    least, below = None, 0
    for step, some, good in sorted(steps, reverse=True):
        n, right = n + some, right + good
        if right and right >= PRECISION * n:
            least, below = step, 0
        elif least is not None and not below:
            below = step
    return 2.0 if least is None else (least + below) / 2 / STEPS


def added(spans: DataFrame, model: Model) -> DataFrame:
    """(row, kind, start, end): proposals above their kind's threshold that overlap no sure span, the best of those that overlap."""
    limit = F.get(F.array(*[F.lit(t) for t in model.thresholds]), F.col("kind"))
    rated = spans.where((F.col("source") >= len(BASE)) & ~F.col("covered")).withColumn("score", model.score(F.col("f"))).where(F.col("score") >= limit)
    chosen = rated.groupBy("row", "kind", "start", "end").agg(F.max("score").alias("score"))
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.max("end").over(before) <= F.col("start")).cast("int"), F.lit(1))
    islands = chosen.repartition("row").withColumn("opens", opens).withColumn("island", F.sum("opens").over(Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    spans_of = F.struct((-F.round("score", 6)).alias("s"), (F.col("start") - F.col("end")).alias("n"), "start", "end", "kind")
    ranked = islands.groupBy("row", "island").agg(F.sort_array(F.collect_list(spans_of)).alias("all"))  # part of one text
    free = lambda taken, x: ~F.exists(taken, lambda t: (t.start < x.end) & (t.end > x.start))
    none = F.expr("CAST(array() AS array<struct<s:double,n:bigint,start:bigint,end:bigint,kind:int>>)")
    kept = F.aggregate("all", none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    return ranked.select("row", F.explode(kept).alias("x")).select("row", "x.kind", "x.start", "x.end")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): (row, doc_id) of every document, (row, kind, start, end, sure) of every base and added span."""
    held, spans = propose(docs)
    sure = spans.where("sure").select("row", "kind", "start", "end", F.lit(True).alias("sure"))
    more = added(spans, fit(spans)).withColumn("sure", F.lit(False))
    return held, sure.unionByName(more)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs``.

    Counts and digest are of the base spans; ``spans`` also has the added ones. Places are code points, ends exclusive. A null text
    is empty: no span, and the digest of an empty string. Rows that share id or text are rows of their own.
    Without any base span in the corpus there is nothing to learn from, and nothing is added. Texts of any length are read whole.
    """
    held, spans = find(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")
    each = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "sure"))).alias("all"))
    base = F.filter("all", lambda x: x.sure)
    of = lambda k: F.filter(base, lambda x: x.kind == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    texts = each.select("row", *counts, told(base).alias("base"), told(F.col("all")).alias("spans"), (F.size("all") - F.size(base)).cast("long").alias("n_added"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return held.join(texts, "row", "left").select(
        "doc_id", *[zero(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added")
    )
