"""Operator 5: personal data by candidate gradient boosting, in DataFrame and SQL functions alone.

Generators propose spans. The exact ones (the base) follow fixed formats and checks, and
their spans always stay. The wide ones propose whatever looks alike: other separators, a
missing plus sign, written-out "at" and "dot", digit groups that fail a check. Boosted
trees score the wide proposals by format and context, and those above a threshold
calibrated on held-out candidates are added.

Nobody has labelled the spans, so the trees of each kind learn from what the texts hold. Its base spans are positive, in
weakened forms that the base does not accept and in the contexts in which they stand. Negative are its matches that fail the check
(long numbers, versions, "at" without a dotted host), base spans of the other kinds, and the wide proposals themselves: most of what is
merely alike (dates, order numbers) is nothing personal. Both labels weigh the same within a kind. A proposal is never scored by trees
that it taught: examples are in two folds, and each fold is scored by the trees of the other, as are the examples that calibrate the
threshold of the kind. A kind with few examples of either label adds nothing. Only proposals that pass the check of their kind are
added, and the checks are no features; formats and contexts are.

Places count code points from 0, the end is exclusive. Null and empty texts have no spans.
Rows are told apart by id and text: rows with one id are scanned and redacted each by its own text, and repeated rows
have the same spans. Of accepted proposals that overlap, in a chain as well, the likeliest stays, and the first of equals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import save

KINDS = ["email", "ip", "card", "phone"]
#: A private-use character that marks the ends of matches; one in a text counts as the next character.
_MARK, _OTHER = "\ue000", "\ue001"

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: (kind, what the text has to contain, pattern). A match starts where a run of its first characters starts or the
#: last match ended, and runs give nothing back: the leftmost matches are the same, without the square of a long run.
BASE = [
    ("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"),
    ("ip", ".", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
_AT = r"(?:\x20?[\[(<{]\x20?(?i:at)\x20?[\])>}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\x20?[\[(<{]\x20?(?i:dot)\x20?[\])>}]\x20?|\x20(?i:dot)\x20|\.)"
WIDE = [
    ("email", None, rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)*+"),
    ("ip", ".", r"(?<![0-9.])[0-9]{1,4}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,4}){3}(?![0-9.])"),
    ("card", None, r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{0,2}[0-9]{4}){2}[./_\x20-]{0,2}[0-9]{3,7}(?![0-9])"),
    ("phone", None, r"(?<![0-9+(.])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{2,4}[\x20./-][0-9]{2,5}(?![0-9])"),
]
#: Words that announce a kind (fixed values).
CUES = {"email": "mail|contact|write|reach", "ip": "ip|host|server|addr|login", "card": "card|visa|pay|credit|account", "phone": "phone|tel|call|mobile|fax|whatsapp"}
CONTEXT = 24
FEATURES = ["length", "digits", "letters", "spaces", "dots", "hyphens", "others", "spoken", "groups", "longest", "first", "last", "last_letters", "cue", "before_digit", "after_digit", "before_letter", "after_letter", "context_symbols"]
#: Precision asked of what is added.
PRECISION = 0.98
#: Examples in a leaf at least, by weight; a fold of a kind with fewer than twice as many of either label teaches nothing.
LEAF = 10
#: About how many distinct examples are in one task of a fit.
TASK_ROWS = 20_000
#: Most spans that are broadcast to redact by (about 20 MB); more are joined by a shuffle.
BROADCAST_SPANS = 500_000


def _luhn(t: str) -> str:
    """SQL: whether the digits of `t` pass the Luhn check."""
    digits = f"split(reverse(regexp_replace({t}, '[^0-9]', '')), '')"
    doubled = "if(i % 2 = 0, try_cast(c as int), if(try_cast(c as int) > 4, try_cast(c as int) * 2 - 9, try_cast(c as int) * 2))"
    return f"aggregate(transform({digits}, (c, i) -> {doubled}), 0, (sum, x) -> sum + coalesce(x, 0)) % 10 = 0"


def _octets(t: str) -> str:
    """SQL: whether all numbers in `t` are at most 255."""
    return f"forall(regexp_extract_all({t}, '[0-9]+', 0), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)"


def _digits(t: str) -> str:
    return f"length(regexp_replace({t}, '[^0-9]', ''))"


def _valid(kind: str, t: str) -> str:
    return {"email": rf"{t} rlike r'(?i)(dot|[.])[^A-Z0-9]*[A-Z]{{2,}}$'", "ip": _octets(t), "card": f"if({_digits(t)} between 16 and 19, {_luhn(t)}, false)", "phone": f"{_digits(t)} between 8 and 15"}[kind]


#: Lengths that are added up in one go; sums of these sums make the work of a long list grow with its length.
_BLOCK = 24


def _matches(text: Column, needs: str | None, pattern: str) -> Column:
    """All leftmost matches that do not overlap: array<struct<s, e, t, before, after>>, with what stands next to them up to other matches."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    none = F.expr("cast(array() as array<struct<s:int,e:int,t:string,before:string,after:string>>)")
    at, add = F.lit(0), (lambda s, x: s + x)
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  the value is made once, not at each use

    def sums(size: Column) -> Column:  # of the lengths before each part of a block
        return F.transform(F.sequence(F.lit(1), F.size(size)), lambda i: F.aggregate(F.slice(size, F.lit(1), i - 1), at, add))

    def starts(size: Column) -> Column:
        blocks = F.transform(F.sequence(at, F.floor((F.size(size) - 1) / _BLOCK).cast("int")), lambda b: F.slice(size, b * _BLOCK + 1, F.lit(_BLOCK)))
        before = lambda blocks: F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, at, add)), F.array(at), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
        return F.flatten(once(blocks, lambda blocks: F.transform(F.arrays_zip(blocks.alias("own"), F.slice(before(blocks), F.lit(1), F.size(blocks)).alias("n")), lambda x: F.transform(sums(x.own), lambda y: y + x.n))))

    def found(parts: Column, starts: Column) -> Column:
        def match(i: Column) -> Column:
            t, s = F.element_at(parts, i), F.element_at(starts, i)
            return F.struct(s.alias("s"), (s + F.length(t)).alias("e"), t.alias("t"), F.right(F.element_at(parts, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(parts, i + 1), F.lit(CONTEXT)).alias("after"))

        return F.transform(F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2)), match)  # every second part is a match

    listed = once(parts, lambda p: F.when(F.size(p) > 1, once(starts(F.transform(p, F.length)), lambda n: found(p, n))).otherwise(none))
    return F.when(F.contains(text, F.lit(needs)), listed).otherwise(none) if needs else listed


def _key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def candidates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, kind, base, valid, s, e, t, before, after): every match of the exact and of the wide patterns with its context, whether
    it is a base span, and whether it passes the check of its kind. key is a digest of the text."""
    clean = F.coalesce(F.col(text), F.lit(""))
    clean = F.when(F.contains(clean, F.lit(_MARK)), F.translate(clean, _MARK, _OTHER)).otherwise(clean)
    rows = docs.select(F.col(doc).alias("doc"), _key(text).alias("key"), clean.alias("text"))
    lists = []
    for base, generators in ((True, BASE), (False, WIDE)):
        for kind, needs, pattern in generators:
            name = f"{kind}_{base}"
            rows = rows.withColumn(name, _matches(F.col("text"), needs, pattern))
            valid = "true" if base and kind == "email" else _valid(kind, "m.t")
            lists.append(F.expr(f"transform({name}, m -> named_struct('kind', '{kind}', 'base', {valid if base else "false"}, 'valid', {valid}, 's', m.s, 'e', m.e, 't', m.t, 'before', m.before, 'after', m.after))"))
    return rows.select("doc", "key", F.concat(*lists).alias("found")).where(F.size("found") > 0).select("doc", "key", F.inline("found"))


def _measured(spans: DataFrame) -> DataFrame:
    """Format and context of (kind, t, before, after), a column for each of FEATURES."""
    count = lambda c, p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    cue = reduce(lambda a, k: a | ((F.col("kind") == k) & F.lower("before").rlike(CUES[k])), KINDS, F.lit(False))
    made = {"length": F.length("t"), "digits": count(F.col("t"), "[0-9]"), "letters": count(F.col("t"), "[A-Za-z]"), "spaces": count(F.col("t"), r"\x20"), "dots": count(F.col("t"), r"\."), "hyphens": count(F.col("t"), "-"), "others": count(F.col("t"), r"[^A-Za-z0-9\x20.-]")}
    made["spoken"] = F.size(F.split(F.col("t"), r"(?i)(?<![a-z])(?:at|dot)(?![a-z])")) - 1
    groups = F.filter(F.split("t", "[^0-9A-Za-z]+"), lambda x: x != "")
    made |= {"groups": F.size(groups), "longest": F.array_max(F.transform(groups, F.length)), "first": F.length(F.try_element_at(groups, F.lit(1))), "last": F.length(F.try_element_at(groups, F.lit(-1))), "last_letters": F.col("t").rlike("(?<![A-Za-z0-9])[A-Za-z]+$")}
    made |= {"cue": cue, "before_digit": F.col("before").rlike("[0-9.]$"), "after_digit": F.col("after").rlike("^[0-9.][0-9]?"), "before_letter": F.col("before").rlike("[A-Za-z]$"), "after_letter": F.col("after").rlike("^[A-Za-z]")}
    both = F.concat("before", F.lit(" "), "after")
    made |= {"context_symbols": count(both, r"[$%#/=:_{}<>|]")}
    for name in FEATURES:
        spans = spans.withColumn(name, F.coalesce(made[name].cast("double"), F.lit(0.0)))
    return spans


def _assembled(measured: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(measured)


def _weakened(t: Column, kind: Column) -> Column:
    """A base span as people write it to be read by people alone; which way, its hash says."""
    draw = F.crc32(t.cast("binary"))
    one = lambda place, *forms: F.element_at(F.array(*map(F.lit, forms)), (F.floor(draw / place) % len(forms) + 1).cast("int"))
    bare = F.when(F.floor(draw / 64) % 2 == 0, F.regexp_replace(t, "(?<=[A-Za-z])[._+-]?[0-9]+", "")).otherwise(t)  # digits make no address
    spoken = F.replace(F.replace(bare, F.lit("."), one(4, " dot ", " (dot) ", "[dot]", ".")), F.lit("@"), one(1, " at ", " (at) ", "[at]", " AT "))
    plain = F.regexp_replace(t, "[ -]", "")
    fours = F.filter(F.split(F.regexp_replace(plain, "([0-9]{4})", "$1 "), " "), lambda x: x != "")
    card = F.array_join(F.slice(fours, 1, 3), "\ue000")  # what is beyond twelve digits is one group
    card = F.replace(F.concat(card, F.lit("\ue000"), F.array_join(F.slice(fours, 4, 4), "")), F.lit("\ue000"), one(1, "", ".", "/", "_", "  "))
    local = F.regexp_replace(t, r"^\+[0-9]{1,2}[ .-]?", "")
    phone = F.when(draw % 3 == 0, local).otherwise(F.regexp_replace(F.regexp_replace(local, r"[()]", ""), "[ -]", one(1, ".", "-", " ")))
    ip = F.replace(t, F.lit("."), one(1, " . ", "[.]", "(.)", ". "))
    return F.when(kind == "email", spoken).when(kind == "phone", phone).when(kind == "card", card).otherwise(ip)


def _wide_only(spans: DataFrame) -> DataFrame:
    """Matches that are no base spans and overlap none of their text."""
    by = Window.partitionBy("doc", "key").orderBy("s")
    before = F.max(F.when(F.col("base"), F.col("e"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("s"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    wide = spans.withColumn("_before", before).withColumn("_after", after).where("not base")
    return wide.where("coalesce(_before <= s, true) and coalesce(_after >= e, true)").drop("_before", "_after")


def _fold(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(2)).cast("int")


#: Copies of a proposal with its context are in one fold, so that they do not count against each other.
PROPOSAL = ("t", "before", "after")


def examples(spans: DataFrame, wide: DataFrame) -> DataFrame:
    """(kind, t, before, after, label, fold): what teaches the trees of each kind; `wide` are the matches apart from base spans."""
    base = spans.where("base").withColumn("fold", _fold("doc", "key", "s"))
    others = F.filter(F.array(*map(F.lit, KINDS)), lambda k: k != F.col("kind"))
    parts = [
        (base.withColumn("t", _weakened(F.col("t"), F.col("kind"))), 1.0),
        (base.withColumn("kind", F.explode(others)), 0.0),
        (wide.withColumn("fold", _fold(*PROPOSAL)), 0.0),
    ]
    return reduce(DataFrame.union, (rows.withColumn("label", F.lit(label)).select("kind", *PROPOSAL, "label", "fold") for rows, label in parts))


def counted(examples: DataFrame) -> DataFrame:
    """(kind, label, fold, n, and FEATURES): examples that look alike as one row with their number, which teaches what they teach."""
    return _measured(examples).groupBy("kind", "label", "fold", *FEATURES).agg(F.count("*").alias("n"))


def _trees(own: DataFrame, fold: int, good: int, bad: int) -> tuple[object, list[tuple[int, float, float]]]:
    """Trees that the other fold taught, with `good` positive examples and `bad` others; `own` has a row for those that look alike; how many of this fold's (bin, positive, all) fall
    into each fiftieth of the probability, at most 51 of them."""
    weight = F.col("n") * F.when(F.col("label") == 1, (good + bad) / (2 * good)).otherwise((good + bad) / (2 * bad))
    made = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, minWeightFractionPerNode=LEAF / (good + bad), featureSubsetStrategy="onethird", weightCol="weight", seed=7, maxMemoryInMB=64)
    model = made.fit(own.where(F.col("fold") != fold).withColumn("weight", weight))
    bins = model.transform(own.where(F.col("fold") == fold)).groupBy(F.floor(vector_to_array("probability")[1] * 50).alias("bin"))
    return model, [tuple(r) for r in bins.agg(F.sum(F.col("label") * F.col("n")), F.sum("n")).collect()]


def fit(spans: DataFrame, wide: DataFrame, precision: float = PRECISION) -> dict[str, tuple[list, float]]:
    """By kind, (trees for fold 0, which fold 1 taught, and for fold 1; threshold). Kinds without enough examples are absent.

    The trees are fitted on all examples, those that look alike as one row with their number as its weight, and the thresholds are calibrated on all.
    """
    alike = save(counted(examples(spans, wide)))
    found = alike.groupBy("kind", "fold", "label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # 16 rows at most
    taken = {(r.kind, r.fold, r.label): r.n for r in found}
    kinds = [kind for kind in KINDS if min(taken.get((kind, fold, label), 0) for fold in (0, 1) for label in (0.0, 1.0)) >= 2 * LEAF]
    chosen = _assembled(alike).select("kind", "label", "fold", "n", "features")
    tasks = {kind: 1 + sum(r.rows for r in found if r.kind == kind) // TASK_ROWS for kind in kinds}  # as many as the rows of a kind need

    # one after another: the driver holds the jobs of one forest at a time
    made = [_trees(chosen.where(F.col("kind") == kind).coalesce(tasks[kind]), fold, taken[kind, 1 - fold, 1.0], taken[kind, 1 - fold, 0.0]) for kind in kinds for fold in (0, 1)]
    fitted = {}
    for kind, (first, bins), (second, more) in zip(kinds, made[::2], made[1::2], strict=True):
        least, below, good, total = 1.01, 0.0, 0.0, 0.0
        for at, own, n_own in sorted(bins + more, reverse=True):
            good, total = good + own, total + n_own
            if good >= precision * total:
                least, below = at / 50, 0.0
            else:
                below = max(below, (at + 1) / 50)
        threshold = (least + min(below, least)) / 2 if least <= 1 else least  # between what is precise enough and what is not
        fitted[kind] = [first, second], max(threshold, 0.5)
    return fitted


def detect(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, kind, base, s, e): base spans, and the wide proposals that the trees accept."""
    spans = save(candidates(docs, doc, text))
    wide = save(_wide_only(spans))
    fitted = fit(spans, wide)
    columns = ["doc", "key", "kind", "base", "s", "e"]
    base = spans.where("base").select(columns)
    if not fitted:
        return base
    scored = _assembled(_measured(wide.where("valid").withColumn("fold", _fold(*PROPOSAL)))).withColumn("p", F.lit(-1.0))
    for kind, (models, threshold) in fitted.items():
        for fold, model in enumerate(models):
            p = vector_to_array("probability")[1]
            scored = model.transform(scored).withColumn("p", F.when((F.col("kind") == kind) & (F.col("fold") == fold) & (p >= threshold), p).otherwise(F.col("p"))).drop("rawPrediction", "probability", "prediction")
    scored = scored.where("p >= 0").select(*columns, "p")
    by = Window.partitionBy("doc", "key").orderBy("s", "e", "kind")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    chains = scored.withColumn("new", (F.coalesce(reach, F.lit(0)) <= F.col("s")).cast("int")).withColumn("chain", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = chains.groupBy("doc", "key", "chain").agg(F.max_by(F.struct("kind", "base", "s", "e"), F.struct("p", -F.col("s"), -F.col("e"), "kind")).alias("x"))
    return base.union(best.select("doc", "key", "x.*"))


def _spans(docs: DataFrame, doc: str, text: str) -> DataFrame:
    k = F.expr(f"array_position(array({', '.join(map(repr, KINDS))}), kind)").cast("int")
    found = detect(docs, doc, text).select("doc", "key", F.struct(k.alias("k"), "s", "e", "kind", "base").alias("x"))
    return found.groupBy("doc", "key").agg(F.array_sort(F.collect_set("x")).alias("spans"))


def with_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """`docs` with the column `spans`: array<struct<k, s, e, kind, base>> by kind as in KINDS, then by place; null without spans. An older column goes."""
    found = save(_spans(docs, doc, text))
    if (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        found = F.broadcast(found)
    kept = [c for c in docs.columns if c != spans]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs[doc].alias("own"), _key(text).alias("digest"))
    joined = rows.join(found, F.col("own").eqNullSafe(F.col("doc")) & (F.col("digest") == F.col("key")), "left")
    return joined.select("row.*", F.col("spans").alias(spans))


def spans_by_document(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans), a row for each row of `docs` that has spans."""
    return with_spans(docs.select(doc, text), doc, text).where("spans is not null").select(doc, "spans")


def redact(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each span replaced by its kind in capitals and brackets; spans that overlap, in a chain as well, are replaced together by the kind of the first."""
    name = next(n for n in ("spans", "spans_", "spans__") if n not in docs.columns)
    ordered = F.array_sort(F.transform(F.col(name), lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.kind.alias("kind"))))
    at = F.col(f"`{text}`")

    def step(a: Column, x: Column) -> Column:  # pieces of the text and names of kinds, and the place after the last span
        piece = F.concat(F.substring(at, a.at + 1, x.s - a.at), F.lit("["), F.upper(x.kind), F.lit("]"))
        joined = F.struct(a.out.alias("out"), F.greatest(a.at, x.e).alias("at"))
        return F.when((x.s < a.at) & (a.out != ""), joined).otherwise(F.struct(F.concat(a.out, piece).alias("out"), x.e.alias("at")))

    made = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a.out, F.substring(at, a.at + 1, F.length(at))))
    return with_spans(docs, doc, text, name).withColumn(text, F.when(F.size(name) > 0, made).otherwise(at)).select(*docs.columns)
