"""Personal data: patterns, and terms that give protected entities away, in DataFrame operations only.

Patterns find addresses, network numbers, card and phone numbers. What they find are the
protected entities. A term that stands near an entity tells about it by the pointwise mutual
information of both over the corpus, measured against the information of the entity itself:

    disclosure(entity, term) = log(p(entity, term) / (p(entity) p(term))) / -log p(entity)

which is 1 if the term never occurs without the entity. In documents with the entity, terms
that disclose at least ``DISCLOSURE`` of it are spans too, wherever they stand. A pair counts
only if it was seen in ``SUPPORT`` different surroundings, so that copies of one passage prove
nothing. Probabilities count documents, over the whole corpus: words are summed within
tasks before they move, and only pairs around entities are ever formed.

The patterns are written so that each is linear in the text: runs are possessive, and a
match may start only where a run starts or the last match ended.

Defined cases: a null text is empty and has no spans; repeated rows are judged each and count
each; a null identifier is carried along; an entity that all documents have discloses
nothing; ties in position are ordered by kind; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.llm.common import table, written

#: In the order that ties are listed in.
KINDS = ["email", "ip", "card", "phone", "term"]
DISCLOSURE = 0.9
SUPPORT = 3
#: Characters on either side of an entity that its terms are taken from.
NEAR = 80

_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"[A-Za-z0-9-]++"
#: pattern, and what a text must hold for it to be tried.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}(?:\.{_DOMAIN})++", r"@[A-Za-z0-9-]+\."),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_TERM = r"[\p{L}\p{M}]{4,}+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))

    def weighed(k: Column) -> Column:
        digit = F.substring(digits, k, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(k % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, k: n + weighed(k)
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        size = F.length(_digits(match))
        return F.when((size >= 12) & (size <= 19), _luhn(match)).otherwise(False)
    if kind == "phone":
        size = F.length(_digits(match))
        return (size >= 9) & (size <= 15)
    return F.lit(True)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda n, v: n + v)


def _found(text: Column, pattern: str, needed: Column) -> Column:
    """The matches of a pattern and the pieces of text around them."""
    return F.when(
        needed,
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
            F.split(text, pattern, -1).alias("gaps"),
        ),
    )


def _spans(found: Column, kind: str, valid) -> Column:
    """Start, kind, end and text of the valid matches; positions count code points."""
    hits, gaps = found["hits"], found["gaps"]
    before = F.transform(gaps, F.length)
    sizes = F.transform(hits, F.length)
    good = F.filter(F.sequence(F.lit(1), F.size(hits)), lambda k: valid(F.element_at(hits, k)))

    def span(k: Column) -> Column:
        start = _sum(F.slice(before, 1, k)) + _sum(F.slice(sizes, 1, k - 1))
        return F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (start + F.element_at(sizes, k)).alias("end"),
            F.element_at(hits, k).alias("value"),
        )

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.coalesce(F.when(F.size(hits) > 0, F.transform(good, span)), empty)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit("key"))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, the spans of the patterns, in order, and what is near them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, needed) in PATTERNS.items():
        rows = rows.withColumn(kind, _found(F.col("text"), pattern, F.col("text").rlike(needed)))
    spans = [_spans(F.col(k), k, lambda m, k=k: _valid(k, m)) for k in PATTERNS]
    rows = rows.select(
        "doc_id", "text", _text_key(F.col("text")).alias("key"), F.array_sort(F.concat(*spans)).alias("base")
    )
    return rows.select("doc_id", "key", "base", F.transform("base", _near).alias("near"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def _near(span: Column) -> Column:
    """The entity of a span, a hash of its surroundings, and the terms in them."""
    begin = F.greatest(span["start"] - NEAR, F.lit(0))
    around = F.concat_ws(
        " ",
        F.substring("text", begin + 1, span["start"] - begin),
        F.substring("text", span["end"] + 1, F.lit(NEAR)),
    )
    return F.struct(
        F.lower(span["value"]).alias("entity"), F.xxhash64(around).alias("place"), _terms(around).alias("terms")
    )


def disclosures(docs: DataFrame, found: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """entity, term and disclosure of the pairs that exceed the threshold."""
    near = written(
        found.select(F.inline("near")).groupBy("entity", "place").agg(
            F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms")
        ),
        "near-terms",
    )
    entities = near.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    joint = near.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("places")
    ).filter(F.col("places") >= support)
    words = (
        docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    )
    n = F.lit(float(max(1, docs.count())))
    both = F.least(F.col("n_both"), F.col("n_term"), F.col("n_entity"))
    information = F.log(n / F.col("n_entity"))
    shared = F.log(both * n / (F.col("n_entity") * F.col("n_term")))
    return (
        joint.join(entities, "entity").join(words, "term")
        .select("entity", "term", F.when(information > 0, shared / information).otherwise(0.0).alias("disclosure"))
        .filter(F.col("disclosure") >= threshold)
    )


def _term_spans(docs: DataFrame, found: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, key and the spans of the terms that disclose an entity of the document."""
    each = found.filter(F.size("base") > 0).select("doc_id", "key", F.explode("base.value").alias("value"))
    each = each.select("doc_id", "key", F.lower("value").alias("entity"))
    wanted = each.join(told, "entity").groupBy("doc_id", "key").agg(F.collect_set("term").alias("terms"))
    texts = docs.select(F.col("doc_id").alias("own_id"), "text", _text_key(F.col("text")).alias("own_key"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))
    rows = texts.join(wanted, same).dropDuplicates(["doc_id", "key"])
    rows = rows.withColumn("found", _found(F.col("text"), _TERM, F.lit(True)))
    spans = _spans(F.col("found"), "term", lambda m: F.array_contains("terms", F.lower(m)))
    return rows.select("doc_id", "key", spans.alias("extra"))


def protected_spans(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, key of the text, base spans and all spans of every row."""
    docs = docs.select("doc_id", "text")
    found = written(base_spans(docs), "base-spans")
    told = written(disclosures(docs, found, threshold, support), "disclosures")
    extra = _term_spans(docs, found, told).select(
        F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "extra"
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))
    apart = F.filter(
        F.coalesce("extra", F.filter("base", lambda s: F.lit(False))),
        lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    return found.join(extra, same, "left").select(
        "doc_id", "key", "base", F.array_sort(F.concat("base", apart)).alias("spans")
    )


def sanitised(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id and text with every span replaced by its kind: [EMAIL], [TERM] and so on."""
    docs = docs.select("doc_id", "text")
    spans = protected_spans(docs, threshold, support).dropDuplicates(["doc_id", "key"]).select(
        F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "spans"
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (_text_key(F.col("text")) == F.col("own_key"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring("text", done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        mark = F.when(s["start"] >= done["at"], F.element_at(names, s["kind"] + 1)).otherwise("")
        return F.struct(
            F.concat(done["out"], gap, mark).alias("out"), F.greatest(done["at"], s["end"]).alias("at")
        )

    folded = F.aggregate("spans", start, step)
    return docs.join(spans, same, "left").withColumn("done", folded).select(
        "doc_id",
        F.when(F.col("text").isNull() | F.col("done").isNull(), F.col("text")).otherwise(
            F.concat("done.out", F.substring("text", F.col("done.at") + 1, F.length("text")))
        ).alias("text"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return protected_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
