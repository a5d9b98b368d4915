"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. The values found
are the protected entities. Over the distinct texts of the whole corpus, co-occurrence estimates
how much a term tells about an entity: the pointwise mutual information of term and entity, held
against the entity's own information content. A term that gives away at least ``DISCLOSE`` of it is
a span too, in whatever text it stands; :func:`sanitise` generalises base spans to their kind and
removes disclosing terms.

All of it is DataFrame functions. Spark's patterns come from Java, whose group repetition recurses
and whose retries at every start are quadratic on long runs; so separators inside a run are first
swapped for one mark of equal length, and starts are pinned to the start of a run. What is found is
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, nothing, small

KINDS = ("email", "ip", "card", "phone")
#: At least so many distinct texts must hold the entity together with the term.
SUPPORT = 3
#: The share of an entity's information content that a term may give away.
DISCLOSE = 0.9
#: A table of at most so many terms is broadcast; beyond it the join is a shuffle.
BROADCAST_TERMS = 200_000

#: A mark from the private use area, and what stands in for one that a text holds itself.
_MARK, _OTHER = "\ue000", "\ue001"
_LOCAL = r"A-Za-z0-9._%+\-" + _MARK
#: Patterns over the marked text. Local part and domain of the contract's e-mail pattern with dots
#: between labels marked; card digits with single separators between digits marked.
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9\-]++{_MARK}[A-Za-z0-9\-{_MARK}]++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?:(?<![0-9{_MARK}])|\G)[0-9][0-9{_MARK}]++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: Texts without a hit of this cheap test hold no match.
_HINTS = {
    "email": r"@[A-Za-z0-9\-]+\.",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20\-]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TERM = r"\p{L}{3,}"


def _marked(kind: str, text: Column) -> Column:
    """``text``, equally long, with the separators that the kind allows inside a run marked."""
    clean = F.translate(text, _MARK, "")
    if kind == "email":
        return F.regexp_replace(clean, r"(?<=[A-Za-z0-9\-])\.(?=[A-Za-z0-9\-])", _MARK)
    if kind == "card":
        return F.regexp_replace(clean, r"(?<=[0-9])[\x20\-](?=[0-9])", _MARK)
    return text


def _luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn test."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            each,
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
            ),
        ),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(digits)
        return F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _placed(text: Column, pattern: Column) -> Column:
    """All matches of ``pattern`` as ``array<struct<m, s, e>>`` in code points. Splitting gives the
    gaps around the same matches, so a match starts after the gaps and matches before it."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<m:string,s:int,e:int>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.length(x["h"])).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        x["h"].alias("m"),
                        (a["at"] + x["g"]).alias("s"),
                        (a["at"] + x["g"] + F.length(x["h"])).alias("e"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return walked["out"]


def _spans(kind: str, text: Column) -> Column:
    """The valid matches of one kind as ``array<struct<s, k, e, m>>``; k orders kinds as listed."""
    placed = _placed(_marked(kind, text), F.lit(_PATTERNS[kind]))
    original = F.transform(
        placed,
        lambda x: F.struct(
            x["s"].alias("s"),
            F.lit(KINDS.index(kind)).alias("k"),
            x["e"].alias("e"),
            (F.translate(x["m"], _MARK, ".") if kind == "email" else F.translate(x["m"], _MARK, " ")).alias("m"),
        ),
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    kept = F.filter(original, lambda x: _valid(kind, x["m"]))
    return F.when(text.rlike(_HINTS[kind]), kept).otherwise(none)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_base``, all base spans in order of start and kind, and ``_key``, which names the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_base", F.array_sort(F.concat(*[_spans(k, t) for k in KINDS]))).withColumn(
        "_key", F.when(F.size("_base") > 0, F.md5(t.cast("binary")))
    )


def _merged(spans: Column) -> Column:
    """Sorted spans ``array<struct<s, k, e, m>>`` with those that overlap as one, of the kind of the first."""
    cast = "array<struct<s:int,k:int,e:int>>"
    plain = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))
        meets = (F.size(out) > 0) & (x["s"] < F.get(out, F.size(out) - 1)["e"])
        return F.when(meets, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(plain, F.array().cast(cast), step)


def _replaced(text: Column, spans: Column, by: Column) -> Column:
    """``text`` with merged, sorted ``spans`` replaced by the entry of the array ``by`` for their kind. Each
    span is cut where it stands in the text as it was."""
    merged = _merged(spans)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(
        F.concat(a["out"], F.substr(text, a["at"] + 1, x["s"] - a["at"]), F.get(by, x["k"])).alias("out"), x["e"].alias("at")
    )
    return F.aggregate(merged, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def disclosing(docs: DataFrame, holders: DataFrame, text: str = "text", support: int = SUPPORT, disclose: float = DISCLOSE) -> DataFrame:
    """``(_key, _more)``: for texts, whether they hold an entity or not, the terms that give one away.

    ``holders(_key, _base)`` has one row for each distinct text with base spans. Counts are of
    distinct texts, so that copies of one text are one witness. With N texts, an entity in n_e, a
    term in n_t and both in n_et of them, the term discloses log(N n_et / (n_e n_t)) of the
    entity's log(N / n_e).
    """
    every = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).where("_text <> ''")
    none = every.select(F.lit("").alias("_key"), F.array().cast("array<string>").alias("_more")).limit(0)
    entities = F.array_distinct(F.transform("_base", lambda x: F.struct(x["k"].alias("k"), x["m"].alias("m"))))
    pairs = holders.select("_key", F.explode(entities).alias("entity"))
    frequent = materialise(pairs.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support))
    most = frequent.agg(F.max("n_e")).first()[0]
    if most is None:
        return none
    linked = materialise(pairs.join(frequent, "entity"))
    keys = materialise(linked.select("_key").distinct())
    texts = _holding(docs, text).join(holders, "_key").dropDuplicates(["_key"])
    # base spans are blanked, so that parts of an address are no terms
    bare = _replaced(F.col("_text"), F.col("_base"), F.array_repeat(F.lit(" "), len(KINDS)))
    held = materialise(texts.select("_key", _terms(bare).alias("terms")))
    n = every.agg(F.count_distinct(F.xxhash64("_text"))).first()[0]
    total = F.lit(float(n))
    own = F.log(total / F.col("n_e"))
    gain = lambda n_t: F.log(total * F.col("n_et") / (F.col("n_e") * n_t))
    # texts with base spans are some of all: a term that is too common among them is so everywhere, and as
    # n_et is at most n_e, one of more than N ** (1 - disclose) * n_e ** disclose texts gives nothing away
    some = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_some"))
    some = some.where((F.col("n_some") >= support) & (F.col("n_some") <= n ** (1 - disclose) * most**disclose * (1 + 1e-9)))
    some = materialise(some)
    terms = held.join(keys, "_key", "left_semi").select("_key", F.explode("terms").alias("term"))
    terms = materialise(terms.join(small(some, BROADCAST_TERMS), "term"))
    room = F.col("n_some") <= F.pow(total, F.lit(1 - disclose)) * F.pow(F.col("n_e"), F.lit(disclose)) * (1 + 1e-9)
    met = linked.join(terms, "_key").where(room).groupBy("entity", "n_e", "term", "n_some").agg(F.count("*").alias("n_et"))
    both = met.where((F.col("n_et") >= support) & (own > 0) & (gain(F.col("n_some")) >= F.lit(disclose) * own))
    both = materialise(both.drop("n_some"))
    wanted = materialise(both.select("term").distinct())
    if nothing(wanted):
        return none
    # where the terms stand, in all texts: counted, and kept for those that disclose
    spread = every.select(F.md5(F.col("_text").cast("binary")).alias("_key"), F.explode(_terms(F.col("_text"))).alias("term"))
    spread = materialise(spread.join(small(wanted, BROADCAST_TERMS), "term", "left_semi").groupBy("_key", "term").agg(F.lit(1).alias("one")))
    counts = spread.groupBy("term").agg(F.count("*").alias("n_t"))
    told = both.join(counts, "term").where(gain(F.col("n_t")) >= F.lit(disclose) * own).select("term").distinct()
    found = spread.join(small(materialise(told), BROADCAST_TERMS), "term", "left_semi")
    return found.groupBy("_key").agg(F.array_sort(F.collect_list("term")).alias("_more"))


def _holding(docs: DataFrame, text: str) -> DataFrame:
    """``(_key, _text)`` of rows that may hold a base span."""
    t = F.coalesce(F.col(text), F.lit(""))
    hit = t.rlike(_HINTS["email"])
    for k in KINDS[1:]:
        hit = hit | t.rlike(_HINTS[k])
    return docs.select(t.alias("_text")).where(hit).select(F.md5(F.col("_text").cast("binary")).alias("_key"), "_text")


def find(docs: DataFrame, text: str = "text", support: int = SUPPORT, disclose: float = DISCLOSE) -> DataFrame:
    """Add ``base`` and ``spans``, both ``array<struct<s, k, e, m>>`` in order, to every row.

    Null and empty texts have no spans. Repeated rows get equal results. Terms lie outside base spans,
    base spans of different kinds may overlap. Columns named ``base`` or ``spans`` are replaced, other
    columns pass through, whatever their names. No rows in, no rows out.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    plain = docs.select(F.col(f"`{text}`").alias("text"))
    holders = base_spans(_holding(plain, "text").select("_text"), "_text").where("_key is not null")
    holders = materialise(holders.select("_key", "_base").dropDuplicates(["_key"]))
    flags = materialise(disclosing(plain, holders, "text", support, disclose))
    t = F.coalesce(F.col("text"), F.lit(""))
    here = docs.select(row, F.col(f"`{text}`").alias("text")).withColumn("_md5", F.md5(t.cast("binary")))
    joined = here.join(small(flags, BROADCAST_TERMS), F.col("_md5") == F.col("_key"), "left").drop("_key")
    found = base_spans(joined, "text")
    some = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_more", "|"), F.lit(r")(?!\p{L})"))
    terms = F.transform(
        _placed(t, some),
        lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e"), x["m"].alias("m")),
    )
    outside = F.filter(terms, lambda x: ~F.exists("_base", lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"])))
    spans = F.when(F.col("_more").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", outside)))
    found = found.select("row", F.struct(F.col("_base").alias("base"), spans.alias("spans")).alias("found"))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], "found.base", "found.spans")


def sanitise(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` of :func:`find`'s rows: base spans by ``<kind>``, disclosing terms removed. Spans
    that overlap are replaced as one, by the kind of the first. A null text stays null."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS], F.lit(""))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), _replaced(F.col(text), F.col("spans"), names)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
