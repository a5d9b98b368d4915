"""Line dedup on fuzzy lines: normalised lines, blocks of sampled grams, edit similarity, one line a group.

Lines are lower-cased and cut into words at everything but letters, marks and digits. Candidates agree
in a block: one of the ``MINIMA`` least hashes of a line's word trigrams, or for lines of at most
``SHORT`` characters, whose few trigrams a typo may all hit, one of the segments that the pigeonhole
principle leaves whole. Candidates are linked if their edit similarity, 1 - edits / characters of the
longer line (words, beyond ``LONG`` characters), reaches ``SIMILARITY``. Of every connected group of lines the occurrence first by
(doc_id, text hash, line number) stays, all others go.

SimHash, the sketch this kind of operator is known by, is not used: at a similarity of 0.9 the hashes
of a pair differ in more bits than blocks can bridge. With 63 bits and two of them allowed to differ, the
share of pairs found was 0.35 with one of 60 words changed, 0.05 with three and 0.07 with one of 20;
blocks that let 0.9 of them through would have 12 bits, and hold each 4096th line of the corpus. A
least hash is shared with the odds of the Jaccard similarity instead, 0.57 or more where a tenth of
the words are changed, and names a block by 64 bits.

Only DataFrame functions. In blocks of more than ``BLOCK`` lines all lines are tried against a leader first,
then against samples that grow, so that a line like many others is linked while few of them are tried. Where that
leaves several groups, every two lines of a block in different groups meet, in cells of bounded size: those that
counts of letters, an exact bound, leave room for are compared there, in the first of the blocks that they share,
and only links of groups are written. No candidate is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, materialise, nothing, parts_for, settings, small

SIMILARITY = 0.9
#: What is removed of so many documents is broadcast, joined with a shuffle beyond.
BROADCAST_DOCS = 300_000
#: Least hashes a line; lines of at most so many characters get segments too; characters a word
#: beyond which a line has too few words, as in scripts without spaces.
MINIMA = 5
SHORT = 49
DENSE = 12
#: Lines a block is compared in at once; in larger blocks, of how many lines one is tried, until all are; lines
#: on one side of a cell, and on the other times as many.
BLOCK = 24
SHARES = (64, 8, 1)
CELL = 512
WIDE = 16
#: Beyond so many bytes the JVM doesn't compile a method, and conditions on pairs take many times as long; with
#: this limit Spark cuts them into smaller ones. What comes later in a condition isn't worked out ahead.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.subexpressionElimination.skipForShortcutExpr": "true"}
#: Leaders with their texts that are broadcast.
BROADCAST_LEADERS = 100_000
#: Beyond so many characters, edits and similarity count whole words: in characters, the work grows
#: with the square of the length.
LONG = 250
#: Letters that signatures count in either half, each up to so many; four share a long.
LETTERS = "abcdefghijklmnopqrstuvwxyz 1éäöü"
COUNTED = 16
SIG = [f"s{i}" for i in range(len(LETTERS) // 2)]
ROW = ["lid", "len", "units", "whole", *SIG]


def words_of(line: Column) -> Column:
    """The lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{M}\p{N}]++", -1), "")


def _units(words: Column, norm: Column) -> tuple[Column, Column]:
    """What grams are made of, words or pairs of characters, and whether it is the pairs, which overlap."""
    chars = F.split(F.array_join(words, ""), "")
    # no lambda may hold ``chars``, which would cut the line again for each character
    twos = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    dense = F.length(norm) > DENSE * F.size(words)
    return F.when(dense, twos).otherwise(words), dense


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """``(lid, doc_id, th, no, len, norm, m0, ...)`` of all lines that hold a word: ``lid`` names the
    line, ``norm`` is short lines' words, ``m0, ...`` are the least gram hashes. One pass, written once."""
    each = docs.select("doc_id", F.xxhash64(F.col(text)).alias("th"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("no", "line"))
    each = each.select("doc_id", "th", "no", words_of(F.col("line")).alias("words"))
    each = each.select("doc_id", "th", "no", F.array_join("words", " ").alias("norm"), "words")
    units, dense = _units(F.col("words"), F.col("norm"))
    each = each.select("doc_id", "th", "no", "norm", units.alias("u"), dense.alias("dense"))
    # a shorter line is one gram
    def grams(step: int) -> Column:
        whole = F.slice("u", F.lit(1), F.greatest(F.size("u") - 2 * step, F.lit(1)))
        return F.transform(whole, lambda x, i: F.xxhash64(x, F.get("u", i + step), F.get("u", i + 2 * step)))

    least = each.select("doc_id", "th", "no", "norm", F.slice(F.sort_array(F.when(F.col("dense"), grams(2)).otherwise(grams(1))), 1, MINIMA).alias("m"))
    size = F.length("norm")
    brief = F.when(size <= int(SHORT / SIMILARITY) + 1, F.col("norm"))
    found = least.select(
        F.xxhash64("norm").alias("lid"), "doc_id", "th", "no", size.alias("len"), brief.alias("norm"), *[F.get("m", i).alias(f"m{i}") for i in range(MINIMA)]
    )
    # filtered as a written table: a filter would be pushed below and cut all lines twice
    return materialise(found).where("len > 0")


def _segments(lines: DataFrame, similarity: float) -> DataFrame:
    """``(key, lid, len)`` for short lines, exact: a line cut into one segment more than edits are
    allowed keeps a segment whole. Every line is a member of its own segments and of those
    of equally long and shorter lines that it has near the same place."""
    edits = lambda n: f"cast(floor({1 - similarity:.6f} * ({n}) + 1e-9) as int)"
    most = f"floor({SHORT} / {similarity} + 1e-9)"
    x = lines.select("lid", "len", "norm").where(f"len <= {most}")
    x = x.select("*", F.expr(f"explode(sequence(len - {edits('len')}, len))").alias("l")).where(f"l <= {SHORT}")
    x = x.select("*", F.expr(edits(f"floor(l / {similarity} + 1e-9)")).alias("k")).where("k > 0")
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    x = x.selectExpr("*", "cast(floor(l / (k + 1)) as int) as w", "greatest(0, i - (k + 1 - l % (k + 1))) as extra", "int(i >= k + 1 - l % (k + 1)) as one")
    x = x.selectExpr("lid", "len", "norm", "l", "k", "i", "i * w + extra + 1 as p", "w + one as w")
    x = x.selectExpr("*", "greatest(1, p - i, p + len - l - (k - i)) as lo", "least(len - w + 1, p + i, p + len - l + (k - i)) as hi").where("lo <= hi")
    # a line has a key several times only for one ``l`` and ``i``
    keys = F.array_distinct(F.transform(F.sequence("lo", "hi"), lambda at: F.xxhash64("l", "i", F.substr("norm", at, F.col("w")))))
    return x.select(F.explode(keys).alias("key"), "lid", "len")


def _signature(x: Column) -> list[Column]:
    """How often each of ``LETTERS`` stands in either half of ``x``, up to ``COUNTED``, as so many bits; of an odd
    length the letter in the middle is left out. Put for another, a letter changes two bits at most. Put in or
    taken out, it changes one, and makes the middle come or go: one letter more, or one less, in one half. So an
    edit changes at most two bits: an exact bound for any two texts."""
    left = lambda bits, by: F.call_function("shiftleft", bits, by)
    size = F.floor(F.length(x) / 2).cast("int")
    longs = []
    for half in (F.substr(x, F.lit(1), size), F.substr(x, F.length(x) - size + 1, size)):
        for at in range(0, len(LETTERS), 4):
            bits = F.lit(0).cast("long")
            for i, c in enumerate(LETTERS[at : at + 4]):
                n = F.least(size - F.length(F.replace(half, F.lit(c), F.lit(""))), F.lit(COUNTED))
                bits = bits.bitwiseOR(left(left(F.lit(1).cast("long"), n) - 1, F.lit(COUNTED * i)))
            longs.append(bits.alias(SIG[len(longs)]))
    return longs


def _shared(blocks: DataFrame) -> DataFrame:
    """``blocks(key, lid, len)`` of keys that several lines have, with their number ``n``."""
    several = materialise(blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return materialise(blocks.join(small(several), "key"))


def _near(m: str, n: str, similarity: float) -> Column:
    """Whether lengths leave room for the similarity."""
    return F.abs(F.col(m) - F.col(n)) <= _room(m, n, similarity)


def _room(m: str, n: str, similarity: float) -> Column:
    """The edits that two lines of these lengths may lie apart."""
    return F.floor(F.greatest(m, n) * (1 - similarity) + 1e-9)


def _like(mine: str, other: str, similarity: float) -> Column:
    """Whether lengths and signatures leave room for the similarity, of two lines in the same units; ``mine``
    and ``other`` make a column's name on either side."""
    x, y = (lambda c: mine.format(c)), (lambda c: other.format(c))
    bits = sum((F.bit_count(F.col(x(c)).bitwiseXOR(F.col(y(c)))) for c in SIG), F.lit(0))
    room = _near(x("len"), y("len"), similarity) & _near(x("units"), y("units"), similarity) & (bits <= 2 * _room(x("units"), y("units"), similarity))
    return room & (~F.col(x("whole")) | (F.greatest(x("len"), y("len")) > LONG))


def _pairs(blocks: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of blocks ``(key, lid, len)`` of bounded size."""
    # the same table on both sides is shuffled once
    met = blocks.alias("a").join(blocks.alias("b"), "key").where("a.lid < b.lid").where(_near("a.len", "b.len", similarity))
    return met.select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b")).distinct()


def _labelled(members: DataFrame, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``members(key, lid, len)`` with ``units``, ``whole``, the signature, the text ``x`` that is compared, all
    ``keys`` of the line and the ``root`` of its group, written once: a block is split into what may be compared
    in characters and what may be in whole words. Lines of about ``LONG`` characters are in both."""
    chars = texts.where(F.col("len") <= LONG).select("lid", F.lit(False).alias("whole"), F.col("norm").alias("x"))
    words = texts.where("kinds is not null").select("lid", F.lit(True).alias("whole"), F.col("letters").alias("x"), "kinds")
    each = materialise(members.groupBy("lid").agg(F.min("len").alias("len"), F.collect_set("key").alias("keys")))
    known = chars.withColumn("kinds", F.col("x")).unionByName(words).join(small(each), "lid")
    known = known.select("lid", "len", "whole", "x", F.length("x").alias("units"), F.transform("keys", lambda k: F.xxhash64(k, "whole")).alias("keys"), *_signature(F.col("kinds")))
    known = known.join(small(groups), F.col("lid") == groups["node"], "left")
    return materialise(known.select(F.explode("keys").alias("key"), "keys", *ROW, "x", F.coalesce("root", "lid").alias("root")))


def _close(x: str, y: str, similarity: float) -> str:
    """Whether the edits of two texts leave the similarity."""
    most = f"cast(floor(greatest(length({x}), length({y})) * {1 - similarity:.6f} + 1e-9) as int)"
    return f"abs(length({x}) - length({y})) <= {most} and levenshtein({x}, {y}, {most}) >= 0"


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of ``(a, b)`` those with edit similarity."""
    texts = texts.select("lid", "len", "norm", "letters")
    both = pairs.join(texts.toDF("a", "la", "ca", "wa"), "a").join(texts.toDF("b", "lb", "cb", "wb"), "b").where(_near("la", "lb", similarity))
    long = F.greatest("la", "lb") > LONG
    both = both.select("a", "b", F.when(long, F.col("wa")).otherwise(F.col("ca")).alias("x"), F.when(long, F.col("wb")).otherwise(F.col("cb")).alias("y"))
    return both.where(_close("x", "y", similarity)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _texts(docs: DataFrame, firsts: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """``(lid, len, norm, letters, kinds)`` of the lines ``ids``, from where each comes first. ``letters`` has one of
    20000 characters for each word, by hash, so that edits of long lines count whole words; ``kinds`` one of ``LETTERS``."""
    at = firsts.join(small(ids), "lid", "left_semi").select("p.doc_id", "p.th", "p.no")
    wanted = materialise(at.groupBy("doc_id", "th").agg(F.collect_list("no").alias("nos")))
    wanted = _sent(wanted.select(F.col("doc_id").alias("_di"), F.col("th").alias("_tj"), "nos"), "nos")
    here = docs.select("doc_id", F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    met = here.join(wanted, here["doc_id"].eqNullSafe(F.col("_di")) & (here["th"] == F.col("_tj"))).select("nos", F.split("text", "\n", -1).alias("ls"))
    line = met.select(F.explode(F.transform("nos", lambda i: F.get("ls", i))).alias("line")).select(words_of(F.col("line")).alias("words"))
    # a pair is compared in one of the two: what none of a length can need isn't sent
    size = F.length("norm")
    line = line.select("words", F.array_join("words", " ").alias("norm"))
    hashes = F.when(size > int(LONG * SIMILARITY) - 1, F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(20_000))))
    line = line.select("norm", hashes.alias("hashes"))
    letters = F.decode(F.unhex(F.array_join(F.transform("hashes", lambda h: F.hex(h + 0x4E00)), "")), "UTF-16BE")
    kinds = F.array_join(F.transform("hashes", lambda h: F.substr(F.lit(LETTERS), F.pmod(h, F.lit(len(LETTERS))).cast("int") + 1, F.lit(1))), "")
    brief = F.when(size <= int(LONG / SIMILARITY) + 1, F.col("norm"))
    found = materialise(line.select(F.xxhash64("norm").alias("lid"), size.alias("len"), brief.alias("norm"), letters.alias("letters"), kinds.alias("kinds")))
    # each line was asked of one place: it comes once, unless rows are alike in doc_id and text
    return found if found.count() == ids.count() else materialise(found.dropDuplicates(["lid"]))


def _sent(per_doc: DataFrame, lists: str) -> DataFrame:
    """A written table by document, to be sent to the texts while it is small; texts are shuffled beyond."""
    size = per_doc.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    few = size[0] <= BROADCAST_DOCS and size[1] <= 10 * BROADCAST_DOCS
    return F.broadcast(per_doc) if few else per_doc.hint("shuffle_hash")


def links(docs: DataFrame, lines: DataFrame, firsts: DataFrame, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, root)`` of the connected groups of different lines."""
    least = firsts.select("lid", "len", F.explode(F.array_distinct(F.array(*[f"m{i}" for i in range(MINIMA)]))).alias("key"))
    brief = lines.where("norm is not null").select("lid", "len", "norm").dropDuplicates(["lid"])
    blocks = _shared(least.where("key is not null").select("key", "lid", "len")).union(_shared(_segments(materialise(brief), similarity)))
    pairs = materialise(_pairs(blocks.where(F.col("n") <= BLOCK).select("key", "lid", "len"), similarity))
    large = blocks.where(F.col("n") > BLOCK).select("key", "lid", "len")
    ids = pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).union(large.select("lid")).distinct()
    texts = _texts(docs, firsts, materialise(ids), text)
    found = materialise(_verified(pairs, texts, similarity))
    with settings(docs.sparkSession, COMPILED):
        return _large(large, texts, found, similarity)


def _large(members: DataFrame, texts: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Add to ``found`` the links inside large blocks ``members(key, lid, len)``; ``(node, root)`` of all.
    Lines are tried against a leader and samples, then against each other where that leaves several groups.

    Groups of what was found before are made once; links between them are joined as links of their roots.
    """
    none = found.toDF("node", "root").limit(0)
    groups = none if nothing(found) else materialise(components(found))
    label = _labelled(members, texts, groups)
    few = parts_for(label.count())
    between, merged = found.limit(0), None
    for share in (None, *SHARES):
        now = label
        if merged is not None:
            now = label.withColumnRenamed("root", "old").join(small(merged.toDF("old", "new")), "old", "left").withColumn("root", F.coalesce("new", "old")).drop("old", "new")
        spread = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.min(F.xxhash64("lid")).alias("lead"))
        open_ = materialise(spread.where("lo < hi").select("key", "lead", "n"), few)
        if nothing(open_):
            break
        if share is None:
            new = _led(now.join(small(open_.select("key", "lead")), "key"), similarity)
        else:
            # a sample of few lines finds nothing
            open_ = open_.where(F.col("n") >= (32 * share if share > 1 else 0))
            if nothing(open_):
                continue
            new = _celled(now.join(small(open_.select("key", "n")), "key"), similarity, share)
        new = materialise(new, few)
        if nothing(new):
            continue
        between = materialise(between.union(new))
        merged = materialise(components(between), few)
    if merged is None:
        return groups
    # lines that only a root's links brought in are roots themselves
    last = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
    every = groups.union(merged.select("node", F.col("node").alias("root")).join(groups, "node", "left_anti"))
    return every.join(last, every["root"] == last["old"], "left").select("node", F.coalesce("new", "root").alias("root"))


def _linked(met: DataFrame, similarity: float, also: Column | None = None) -> DataFrame:
    """``(u, v)``, the roots, of lines that ``met`` in different groups and have edit similarity."""
    met = met.where(_like("{}", "{}_b", similarity))
    met = met if also is None else met.where(also)
    # ``units`` is the length: texts are not gone through for it
    met = met.where(F.call_function("levenshtein", "x", "x_b", _room("units", "units_b", similarity).cast("int")) >= 0)
    return met.select(F.least("root", "root_b").alias("u"), F.greatest("root", "root_b").alias("v")).distinct()


def _led(rows: DataFrame, similarity: float) -> DataFrame:
    """Links of lines to the leader of their block."""
    lead = materialise(rows.where(F.xxhash64("lid") == F.col("lead")).select("key", *[F.col(c).alias(f"{c}_b") for c in (*ROW, "x", "root")]))
    return _linked(rows.join(small(lead, BROADCAST_LEADERS), "key").where("root <> root_b"), similarity)


def _celled(rows: DataFrame, similarity: float, share: int) -> DataFrame:
    """Links of lines of ``rows(key, keys, lid, ..., x, root, n)`` across roots, one of so many tried. Blocks of
    one cell meet themselves. In larger ones, one at least of two such lines is not of the block's largest group.
    Those meet lines of lengths near theirs, by bands as wide as the similarity leaves room; both are dealt into
    parts, and two parts meet in a cell of their own. Lines are compared where they meet first, so pairs are
    never written."""
    first = F.array_min(F.array_intersect("keys", "keys_b")) == F.col("key")  # of all blocks that both are in
    sides = [*ROW, "x", "root", "keys"]
    one_cell = rows.where(F.col("n") <= CELL if share == 1 else F.lit(False)).select("key", *sides)
    # the same columns of the same table on both sides are shuffled once
    met = one_cell.alias("a").join(one_cell.alias("b"), "key").where("a.lid < b.lid and a.root <> b.root and a.whole = b.whole")
    met = met.select("key", *[F.col(f"a.{c}") for c in sides], *[F.col(f"b.{c}").alias(f"{c}_b") for c in sides])
    found = _linked(met, similarity, first)
    rows = rows.where(F.col("n") > CELL) if share == 1 else rows
    main = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    main = materialise(main)
    if nothing(main):
        return found
    rows = rows.join(small(main), "key").withColumn("band", F.floor(F.log(F.col("len") + 1) / -math.log(similarity)).cast("int"))
    parts, wide = F.ceil(F.col("n") / (CELL * 4 * share)).cast("int"), F.ceil(F.col("n") / (CELL * WIDE)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("lid"), n).cast("int")
    one = rows.where("root <> main").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    one = one.select("key", "band", *sides, "main", part(wide).alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    tried = rows if share == 1 else rows.where(F.pmod(F.xxhash64("lid", F.lit(share)), F.lit(share)) == 0)
    two = tried.select("key", "band", *[F.col(c).alias(f"{c}_b") for c in sides], part(parts).alias("other"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("mine"))
    both = "root <> root_b" if share > 1 else "root <> root_b and (root_b = main or lid < lid_b)"
    parted = _linked(one.join(two, ["key", "band", "mine", "other"]).where(both), similarity, first)
    return found.union(parted) if share == 1 else parted


def dedup(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Remove repeated lines from ``text``; add ``n_lines`` and ``n_removed`` (long).

    Lines end at ``\\n``. Lines without letters, marks and digits, blank ones among them, are never
    removed. A null text stays null with 0 lines; an empty text is one blank line. Rows with equal
    doc_id and text count as one document and get equal results; a null doc_id comes last in order.
    The two added names replace columns of the same names, other columns pass through, whatever
    their names. Lines are named by 64-bit hashes: with N different lines two unlike ones meet by
    chance with odds N * N / 2**65. No rows in, no rows out.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    mine = docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text"))
    lines = _lines(mine, "text")
    place = F.struct(F.col("doc_id").isNull().alias("nul"), F.col("doc_id"), F.col("th"), F.col("no"))
    firsts = lines.groupBy("lid").agg(
        F.min(place).alias("p"), F.count("*").alias("n"), F.min("len").alias("len"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(MINIMA)]
    )
    firsts = materialise(firsts)
    groups = links(mine, lines, firsts, "text", similarity)
    grouped = firsts.select("lid", "p").join(groups, F.col("lid") == groups["node"]).select("lid", "root", "p")
    best = materialise(grouped.groupBy("root").agg(F.min("p").alias("w")))
    winners = grouped.join(best, "root").select("lid", "w")
    alone = firsts.where("n > 1").join(groups, F.col("lid") == groups["node"], "left_anti").select("lid", F.col("p").alias("w"))
    winners = materialise(winners.union(alone))
    gone = lines.select("lid", place.alias("p")).join(small(winners), "lid").where("p <> w").select("p.doc_id", "p.th", "p.no")
    per_doc = materialise(gone.groupBy("doc_id", "th").agg(F.collect_set("no").alias("gone")))
    per_doc = _sent(per_doc.select(F.col("doc_id").alias("di"), F.col("th").alias("tj"), "gone"), "gone")
    # the row goes along as one struct, which no name can clash with
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").alias("d"), F.col(f"`{text}`").alias("t"))
    here = here.withColumn("th", F.xxhash64("t"))
    joined = here.join(per_doc, here["d"].eqNullSafe(per_doc["di"]) & (here["th"] == per_doc["tj"]), "left")
    cut = F.split("t", "\n", -1)
    left = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(
        *[F.when(F.col("gone").isNull(), F.col("t")).otherwise(left).alias(c) if c == text else F.col(f"row.`{c}`") for c in kept],
        F.when(F.col("t").isNull(), 0).otherwise(F.coalesce(F.size(cut), F.lit(0))).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))
