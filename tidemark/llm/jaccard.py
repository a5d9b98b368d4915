"""N-gram Jaccard join by set-relation skipping.

A document's set is its distinct word shingles. Tokens are ordered by how often they were met, rare
first, and every set is indexed under its prefix only: sets with Jaccard similarity of at least T
share a token of their prefixes. Lists hold their entries in blocks by size and position, and whole
blocks that cannot reach T with each other are skipped; what remains is held against an exact bound
from 512-bit parity sketches before whole sets are compared.

Answers come incrementally: sets that are equal count as one, a set first takes over the group of
the similar set it is linked to, and only pairs across groups are compared after that; long lists
first give each set one partner, and all pairs only where they still hold several groups. The
result is exact: the second round leaves no pair that could link two groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, components, documents, materialise, mix, nothing, slices, small

SHINGLE = 3
#: 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Frequent tokens that are told apart in the order; only the order's quality depends on it.
HEAVY = 100_000
#: Lists beyond so many entries are dealt into cells of pairs of parts of about this size.
LIST_PART = 1024
#: Lists up to this length give all their candidate pairs at once.
SHORT = 32
#: Sets are asked for by broadcast up to so many, by a shuffle beyond.
BROADCAST_NODES = 500_000
#: Entries of one token that a task sorts: tokens met more often are dealt into parts of about this size.
SORTED = 50_000
#: Pairs are looked at in grids of so many rows and columns.
_GRID = (64, 1024)
_SKETCH = 8
_WIDE = 64
_U = np.uint64
_M = (_U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5), _U(0x9FB21C651E98DF25))


def shingle_sets(hasher: WordHasher, texts, size: int):
    """The sorted distinct shingle hashes of each text; fewer words make one shingle of all."""
    for words in hasher(texts):
        n = len(words)
        if n == 0:
            yield words
            continue
        k = min(size, n)
        value = np.full(n - k + 1, k if k < size else 0, dtype=_U)
        for i in range(k):
            value = mix(value * _M[0] + words[i : n - k + 1 + i] * _M[1] + _U(i + 1))
        yield np.unique(value)


def _heavy(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The at most HEAVY tokens met most often, with counts: each chunk of a task's sets sends
    tokens that a share of its sets hold, so a token of a global share is met in some chunk."""

    def run(batches):
        hasher = WordHasher()

        def chunk(sets, n):
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            keep = np.flatnonzero(counts >= max(3, n // 500))
            if len(keep) > HEAVY:
                keep = keep[np.argpartition(-counts[keep], HEAVY)[:HEAVY]]
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["token", "n"]
            )

        sets, held = [], 0
        for b in slices(batches):
            for s in shingle_sets(hasher, b.column(0).to_pylist(), size):
                if len(s):
                    sets.append(s)
                    held += len(s)
                if held > 1_000_000:
                    yield chunk(sets, len(sets))
                    sets, held = [], 0
        if sets:
            yield chunk(sets, len(sets))

    met = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "token long, n long")
    # counts fall into classes of a quarter of an octave; whole classes are taken while they fit
    level = F.floor(F.log2("n") * 4).cast("int")
    sums = materialise(met.groupBy("token").agg(F.sum("n").alias("n")).withColumn("level", level))
    lowest, room = None, HEAVY
    for r in sums.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
        if r["k"] > room:
            break
        lowest, room = r["level"], room - r["k"]
    top = sums.where(F.col("level") >= (lowest if lowest is not None else 1 << 30)).select("token", "n").toPandas()
    tokens = top["token"].to_numpy(np.int64).view(_U)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def _rank(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions of ``tokens`` in the global order: rare first, ties by token."""
    names, counts = heavy
    if not len(names):
        return np.arange(len(tokens))
    at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
    count = np.where(names[at] == tokens, counts[at], 0)
    return np.lexsort((tokens, count))


def _parts(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many parts of about ``SORTED`` entries each token's list is dealt into: one, but for frequent tokens."""
    names, counts = heavy
    if not len(names) or not len(tokens):
        return np.ones(len(tokens), np.int32)
    at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
    return (1 + np.where(names[at] == tokens, counts[at], 0) // SORTED).astype(np.int32)


def _sketch(tokens: np.ndarray, words: int = _SKETCH) -> np.ndarray:
    """Parities in ``words`` words (a power of two): two sets differ in at least as many tokens as
    their sketches in bits."""
    bits = 64 * words
    odd = np.bincount((mix(tokens ^ _M[3]) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def _index(docs: DataFrame, text: str, size: int, percent: int, heavy) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: set size, two hashes of the set, sketch and prefix, and into
    how many parts the entries of each prefix token are dealt."""
    held = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        hasher = WordHasher()
        for b in slices(batches, 250):
            n, ha, hb, sk, px, pp = [], [], [], [], [], []
            for s in shingle_sets(hasher, b.column(1).to_pylist(), size):
                m = len(s)
                n.append(m)
                ha.append(_name(s) if m else 0)
                hb.append(int(mix(s ^ _M[2]).sum(dtype=_U).view(np.int64)) if m else 0)
                sk.append(_sketch(s).tobytes() if m else b"")
                keep = m - -(-percent * m // 100) + 1 if m else 0
                first = s[_rank(s, held.value)[:keep]]
                px.append(first.view(np.int64))
                pp.append(_parts(first, held.value))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ha, pa.int64()), pa.array(hb, pa.int64()),
                 pa.array(sk, pa.binary()), pa.array(px, pa.list_(pa.int64())), pa.array(pp, pa.list_(pa.int32()))],
                names=["doc_id", "n", "ha", "hb", "sketch", "prefix", "parts"],
            )

    return docs.select("doc_id", F.col(text).cast("binary").alias("t")).mapInArrow(
        run, "doc_id long, n long, ha long, hb long, sketch binary, prefix array<long>, parts array<int>"
    )


def _sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``(doc_id, node, n, t, wide)`` of every row with a set: its size, the text it is made of and its sketch
    in 64 words. Texts are shorter than sets of hashes, and compress."""

    def run(batches):
        hasher = WordHasher()
        for b in slices(batches, 250):
            at, ha, n, wide = [], [], [], []
            for i, s in enumerate(shingle_sets(hasher, b.column(1).to_pylist(), size)):
                if len(s):
                    at.append(i)
                    ha.append(_name(s))
                    n.append(len(s))
                    wide.append(_sketch(s, _WIDE).tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pa.array(ha, pa.int64()), pa.array(n, pa.int64()), b.column(1).take(rows), pa.array(wide, pa.binary())],
                names=["doc_id", "node", "n", "t", "wide"],
            )

    return docs.select("doc_id", F.col(text).cast("binary").alias("t")).mapInArrow(
        run, "doc_id long, node long, n long, t binary, wide binary"
    )


def _name(tokens: np.ndarray) -> int:
    return int(mix(tokens * _M[2]).sum(dtype=_U).view(np.int64))


def _candidates(part: dict[str, np.ndarray], percent: int, every: bool) -> tuple[np.ndarray, ...]:
    """Pairs (a, b, bits) of one sorted run of lists that may link: ``part`` is sorted by (list, n).

    Entries of a list are taken in blocks; of a block only the later entries whose sizes fit are
    looked at, and blocks whose positions leave no room are skipped. ``every`` false keeps of long
    lists, for each entry, the one partner of a smaller node whose sketch is nearest, which is what
    lists in common agree on.
    """
    ids, n, pos = part["list"], part["n"], part["pos"]
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    stop = np.r_[start[1:], len(ids)]
    out: list[np.ndarray] = []

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fit = (100 * n[i] >= percent * n[j]) & (part["comp"][i] != part["comp"][j])
        fit &= (part["side"][i] == 3) | (part["side"][i] != part["side"][j])
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        fit &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
        i, j, need = i[fit], j[fit], need[fit]
        bits = np.bitwise_count(part["sketch"][i] ^ part["sketch"][j]).sum(axis=1, dtype=np.int64)
        ok = bits <= n[i] + n[j] - 2 * need
        return i[ok], j[ok], bits[ok]

    def put(i, j, bits):
        a, b = part["node"][i], part["node"][j]
        out.append(np.stack([np.maximum(a, b), bits, np.minimum(a, b)], axis=1))

    length = stop - start
    for size in np.unique(length[(length > 1) & (length <= SHORT)]):  # short lists of one length at once
        at = start[length == size]
        x, y = np.triu_indices(size, 1)
        step = max(1, 30_000 // len(x))
        for k in range(0, len(at), step):
            base = at[k : k + step, None]
            put(*test((base + x).ravel(), (base + y).ravel()))
    short = len(out)
    for s, e in zip(start[length > SHORT], stop[length > SHORT]):
        for lo in range(s, e, _GRID[0]):
            hi = min(lo + _GRID[0], e)
            end = s + np.searchsorted(n[s:e], 100 * n[hi - 1] // percent, side="right")
            for to in range(lo, end, _GRID[1]):
                last = min(to + _GRID[1], end)
                need = -(-percent * (n[lo] + n[to]) // (100 + percent))
                if min((n[lo:hi] - pos[lo:hi]).max(), (n[to:last] - pos[to:last]).max()) < need:
                    continue
                i, j = np.meshgrid(np.arange(lo, hi), np.arange(to, last), indexing="ij")
                later = i < j
                put(*test(i[later], j[later]))

    def pairs(parts, first):
        if not parts:
            return np.zeros((0, 3), np.int64)
        found = np.unique(np.concatenate(parts), axis=0)
        if first and len(found):  # sorted by the larger node, then nearness: the first of each
            found = found[np.r_[True, found[1:, 0] != found[:-1, 0]]]
        return found

    found = np.concatenate([pairs(out[:short], False), pairs(out[short:], not every)])
    return found[:, 2], found[:, 0], found[:, 1]


def _pairs(entries: DataFrame, percent: int, every: bool) -> DataFrame:
    """Candidate ``(a, b, bits)`` of ``entries(token, cell, side, node, comp, n, pos, sketch)``."""

    def run(batches):
        kept: list[pa.Table] = []

        def work(table: pa.Table):
            if not table.num_rows:
                return
            col = {k: table.column(k).to_numpy() for k in ("token", "cell", "side", "node", "comp", "n", "pos")}
            new = (np.diff(col["token"], prepend=col["token"][:1]) != 0) | (np.diff(col["cell"], prepend=col["cell"][:1]) != 0)
            raw = b"".join(table.column("sketch").to_pylist())
            col["list"], col["sketch"] = np.cumsum(new), np.frombuffer(raw, dtype=_U).reshape(-1, _SKETCH)
            found = _candidates(col, percent, every)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "bits"])

        rows = 0
        for b in batches:
            kept.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < 30_000:
                continue
            table = pa.concat_tables(kept)  # all but the last list are whole
            t, c = table.column("token").to_numpy(), table.column("cell").to_numpy()
            whole = np.flatnonzero((t != t[-1]) | (c != c[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            yield from work(table.slice(0, cut))
            kept, rows = [table.slice(cut)], len(t) - cut
        if kept:
            yield from work(pa.concat_tables(kept))

    dealt = entries.repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "node")
    return dealt.mapInArrow(run, "a long, b long, bits long").distinct()


def _celled(entries: DataFrame) -> DataFrame:
    """Deal long lists: entries fall in parts by node, and each pair of parts is a cell of its own.

    ``side`` is 3 in the cells of one part, else 1 or 2 for the lesser and greater part, and only
    entries of different sides (or side 3) are compared.
    """
    sizes = entries.groupBy("token").agg(F.count("*").alias("len")).where(F.col("len") > LIST_PART)
    sizes = materialise(sizes.select("token", F.ceil(F.col("len") / LIST_PART).cast("int").alias("parts")))
    if nothing(sizes):
        return entries.withColumn("cell", F.lit(0).cast("long")).withColumn("side", F.lit(3))
    dealt = entries.join(sizes, "token", "left")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("long")
    other = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
    cells = F.transform(
        other,
        lambda o: F.struct(
            (F.least(mine, o) * F.col("parts") + F.greatest(mine, o)).alias("cell"),
            F.when(o == mine, 3).when(mine < o, 1).otherwise(2).alias("side"),
        ),
    )
    one = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(3).alias("side")))
    dealt = dealt.withColumn("_c", F.explode(F.when(F.col("parts").isNull(), one).otherwise(cells)))
    return dealt.select(*entries.columns, "_c.cell", "_c.side")


def _long(entries: DataFrame) -> DataFrame:
    """The tokens whose lists gave but one partner an entry."""
    return materialise(entries.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > SHORT).select("token"))


def _linked(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """``(a, b)`` of ``pairs`` whose whole sets link."""

    def run(batches):
        hasher = WordHasher()
        for b in slices(batches, 250):
            both = (shingle_sets(hasher, b.column(c).to_pylist(), size) for c in ("ta", "tb"))
            keep = []
            for x, y in zip(*both):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("node").alias("a"), F.col("t").alias("ta")), sets.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` those that may link by their wide sketches, with the bits they differ in."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("wide").alias(f"w{k}"), F.col("n").alias(f"n{k}"))

    def run(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), dtype=_U).reshape(-1, _WIDE) for x in ("wa", "wb"))
            bits = np.bitwise_count(a ^ c).sum(axis=1, dtype=np.int64)
            both = b.column("na").to_numpy() + b.column("nb").to_numpy()
            keep = bits <= both - 2 * -(-percent * both // (100 + percent))
            found = pa.RecordBatch.from_arrays([*[b.column(x) for x in ("a", "b", "ra", "rb")], pa.array(bits)], names=["a", "b", "ra", "rb", "bits"])
            yield found.filter(pa.array(keep))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", "ra", "rb", "wa", "wb", "na", "nb").mapInArrow(run, "a long, b long, ra long, rb long, bits long")


def _groups(docs: DataFrame, index: DataFrame, entries: DataFrame, sketches: DataFrame, size: int, percent: int):
    """``(node, root)`` of all links, or None without any."""
    if nothing(entries):
        return None

    def candidates(some: DataFrame, every: bool) -> DataFrame:
        return materialise(_pairs(_celled(some).join(sketches, "node"), percent, every))

    def whole(pairs: DataFrame) -> DataFrame:
        # whole sets are made again, only of what is met in a pair
        nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        few = nodes.count() <= BROADCAST_NODES
        wanted = F.broadcast(nodes) if few else nodes
        # each is asked of one document by key, so that it comes once but for rows that are alike
        rows = index.join(wanted, index["ha"] == wanted["node"]).groupBy("node", "doc_id").agg(F.count("*").alias("c"))
        ask = rows.groupBy("node").agg(F.min("doc_id").alias("key"), F.min_by("c", "doc_id").alias("c"))
        ask = materialise(ask)
        sent = F.broadcast(ask) if few else ask
        keys = ask.select(F.col("key").alias("k")).distinct()
        some = docs.join(F.broadcast(keys) if few else keys, docs["doc_id"].eqNullSafe(F.col("k")), "left_semi")
        sets = _sets(some, "text", size)
        sets = sets.join(sent, (sets["node"] == sent["node"]) & sets["doc_id"].eqNullSafe(sent["key"])).select(sets["node"], "n", "t", "wide")
        return materialise(sets if nothing(ask.where("c is null or c > 1")) else sets.dropDuplicates(["node"]))

    def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        ra, rb = groups.toDF("a", "ra"), groups.toDF("b", "rb")
        named = pairs.join(ra, "a", "left").join(rb, "b", "left")
        named = named.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
        return named.where("ra <> rb")

    def linking(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return materialise(_linked(pairs.select("a", "b"), sets, size, percent).toDF("u", "v"))

    met = candidates(entries.withColumn("comp", F.col("node")), False)
    if nothing(met):
        return None
    nearest = met.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x"))
    first = materialise(nearest.select("x.a", "b"))
    links = linking(first, whole(first))
    groups = components(links)
    named = entries.join(_long(entries), "token", "left_semi").join(groups, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    named = materialise(named)
    lists = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    again = materialise(named.join(materialise(lists.where("lo < hi").select("token")), "token"))
    left = met.select("a", "b")
    if not nothing(again):
        left = left.union(candidates(again, True).select("a", "b")).distinct()
    left = materialise(apart(left.join(first, ["a", "b"], "left_anti"), groups))
    if nothing(left):
        return groups
    sets = whole(left)
    left = materialise(_bounded(left, sets, percent))
    # of each two groups the nearest pair first, then what is still apart
    near = materialise(left.groupBy("ra", "rb").agg(F.min(F.struct("bits", "a", "b")).alias("x")).select("x.a", "x.b"))
    links = links.union(linking(near, sets))
    groups = components(links)
    rest = materialise(apart(left.select("a", "b").join(near, ["a", "b"], "left_anti"), groups))
    if nothing(rest):
        return groups
    return components(links.union(linking(rest, sets)))


def _entries(classes: DataFrame, percent: int) -> DataFrame:
    """``(token, node, n, pos)`` of all lists that may hold a link: all entries are sorted once, and
    what has no neighbour of its token goes, as do lists of two or three of too unlike sizes.

    Frequent tokens are dealt into parts, so that no task sorts a hot list; such parts pass as they
    are. Sizes are read from neighbours in order of size; a task holds one batch and the end of a list.
    """
    prefix = F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x")
    rows = classes.select("node", F.col("n").cast("int").alias("n"), prefix)
    part = F.when(F.col("x.parts") > 1, F.pmod(F.xxhash64("node"), F.col("x.parts")).cast("int") + 1).otherwise(0)
    rows = rows.select(F.col("x.prefix").alias("token"), part.alias("part"), "n", "node", "pos")

    def run(batches):
        left, long = None, False
        for b in batches:
            now = pa.Table.from_batches([b] if left is None else [left, b]).combine_chunks().to_batches()[0]
            token, part = now.column("token").to_numpy(), now.column("part").to_numpy()
            turn = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1
            if len(turn):  # all but the last list are whole
                yield _listed(now, _useful(now, int(turn[-1]), percent, int(turn[0]) if long else 0))
                left, long = now.slice(int(turn[-1])), False
            elif now.num_rows > 3:  # one list, and it goes on
                yield _listed(now, np.ones(now.num_rows - 1, bool))
                left, long = now.slice(now.num_rows - 1), True
            else:
                left = now
        if left is not None and left.num_rows:
            yield _listed(left, _useful(left, left.num_rows, percent, left.num_rows if long else 0))

    sorted_ = rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node")
    return sorted_.mapInArrow(run, "token long, node long, n long, pos long")


def _listed(rows: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    """The first rows that ``keep`` has an answer for, where it is true."""
    some = rows.slice(0, len(keep)).filter(pa.array(keep))
    wide = [some.column(c).cast(pa.int64()) for c in ("token", "node", "n", "pos")]
    return pa.RecordBatch.from_arrays(wide, names=["token", "node", "n", "pos"])


def _useful(rows: pa.RecordBatch, end: int, percent: int, sure: int) -> np.ndarray:
    """Which of the first ``end`` rows, whole lists sorted by size, have a neighbour that they may link
    to; the first ``sure`` rows belong to a long list."""
    token, part, n = (rows.column(c).to_numpy()[:end] for c in ("token", "part", "n"))
    fits = (token[1:] == token[:-1]) & (part[1:] == part[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
    # in order of size the nearest sizes are neighbours; parts of a dealt list have neighbours elsewhere
    keep = np.r_[False, fits] | np.r_[fits, False] | (part > 0)
    keep[:sure] = True
    return keep


def _classes(index: DataFrame) -> DataFrame:
    """``(node, n, low, sketch, prefix, parts)`` of each different set. Only narrow rows are grouped: the
    sets that several rows have are sent to the index, and of their rows the one of least doc_id stays."""
    having = index.where("n > 0")
    rows = having.groupBy("ha", F.col("doc_id").alias("low")).agg(F.count("*").alias("c"))
    # a null doc_id is no name, but a set may have no other
    first = F.min(F.struct(F.col("low").isNull().alias("nul"), "low", "c"))
    several = rows.groupBy("ha").agg(first.alias("f"), F.sum("c").alias("c")).where("c > 1")
    several = materialise(several.select(F.col("ha").alias("h"), F.col("f.low").alias("low"), F.col("f.c").alias("same")))
    told = small(several, BROADCAST_NODES)
    met = having.join(told, having["ha"] == told["h"], "left")
    kept = met.where(F.col("h").isNull() | F.col("doc_id").eqNullSafe(F.col("low")))
    kept = kept.select(F.col("ha").alias("node"), "n", F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("low"), "sketch", "prefix", "parts")
    if not nothing(several.where("same > 1")):
        return materialise(kept.dropDuplicates(["node"]))
    # sent to the index, it is no work to do again; with a shuffle, it is
    return kept if told is not several else materialise(kept)


def join(docs: DataFrame, text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Documents link if ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id reachable by links. Null, empty and blank texts have no
    shingles and link with nothing: their component is their own doc_id. Repeated rows are
    documents of their own that link. A null doc_id is no candidate for a component's name; a
    component of null doc_ids only has none. Other columns are ignored. No rows in, no rows out.
    Sets are named by 64-bit hashes: with N different sets two unlike ones meet by chance with
    odds N * N / 2**65.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    heavy = _heavy(docs, "text", size)
    index = materialise(_index(docs, "text", size, percent, heavy))
    classes = _classes(index)
    entries = materialise(_entries(classes, percent))
    groups = _groups(docs, index, entries, classes.select("node", "sketch"), size, percent)
    lows = classes.select("node", "low")
    if groups is not None:
        lows = materialise(lows.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
        least = materialise(lows.groupBy("root").agg(F.min("low").alias("component_id")))
        lows = materialise(lows.join(least, "root").select("node", "component_id"))
    else:
        lows = lows.withColumnRenamed("low", "component_id")
    # documents without a set match nothing: dealt out instead of meeting in one task
    key = F.when(F.col("n") > 0, F.col("ha")).otherwise(F.xxhash64("doc_id"))
    found = index.select("doc_id", "n", key.alias("node")).join(lows, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
