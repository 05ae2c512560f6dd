"""Fuzzy duplicate lines by MinHash, in DataFrame functions only: one line of each component of similar lines is kept.

Lines are brought to a normal form (lower case, outer white space cut) and equal ones become one node, summed up before the
shuffle, so a line that is everywhere costs one row for each task. A node's signature is taken from the hashes of all its
five-character shingles, sorted once and read as a circle. Lines of up to SMALL shingles give every run of FEW hashes that follow
each other; as similar sets have FEW common shingles for each one that differs, two of them always share a run. Lines of more than
LARGE give the runs of MANY behind fixed points of the circle: the minima of so many turned permutations; other points in a run
count as hashes that all lines have. In between both are given.

In each bucket nodes are compared with the bucket's smallest node; buckets known from a sample to be hot are salted first and
their smallest nodes compared with each other. Buckets that still hold several components compare them with a leader
drawn by hash, ROUNDS times. What is left apart then is compared across, in blocks, but for pairs that parity bitmaps rule out: each
shingle flips one bit, so two bitmaps differ in at most as many bits as the sets have different members, and no link is ruled out.
Every link is confirmed by the exact Jaccard similarity of the full sets of shingles; components come from hooking and contraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import sides
from .common import NO_ID, discard, fresh, store
from .components import components

#: Hashes of a run of a small line and of a large one; shingles from which a line is large, and up to which it is small.
FEW, MANY, LARGE, SMALL = 4, 6, 32, 40
#: 2 ** BITS fixed points lie on the circle of signed 64-bit hashes; each is a band of a large line.
BITS = 4
#: Length of the shingles in UTF-16 code units: characters, but that those beyond the basic plane count as two.
EXACT = 5
#: Lines up to this length (in normal form) are left alone: blank ones.
SHORT = 0
#: One line in SAMPLE is looked at to find hot buckets; they have HOT or more of those lines, and over a thousandth of all.
SAMPLE, HOT, SALTS = 64, 256, 64
#: Times that open buckets draw a leader.
ROUNDS = 2
#: A parity bitmap has so many words of 64 bits, made SPLIT at a time; of sets of several thousand shingles it tells little, and more pairs are compared in full.
PARITY, SPLIT = 32, 8
#: Ids up to which a set of ids is sent to every executor; beyond that it is joined.
SENT_IDS = 1_000_000


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\n\x0b\x0c\r")))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def mark(at: Column, line: Column) -> Column:
    """Names a line within its document: its place and what it says."""
    return F.xxhash64(at.cast("int"), line)


def hashes(line: Column) -> Column:
    """One hash for each five-character shingle, in order; of the line itself if it is shorter."""
    own = lambda u, i: F.xxhash64(F.substring(u, i, F.lit(2 * EXACT)))
    places = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - (2 * EXACT - 1), F.lit(1)), F.lit(2))
    # within transform() the encoded line is made once, not for each shingle
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), lambda u: F.transform(places(u), lambda i: own(u, i))), F.lit(0))


def _members(rows: DataFrame) -> DataFrame:
    """For each normal form a row for each of its bands: node, doc, at (first place), times (places), turn (from 0), band."""
    own = rows.groupBy("node").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("times"), F.first("line").alias("line"))
    own = own.select("node", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), "times", F.array_distinct(hashes(F.col("line"))).alias("v"))
    points = F.array(*(F.lit(p << (64 - BITS)) for p in range(-(2 ** (BITS - 1)), 2 ** (BITS - 1))))
    none, ring = F.array().cast("array<long>"), lambda v, n: F.concat(v, F.slice(v, 1, n - 1))
    run = lambda c, i: F.xxhash64(F.sort_array(F.slice(c, i, FEW)))
    runs = F.transform(F.array(ring(F.sort_array("v"), FEW)), lambda c: F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: run(c, i)))
    own = own.withColumn("small", F.when(F.size("v") <= SMALL, F.get(runs, F.lit(0))).otherwise(none))
    own = own.withColumn("circle", F.when(F.size("v") > LARGE, ring(F.sort_array(F.concat("v", points)), MANY + 1)).otherwise(none)).drop("v")
    # points are told by their low bits, in one pass; array_position() for each would be many. What a lambda uses has to be its own: a
    # column of the project below would be made anew for each element
    point = lambda c, x, i: (x.bitwiseAND(F.lit(2 ** (64 - BITS) - 1)) == 0) & (i < F.size(c) - MANY)
    places = lambda c: F.filter(F.transform(c, lambda x, i: F.when(point(c, x, i), i)), lambda x: x.isNotNull())
    behind = F.transform(F.array("circle"), lambda c: F.transform(places(c), lambda i: F.xxhash64(F.slice(c, i + 2, F.lit(MANY)))))
    large = F.when(F.size("circle") > 0, F.get(behind, F.lit(0))).otherwise(none)
    own = own.select("node", "doc", "at", "times", F.concat("small", large).alias("bands"))
    # outer, though there always is a band: else a filter is made of all these expressions once more
    return own.select("node", "doc", "at", "times", F.posexplode_outer("bands").alias("turn", "band"))


def _stars(members: DataFrame, hot: list[int]) -> DataFrame:
    """Pairs (a, b) of the smallest node of each bucket with every other."""
    salt = F.when(F.col("band").isin(hot), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    upto = Window.partitionBy("band", "salt").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = members.withColumn("salt", salt).withColumn("a", F.min("node").over(upto))
    out = led.where("a <> node").select("a", F.col("node").alias("b"))
    if hot:
        tops = led.where(F.col("band").isin(hot) & (F.col("a") == F.col("node"))).select("band", "node")
        over = Window.partitionBy("band").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.union(tops.withColumn("a", F.min("node").over(over)).where("a <> node").select("a", F.col("node").alias("b")))
    return out.distinct()


def _texts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, line, size) of the nodes in pairs; size counts distinct shingles."""
    wanted = store(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
    own = rows.select("node", "line").join(ids, "node", "left_semi").groupBy("node").agg(F.first("line").alias("line"))
    out = store(own.select("node", "line", F.size(F.array_distinct(hashes(F.col("line")))).alias("size")), "texts")
    discard(wanted)
    return out


def _confirm(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar, by the full sets of their lines."""
    x, y = (texts.select(F.col("node").alias(k), F.col("line").alias(v), F.col("size").alias(f"{v}_size")) for k, v in (("a", "x"), ("b", "y")))
    sizes = [texts.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size")) for k in ("a", "b")]
    likely = pairs.join(sizes[0], "a").join(sizes[1], "b").where(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))  # else they cannot be similar
    both = likely.select("a", "b").join(y, "b").join(x, "a")
    same = F.size(F.array_intersect(hashes(F.col("x")), hashes(F.col("y"))))
    return store(both.where((100 + percent) * same >= percent * (F.col("x_size") + F.col("y_size"))).select("a", "b"), "links")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, part) of the buckets with three members or more that are not all of one component."""
    placed = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("part"))
    mixed = placed.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2")
    return store(placed.join(mixed.select("band"), "band", "left_semi"), "open")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _led(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a leader of each bucket, drawn by hash, with the members of other components."""
    drawn = open_.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node"), "node", "part")).alias("top"))
    drawn = drawn.select("band", F.col("top.node").alias("lead"), F.col("top.part").alias("of"))
    return open_.join(drawn, "band").where("part <> of").select(*_pair("node", "lead")).distinct()


def _parity(line: Column) -> Column:
    """A line's parity bitmap, as an array of words: each of its distinct shingles flips one bit."""
    word = lambda x: F.pmod(F.shiftright(x, 6), F.lit(PARITY))
    flip = lambda w: lambda bits, x: bits.bitwiseXOR(F.when(word(x) == w, F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
    # shingles are dealt out to stretches of SPLIT words first, so that each word does not look at all of them
    own = lambda v, w: F.filter(v, lambda x: word(x).between(w, w + SPLIT - 1))
    few = lambda u, w: F.array(*(F.aggregate(u, F.lit(0).cast("long"), flip(i)) for i in range(w, w + SPLIT)))
    stretch = lambda v, w: F.get(F.transform(F.array(own(v, w)), lambda u: few(u, w)), F.lit(0))
    words = F.transform(F.array(F.array_distinct(hashes(line))), lambda v: F.concat(*(stretch(v, w) for w in range(0, PARITY, SPLIT))))
    return F.get(words, F.lit(0))


def _maps(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, size, map) of the nodes of open_; map is the parity bitmap."""
    ids = open_.select("node").distinct()
    return store(texts.join(ids, "node", "left_semi").select("node", "size", _parity(F.col("line")).alias("map")), "maps")


def _across(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket but no component, as far as sizes and parity bitmaps of their sets allow a link."""
    left, right = sides(open_.join(_maps(open_, texts), "node"), ["size", "map"])
    right = right.select("band", "block", "block2", F.col("node").alias("node2"), F.col("part").alias("part2"), F.col("size").alias("size2"), F.col("map").alias("map2"))
    likely = 100 * F.least("size", "size2") >= percent * F.greatest("size", "size2")
    likely &= F.expr("part <> part2 and (block <> block2 or node < node2)")
    # with so many members apart that the rest is too few; the first words alone rule out most pairs
    differ = lambda n: sum((F.bit_count(F.get("map", F.lit(i)).bitwiseXOR(F.get("map2", F.lit(i)))) for i in range(n)), F.lit(0))
    for n in (SPLIT, PARITY):
        likely &= (100 + percent) * differ(n) <= (100 - percent) * (F.col("size") + F.col("size2"))
    pairs = left.join(right, ["band", "block", "block2"]).where(likely)
    return pairs.select(*_pair("node", "node2")).distinct()


def duplicate_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80) -> DataFrame:
    """(doc, marks): for each document id the lines to remove, named by mark()."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.posexplode_outer(split_lines(F.col(text))).alias("at", "raw"))
    rows = rows.select("doc", "at", normal(F.col("raw")).alias("line"), mark(F.col("at"), F.col("raw")).alias("mark"))
    rows = rows.where(F.length("line") > SHORT).withColumn("node", F.xxhash64("line"))
    banded = store(_members(rows.select("node", "doc", "at", "line")), "bands")
    nodes, members = banded.where("turn = 0").drop("turn", "band"), banded.select("node", "band")
    sample = members.where(F.pmod("node", F.lit(SAMPLE)) == 0).groupBy("band").count().where(F.col("count") >= HOT)
    least = nodes.count() / SAMPLE / 1000  # so that no more than SMALL * 1000 buckets can be hot
    hot = [r["band"] for r in sample.where(F.col("count") > least).select("band").collect()]
    tried = store(_stars(members, hot), "stars")
    texts = _texts(rows, tried)  # every node that shares a bucket is in a star
    links = _confirm(texts, tried, percent)
    groups = store(components(links), "labels")
    # only buckets that have a pair without a link can hold several components
    apart = store(tried.join(links, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct(), "apart")
    touched = members.join(F.broadcast(apart) if apart.count() <= SENT_IDS else apart, "node", "left_semi").select("band").distinct()
    shared = store(members.join(touched, "band", "left_semi").distinct(), "shared")
    for turn in range(ROUNDS + 1):
        open_ = _open(shared, groups)
        if open_.isEmpty():
            break
        new = _led(open_, turn) if turn < ROUNDS else _across(open_, texts, percent)
        new = store(new.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _confirm(texts, new, percent)
        if not more.isEmpty():
            links = store(links.union(more), "links")
            groups = store(components(links), "labels")
        tried = tried.union(new)
        discard(open_)
    # what a component keeps is its first line; lines with one place and no link have nothing to remove
    fate = nodes.join(groups, "node", "left").where(F.col("label").isNotNull() | (F.col("times") > 1))
    fate = fate.select("node", F.coalesce("label", "node").alias("label"), F.struct("doc", "at").alias("first"))
    keep = fate.groupBy("label").agg(F.min("first").alias("keep"))
    fate = store(fate.join(keep, "label").select("node", F.col("keep.doc").alias("k_doc"), F.col("keep.at").alias("k_at")), "fate")
    gone = rows.select("node", "doc", "at", "mark").join(fate, "node").where((F.col("doc") != F.col("k_doc")) | (F.col("at") != F.col("k_at")))
    out = store(gone.groupBy("doc").agg(F.collect_set("mark").alias("marks")), "gone")
    for x in (banded, texts, apart, shared):
        discard(x)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80) -> DataFrame:
    """docs with the lines of text that copy another removed, and n_lines and n_removed added.

    Of similar lines (Jaccard similarity of percent or more of their five-character shingles in normal form, and whatever is
    linked through others) the first by doc_id and place stays, however short. Blank lines always stay. Null text stays null, with 0 lines. Null ids come after all others. Rows that share an id (or
    have none) are taken as one document: the same line at the same place is one line. Lines of any length are compared
    whole. No rows: no rows. Other columns stay; a column named like an added one is replaced.
    """
    gone = duplicate_lines(docs, text, key, percent)
    doc, marks, lines, good = fresh(docs, "doc_", "marks_", "lines_", "good_")
    gone = gone.select(F.col("doc").alias(doc), F.col("marks").alias(marks))
    out = docs.withColumn(doc, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))).join(gone, doc, "left")
    out = out.withColumn(lines, split_lines(F.col(text)))
    out = out.withColumn(good, F.when(F.col(marks).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x, i: ~F.array_contains(marks, mark(i, x)))))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = out.withColumns({"n_lines": n, "n_removed": (F.size(lines) - F.size(good)).cast("long")})
    out = out.withColumn(text, F.when(F.col("n_removed") > 0, F.array_join(good, "\n")).otherwise(F.col(text)))
    return out.select(*docs.drop("n_lines", "n_removed").columns, "n_lines", "n_removed")
