"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines that are equal in lower case and without outer blanks are one node. A node's set holds the
hashes of its character shingles: every window of SHINGLE characters (a shorter line is its own shingle). Its
signature are the SKETCH smallest hashes (bottom-k MinHash); every two that follow each other are a key, and lines with
a common key are candidates. A pair at the similarity THRESHOLD has no common key with a probability below one in a million.

The lines of candidates are read once more and get a parity mark: BITS bits, of which each shingle flips one. Two marks differ in
at most as many bits as the sets differ in shingles, so marks that differ in more than the threshold allows rule a
pair out for certain; hardly any others are left. These are verified by the exact Jaccard similarity of their whole sets, which are
built once a node. Candidates are first each line of a bucket with its most central one. Buckets that hold several components
after that are compared inside a row, in rounds: every line hands on its closest partners in other components only, confirmed
links unite components, and a block is done once a round has handed on all that it had. The confirmed links go
through distributed union-find (see ``linking``). Of each component the first occurrence stays: the smallest
document id, then the smallest line number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import shuffle_width, stage, table
from llm.linking import components, open_members, ordered_pairs, star_pairs
from querylens.session import broadcast_if_small

SHINGLE = 16
#: Similarity in per cent from which lines are linked.
THRESHOLD = 80
#: Bytes of a character, the same for all of a line, so that a window is a slice at a known place: two, or four in a line with characters beyond U+FFFF.
_NARROW, _WIDE = 2, 4
#: Hashes of a signature.
SKETCH = 22
#: Of a long line only about so many of the smallest hashes are sorted.
_SORTED = 44
#: What a blank line may hold, and what it may end with.
_BLANKS, _ENDS = "\t\n\x0b\f\r", ("", "\x85", "\u2028", "\u2029")
#: Bits of a mark, in words of 64.
WORDS = 16
BITS = 64 * WORDS
#: Partners that a line hands on in the first round, and by how much this grows from round to round.
PARTNERS, MORE = 16, 16
#: About what a broadcast id takes in memory.
ROW_BYTES = 64


def plain(line: Column) -> Column:
    """What lines in lower case are compared by; null for a blank line."""
    text = F.trim(line)
    return F.when(~F.ltrim(text, F.lit(_BLANKS)).isin(*_ENDS), text)


def lines_of(df: DataFrame) -> DataFrame:
    """(doc_id, digest, line_no, norm) of every line of every document; an empty text is one blank line. digest: tells rows with the same id apart."""
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = texts.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "digest", "line_no", plain(F.col("line")).alias("norm"))


def node(norm: Column) -> Column:
    return F.xxhash64(norm)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, wherever the expression ends up in the plan."""
    return F.transform(F.array(value), use)[0]


def shingles(norm: Column, by: Callable[..., Column] = F.xxhash64) -> Column:
    """Hashes of the shingles, in the order of the line and with repeats. All are hashed in UTF-16, whatever they are cut from."""
    last = lambda units, wide: F.greatest(F.lit(1), F.octet_length(units) - (wide * SHINGLE - 1))
    cut = lambda units, wide, use: F.transform(F.sequence(F.lit(1), last(units, wide), F.lit(wide)), lambda start: by(use(F.substr(units, start, F.lit(wide * SHINGLE)))))
    far = bound(F.encode(norm, "UTF-32"), lambda units: cut(units, _WIDE, lambda window: F.encode(F.decode(window, "UTF-32"), "UTF-16BE")))
    return bound(F.encode(norm, "UTF-16BE"), lambda units: F.when(F.octet_length(units) == _NARROW * F.char_length(norm), cut(units, _NARROW, lambda window: window)).otherwise(far))


def similar(one: Column, other: Column) -> Column:
    """Whether two whole sets reach the threshold."""
    counted = F.struct(F.size(F.array_intersect(one, other)).alias("n"), (F.size(one) + F.size(other)).alias("both"))
    return bound(counted, lambda q: 100 * q["n"] >= THRESHOLD * (q["both"] - q["n"]))


def signatures(lines: DataFrame) -> DataFrame:
    """(node, sketch): the smallest distinct hashes, in 32 bits; only a line that repeats its smallest ones needs all of them sorted.

    Each step is a column of its own, outside functions on elements: so Spark compiles the sorting, on plain integers.
    """
    n, lowest = F.size("hashes"), lambda values: F.slice(F.sort_array(F.array_distinct(values)), 1, SKETCH)
    limit = F.when(n > 2 * _SORTED, (F.lit(2.0**32 * _SORTED) / n - 2.0**31).cast("int"))
    hashed = lines.select("node", shingles(F.col("norm"), F.hash).alias("hashes"))
    limited = hashed.select("node", "hashes", limit.alias("limit"))
    few = F.when(F.col("limit").isNull(), F.col("hashes")).otherwise(F.filter("hashes", lambda x: x < F.col("limit")))
    tried = limited.select("node", "hashes", "limit", lowest(few).alias("few"))
    return tried.select("node", F.when(F.col("limit").isNull() | (F.size("few") >= SKETCH), F.col("few")).otherwise(lowest(F.col("hashes"))).alias("sketch"))


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node): one key for every two hashes that follow each other in a node's signature; a single one has a key of its own."""
    at = lambda i: F.get("sketch", i)
    places = nodes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("sketch") - 2))).alias("i"))
    return places.select("node", F.xxhash64(at(F.col("i")), F.coalesce(at(F.col("i") + 1), at(F.col("i")))).alias("key"))


def keyed_members(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of buckets with two nodes, and (key, node, n, total) of larger ones; only small rows are counted, and none are gathered."""
    keys = buckets(nodes)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    sizes = stage(sizes, "op5-sizes")
    large = stage(sizes.where("n > 2").select("key", "n"), "op5-large")
    # marks have one size, so the weight of a block is its number of rows
    members = keys.join(broadcast_if_small(large, ROW_BYTES), "key").select("key", "node", "n", F.lit(0).alias("total"))
    return sizes.where("n = 2").select("a", "b").distinct(), stage(members, "op5-members")


def texts_of(together: DataFrame, rows: DataFrame, df: DataFrame) -> DataFrame:
    """(node, norm) of the nodes in shared buckets: one document of each is read again, and all without an id, as those cannot be told apart."""
    near = broadcast_if_small(together, ROW_BYTES)
    places = stage(rows.join(near, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("place")).where("place IS NOT NULL").select("place").distinct(), "op5-places")
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = texts.join(broadcast_if_small(places, ROW_BYTES), F.col("doc_id") == F.col("place"), "left_semi").union(texts.where("doc_id IS NULL"))
    lines = lines_of(again).where("norm IS NOT NULL").withColumn("node", node(F.col("norm")))
    return stage(lines.join(near, "node", "left_semi").dropDuplicates(["node"]).select("node", "norm"), "op5-texts")


def marks_of(texts: DataFrame) -> DataFrame:
    """(node, size, w0 to w15): the size of the node's set and the parities of its shingles by place."""
    # all further work on a node stays in its task: its bits per word first, then its words side by side
    sets = texts.repartition(shuffle_width(texts.sparkSession), "node").select("node", F.array_distinct(shingles(F.col("norm"))).alias("shingles"))
    # no set is empty; without "outer" Spark would add a test of its size that cuts and hashes the line once more
    each = sets.select("node", F.size("shingles").alias("size"), F.explode_outer("shingles").alias("x"))
    flip, word = F.expr("shiftleft(1L, CAST(x & 63 AS INT))"), F.shiftright("x", 6).bitwiseAND(F.lit(WORDS - 1))
    flips = each.groupBy("node", "size", word.alias("word")).agg(F.bit_xor(flip).alias("bits"))
    words = [F.bit_xor(F.when(F.col("word") == i, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
    return stage(flips.groupBy("node", "size").agg(*words), "op5-marks")


def apart(x: Column, y: Column, words: int = WORDS) -> Column:
    """Bits in which the first words of two marks differ."""
    total = F.bit_count(x["w0"].bitwiseXOR(y["w0"]))
    for i in range(1, words):
        total = total + F.bit_count(x[f"w{i}"].bitwiseXOR(y[f"w{i}"]))
    return total


def likely(x: Column, y: Column) -> Column:
    """Whether sizes and marks allow the threshold; no pair that reaches it is ruled out. A quarter of a mark rules most pairs out."""
    sizes = (100 * y["size"] >= THRESHOLD * x["size"]) & (100 * x["size"] >= THRESHOLD * y["size"])
    allowed = lambda words: (100 + THRESHOLD) * apart(x, y, words) <= (100 - THRESHOLD) * (x["size"] + y["size"])
    return sizes & allowed(WORDS // 4) & allowed(WORDS // 2) & allowed(WORDS)


def mark(df: DataFrame, *more: str) -> Column:
    return F.struct(*more, "node", "size", *[f"w{i}" for i in range(WORDS)])


def likely_pairs(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    a, b = (marks.select(F.col("node").alias(x), mark(marks).alias(f"m{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(likely(F.col("ma"), F.col("mb"))).select("a", "b")


def compared(blocks: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """(key, block, pairs, more): per line of a block the ``most`` closest likely partners in other components, sets no larger than its own; more: whether any line had further ones.

    Two lines that share several buckets are compared in all of them, but handed on in that of the smallest key only.
    """
    # a node has a key for every two hashes of its signature at most
    keys = blocks.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    # rows are few and small, but the work grows with the square of a block: as many tasks as the session allows
    dealt = blocks.join(marks.join(keys, "node"), "node").repartition(shuffle_width(blocks.sparkSession), "key", "block")
    held = dealt.groupBy("key", "block").agg(F.collect_list(mark(marks, "component", "keys")).alias("held"))
    owned = lambda x, y: F.col("key") == F.array_min(F.array_intersect(x["keys"], y["keys"]))
    # from the larger set to the smaller, so that a pair is looked at once; most lines of a block are of one component, then sizes rule most pairs out
    order = lambda x, y: (y["size"] <= x["size"]) & (100 * y["size"] >= THRESHOLD * x["size"]) & ((y["size"] < x["size"]) | (y["node"] < x["node"]))
    fits = lambda x, y: (x["component"] != y["component"]) & order(x, y) & likely(x, y) & owned(x, y)
    ranked = lambda x: F.transform(F.filter("held", lambda y: fits(x, y)), lambda y: F.struct((apart(x, y) / (x["size"] + y["size"])).alias("far"), y["node"].alias("y")))
    partners = F.transform("held", lambda x: F.struct(x["node"].alias("x"), F.sort_array(ranked(x)).alias("found")))
    tried = held.select("key", "block", F.filter(partners, lambda p: F.size(p["found"]) > 0).alias("tried"))
    nearest = lambda p: F.transform(F.slice(p["found"], 1, most), lambda f: F.struct(p["x"].alias("x"), f["y"].alias("y")))
    return tried.select("key", "block", F.flatten(F.transform("tried", nearest)).alias("pairs"), F.exists("tried", lambda p: F.size(p["found"]) > most).alias("more"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""
    wanted = stage(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node")), "op5-wanted")
    sets = texts.join(broadcast_if_small(wanted, ROW_BYTES), "node", "left_semi")
    sets = stage(sets.select("node", F.array_distinct(shingles(F.col("norm"))).alias("shingles")), "op5-sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return stage(pairs.join(a, "a").join(b, "b").where(similar(F.col("sa"), F.col("sb"))).select("a", "b"), "op5-edges")


def linked(nodes: DataFrame, rows: DataFrame, df: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a confirmed link."""
    twos, members = keyed_members(nodes)
    together = stage(twos.select("a").union(twos.select("b")).union(members.select("node")).distinct().select(F.col("a").alias("node")), "op5-together")
    texts = texts_of(together, rows, df)
    marks = marks_of(texts)
    tried = stage(likely_pairs(star_pairs(members).union(twos).distinct(), marks), "op5-pairs")
    edges = verified(tried, texts)
    found = components(edges, "op5-components")
    blocks, most = open_members(members, found), PARTNERS
    while True:
        round_ = stage(compared(blocks, marks, most), "op5-round")
        pairs = ordered_pairs(round_.select(F.explode("pairs").alias("p")).select("p.x", "p.y"), "x", "y")
        fresh = stage(pairs.join(tried, ["a", "b"], "left_anti"), "op5-pairs")
        if fresh.take(1):
            tried, links = tried.union(fresh), verified(fresh, texts)
            found = united(found, links) if links.take(1) else found
        left = round_.where("more").select("key", "block")
        if not left.take(1):
            return found
        blocks, most = open_members(members, found).join(left, ["key", "block"], "left_semi"), most * MORE


def united(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links, of which only the small graph between components is worked through."""
    named = lambda side: F.coalesce(f"{side}_component", side).alias(side)
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in "ab")
    merged = components(links.join(a, "a", "left").join(b, "b", "left").select(named("a"), named("b")), "op5-components")
    nodes = found.union(merged.select("node", F.col("node").alias("component"))).dropDuplicates(["node"])
    target = merged.select(F.col("node").alias("component"), F.col("component").alias("target"))
    return stage(nodes.join(target, "component", "left").select("node", F.coalesce("target", "component").alias("component")), "op5-found")


def line_rows(df: DataFrame) -> DataFrame:
    """As ``line_classes``, with the digest of the row's text."""
    lines = lines_of(df)
    rows = stage(lines.select("doc_id", "digest", "line_no", F.when(F.col("norm").isNotNull(), node(F.col("norm"))).alias("node")), "op5-rows")
    signed = signatures(lines.where("norm IS NOT NULL").select(node(F.col("norm")).alias("node"), "norm"))
    found = linked(stage(signed.dropDuplicates(["node"]), "op5-nodes"), rows, df)
    labelled = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "digest")
    firsts = labelled.where("node IS NOT NULL").groupBy("component").agg(F.min(place).alias("first"))
    own = F.coalesce("first", place)
    return labelled.join(firsts, "component", "left").select(
        "doc_id", "digest", "line_no", own["doc_id"].alias("first_doc_id"), own["line_no"].alias("first_line_no"), (own == place).alias("kept")
    )


def line_classes(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, kept) of every line of (doc_id, text) rows.

    first_*: the first occurrence in the line's component. A null or empty text is one blank line. Blank
    lines are their own first and always kept. A null doc_id comes after all ids. Rows that repeat an
    id are documents of their own, told apart by a digest of their text, which also decides between equal places; rows that agree in id and text are
    one document said twice, whose lines are kept or dropped alike. An empty table gives no rows; extra columns, whatever their names, are ignored.
    """
    return line_rows(df).drop("digest")


def fresh_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without_repeats(df: DataFrame, leave_out_emptied: bool = False) -> DataFrame:
    """The documents with only the kept lines in their text; all columns stay, whatever their names.

    Of rows that agree in id and text, both keep the lines that are kept; a null id is an id like others here. All rows stay
    as well, unless ``leave_out_emptied``: then documents that lose lines and have only blank ones left go.
    """
    row, gone = fresh_name(df, "row"), fresh_name(df, "gone")
    key = lambda doc_id, digest: F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), digest.alias("digest"))
    drops = line_rows(df).where("NOT kept").select(key(F.col("doc_id"), F.col("digest")).alias(row), "line_no")
    drops = drops.groupBy(row).agg(F.collect_set("line_no").alias(gone))
    joined = df.withColumn(row, key(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))).join(drops, row, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("text", text)
    if leave_out_emptied:
        out = out.where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*df.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))
