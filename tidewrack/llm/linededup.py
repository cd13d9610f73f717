"""Line dedup: an exact set-similarity join of lines, and the removal of later matches. Built-in functions only.

A line is the set of its words. Words are ordered by rarity; two sets of Jaccard 0.8 or more share a word among the
first few of each (the prefix), so lines are met by prefix words, thinned out by length, position and signatures, and
then verified on their words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm import scratch

#: Counters of word frequency; one byte each goes into the plan, whatever the size of the corpus. Spark's fast path of
#: hash aggregation is set to as many entries while they are counted.
COUNTERS = 1 << 19
FAST_PATH = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
COUNTER_BLOCK = 1 << 12
#: A word's key is its rarity class, the octave of its counter from 32 on, above 57 bits of its hash. Keys only
#: propose pairs.
LEVELS, ONCE, SHIFT = 32, 32, 57
#: Words of this octave or above may be in many lines: those are first met with HEADS lines of each word only.
FREQUENT = 9
HEADS = 4
#: What orders lines.
PLACE = ("none", "id", "version", "line")
#: So many numbers of lines, 8 bytes each, may be broadcast to pick them out.
FEW = 1 << 20
#: A character of a word.
WORD = r"[^ \t\x0b\x0c\r]"


def _pieces(line: Column) -> Column:
    """The words of a line, which end at space, tab, form feeds or carriage return, and empty pieces between. Other white
    space than the space is rare, and the split at one character is the quick one."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    plain = F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    return F.split(plain, " ")


def _words(line: Column) -> Column:
    return F.array_remove(_pieces(line), "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _byte(data: bytes, at: Column) -> Column:
    """The byte (under 128) of a literal at a place."""
    return F.ascii(F.substr(F.lit(data), at.cast("int") + 1, F.lit(1)).cast("string"))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line: none (whether the id is null), id, version (a hash of the text), doc (a number of the row), line,
    content, and c1 and c2, 128 bits of hashes that stand for the content."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.monotonically_increasing_id().alias("doc"), text.alias("text"))
    rows = rows.select("none", "id", "version", "doc", F.posexplode(_lines(F.col("text"))).alias("line", "content"))
    return rows.select("*", F.xxhash64("content").alias("c1"), F.xxhash64(F.lit(1), F.col("content")).alias("c2"))


def rarity(contents: DataFrame) -> bytes:
    """For each of ``COUNTERS`` hash classes of words, the octave of how often its words occur in ``contents``
    (content), from 32 on; 32 is once or never. Only these bytes come to the driver."""
    spark = contents.sparkSession
    seen = contents.select(F.explode(_pieces(F.col("content"))).alias("w")).filter("w <> ''")
    counts = seen.groupBy(F.xxhash64("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    zeros = spark.range(COUNTERS).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("n"))
    level = F.least(F.floor(F.log2(F.greatest(F.sum("n"), F.lit(1)))), F.lit(LEVELS - 1)).cast("int")
    levels = counts.unionByName(zeros).groupBy("at").agg(level.alias("level"))
    runs = levels.groupBy(F.expr(f"at div {COUNTER_BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "level"))).alias("run"))
    spelled = runs.select("block", F.array_join(F.transform("run", lambda r: F.call_function("chr", r["level"] + ONCE)), "").alias("run"))
    before = spark.conf.get(FAST_PATH)
    spark.conf.set(FAST_PATH, str(COUNTERS.bit_length() - 1))
    try:
        return "".join(r["run"] for r in sorted(spelled.collect())).encode()
    finally:
        spark.conf.set(FAST_PATH, before)


def line_sets(contents: DataFrame, levels: bytes) -> DataFrame:
    """Of ``contents`` with words: set, its place, n (its distinct words), sig, sig2 and prefix.

    Keys in order are words by rarity; the prefix is the first of them, so many that two sets of Jaccard 4/5 share
    one. ``sig`` and ``sig2`` have the parity of the words over 128 places: two sets differ in as many words as the two
    do in bits together, or more."""
    # A condition on n would be pushed below the keys and make them once more.
    contents = contents.filter(F.col("content").rlike(WORD))
    hashes = F.array_distinct(F.transform(_words(F.col("content")), lambda w: F.xxhash64(w)))
    level = lambda h: _byte(levels, h.bitwiseAND(F.lit(COUNTERS - 1))).cast("long")
    keys = F.sort_array(F.transform(hashes, lambda h: F.shiftleft(level(h), SHIFT).bitwiseOR(F.shiftrightunsigned(h, 64 - SHIFT))))
    rows = contents.select("set", *PLACE, keys.alias("keys"))

    # A word's place is seven bits of its hash; the one above six of them says which of the two it is in. What both have
    # together, by six bits, needs no test.
    place = lambda k: k.bitwiseAND(F.lit(63)).cast("int")
    upper = lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(1).cast("long"))
    parity = lambda bit: F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", bit(k), place(k))))
    rows = rows.withColumns({"all": parity(lambda k: F.lit(1).cast("long")), "sig2": parity(upper)})
    n = F.size("keys")
    prefix = F.slice("keys", F.lit(1), n - F.floor((4 * n + 4) / 5).cast("int") + 1)
    return rows.withColumns({"n": n, "sig": F.col("all").bitwiseXOR(F.col("sig2")), "prefix": prefix}).drop("keys", "all")


def _need(both: Column) -> Column:
    """The words that two sets of ``both`` words together must share for Jaccard 4/5."""
    return F.floor((4 * both + 8) / 9)


def _fits(a: str, b: str) -> Column:
    """Whether sets a and b (columns a_at, a_sig ...) that share the word at these places can reach Jaccard 4/5: by how many words the signatures tell apart, by length, and by what is left from the shared word on."""
    a_n, a_pos, b_n, b_pos = (part for s in (a, b) for part in (F.shiftright(f"{s}_at", 32), F.col(f"{s}_at").bitwiseAND(F.lit((1 << 32) - 1))))
    both = a_n + b_n
    most = F.least(a_pos, b_pos) + F.least(a_n - a_pos, b_n - b_pos)
    apart = F.bit_count(F.col(f"{a}_sig").bitwiseXOR(F.col(f"{b}_sig"))) + F.bit_count(F.col(f"{a}_sig2").bitwiseXOR(F.col(f"{b}_sig2")))
    return (apart <= both - 2 * _need(both)) & (5 * a_n >= 4 * b_n) & (5 * b_n >= 4 * a_n) & (most >= _need(both))


def _postings(sets: DataFrame, side: str, test: Callable[[Column], Column], *more: str) -> DataFrame:
    """One row for each prefix word of ``sets`` whose rarity class passes: token, at (the set's size above the word's
    place in it, as rows are many and have no room), and the set's columns under names of ``side``. A word that occurs but once in all lines can be shared by none and is left out."""
    each = sets.select("set", "n", "sig", "sig2", *more, F.posexplode("prefix").alias("pos", "token"))
    level = F.shiftrightunsigned("token", SHIFT) - ONCE
    each = each.withColumn("at", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")))
    return each.filter((level > 0) & test(level)).select(F.col("token").alias(f"{side}_token"), *(F.col(c).alias(f"{side}_{c}") for c in ("set", "at", "sig", "sig2", *more)))


def _wide(hashes: Column) -> Column:
    """The parity of words, given by their hashes, over 256 places, as four longs."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    part = lambda k: F.aggregate(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(3)) == k), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))
    return F.array(*(part(k) for k in range(4)))


def _pulled(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """``wanted`` (set and more) with content and wide. Up to ``FEW`` are broadcast and picked out where contents are
    read; more of them are met by a shuffle."""
    some = contents.select("set", "content")
    if wanted.count() <= FEW:
        some = some.join(F.broadcast(wanted.select("set")), "set", "left_semi")
    taken = wanted.join(some, "set").withColumn("hashes", F.transform(F.array_distinct(_words(F.col("content"))), lambda w: F.xxhash64(w)))
    return scratch.table(taken.select(*wanted.columns, "content", _wide(F.col("hashes")).alias("wide")), "pulled", compact=True)


def _matched(pairs: DataFrame, sets: DataFrame, contents: DataFrame) -> DataFrame:
    """(set): the later one of each of the ``pairs`` (x, y) of set numbers that are similar to 4/5 on their words.

    Signatures of 256 places leave hardly any but similar pairs. A set then needs one match: its nearest partner is
    verified first, and the others only of those sets that it leaves open. Each step is at most the pairs in size."""
    pairs = scratch.table(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct()
    wanted = scratch.table(sets.join(ends, "set", "left_semi").select("set", *PLACE, "n"), "wanted")
    pulled = _pulled(wanted, contents)
    of = lambda s: pulled.select(F.col("set").alias(s), F.col("n").alias(f"{s}_n"), F.col("wide").alias(f"{s}_wide"), F.struct(*PLACE).alias(f"{s}_place"))
    both = F.col("x_n") + F.col("y_n")
    apart = reduce(add, (F.bit_count(F.col("x_wide")[k].bitwiseXOR(F.col("y_wide")[k])) for k in range(4)))
    near = pairs.join(of("x"), "x").join(of("y"), "y").withColumn("apart", apart).filter(F.col("apart") <= both - 2 * _need(both))
    later = F.col("x_place") > F.col("y_place")
    near = near.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("set"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("other"), "apart")
    near = scratch.table(near, "near")
    a, b = pulled.select("set", F.col("content").alias("a")), pulled.select(F.col("set").alias("other"), F.col("content").alias("b"))

    def verified(some: DataFrame) -> DataFrame:
        met = some.join(a, "set").join(b, "other").select("set", F.array_distinct(_words(F.col("a"))).alias("a"), F.array_distinct(_words(F.col("b"))).alias("b"))
        return met.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("set").distinct()

    best = near.groupBy("set").agg(F.min(F.struct("apart", "other")).alias("best"))
    best = scratch.table(best.select("set", F.col("best.other").alias("other")), "best")
    sure = scratch.table(verified(best), "sure")
    rest = near.select("set", "other").join(best, ["set", "other"], "left_anti").join(sure, "set", "left_anti")
    found = scratch.table(sure.unionByName(verified(rest)), "matched")
    scratch.drop(pairs, wanted, pulled, near, best, sure)
    return found


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, gone): one row a line of ``docs`` (doc, id, line and more), and (doc, line) of those that an earlier
    line with the same words, or similar to 0.8 or more, makes superfluous. Earlier is by (id, a null id last, a hash
    of the text, line); of rows that agree in all of these all but one lose their lines. Lines without words stay."""
    split = split_lines(docs, id_col, text_col)
    lines = scratch.table(split.drop("content"), "lines")
    # Equal lines are one from here on, however many there are.
    contents = split.groupBy("c1", "c2").agg(F.min(F.struct(*PLACE, "content")).alias("first"), F.count(F.lit(1)).alias("copies"))
    contents = scratch.table(contents.select(F.monotonically_increasing_id().alias("set"), "c1", "c2", "copies", "first.*"), "contents", compact=True)
    sets = scratch.table(line_sets(contents, rarity(contents)), "sets")

    # A word of many lines is met with the earliest lines that have it first. That settles large groups of lines
    # which differ by a word or so, at a cost linear in the group.
    often, rare = (lambda level: level >= FREQUENT), (lambda level: level < FREQUENT)
    frequent = _postings(sets, "a", often, *PLACE)
    in_order = Window.partitionBy("a_token").orderBy(*(f"a_{c}" for c in PLACE), "a_set")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("a_set", "a_at", "a_sig", "a_sig2")
    ranked = frequent.withColumn("a_rank", F.row_number().over(in_order)).withColumns({f"b{k}": F.nth_value(entry, k).over(whole) for k in range(1, HEADS + 1)})
    for k in range(1, HEADS + 1):
        ranked = ranked.withColumns({f"b{k}_{c}": F.col(f"b{k}.a_{c}") for c in ("at", "sig", "sig2")})
    met = F.array(*(F.when((F.col("a_rank") > k) & _fits("a", f"b{k}"), F.col(f"b{k}.a_set")) for k in range(1, HEADS + 1)))
    pairs = ranked.select("a_set", F.explode(F.filter(met, lambda b: b.isNotNull())).alias("b_set")).select(F.col("a_set").alias("x"), F.col("b_set").alias("y")).distinct()
    settled = _matched(pairs, sets, contents)

    # Rarer words are in few lines: all of these meet. For the frequent ones, lines that are still open ask all.
    meet = (F.col("a_token") == F.col("b_token")) & _fits("a", "b")
    pair = [F.least("a_set", "b_set").alias("x"), F.greatest("a_set", "b_set").alias("y")]
    pairs = _postings(sets, "a", rare).join(_postings(sets, "b", rare), meet & (F.col("a_set") < F.col("b_set"))).select(*pair)
    asked = _postings(sets.join(settled, "set", "left_anti"), "a", often, *PLACE)
    earlier = F.struct(*(F.col(f"b_{c}") for c in PLACE)) < F.struct(*(F.col(f"a_{c}") for c in PLACE))
    pairs = pairs.unionByName(asked.join(_postings(sets, "b", often, *PLACE), meet & earlier).select(*pair)).distinct()
    matched = settled.unionByName(_matched(pairs, sets, contents)).distinct()

    # Lines without words are in no set and stay, however often they recur.
    worded = sets.select(F.col("set").alias("s_set")).join(matched.withColumnRenamed("set", "m_set"), F.col("s_set") == F.col("m_set"), "left")
    fates = contents.join(worded, F.col("set") == F.col("s_set")).filter("copies > 1 or m_set is not null")
    fates = fates.select(F.col("c1").alias("f_c1"), F.col("c2").alias("f_c2"), F.struct(*PLACE).alias("f_place"), F.col("m_set").isNotNull().alias("f_matched"))
    fates = scratch.table(fates, "fates")
    scratch.drop(contents, sets, settled)
    heads = lines.filter("line = 0")
    repeated = heads.groupBy(F.col("none").alias("r_none"), F.col("id").alias("r_id"), F.col("version").alias("r_version")).agg(F.min("doc").alias("r_doc"), F.count(F.lit(1)).alias("r_rows")).filter("r_rows > 1")
    again = heads.join(repeated, (F.col("version") == F.col("r_version")) & F.col("id").eqNullSafe(F.col("r_id")) & (F.col("doc") != F.col("r_doc"))).select(F.col("doc").alias("again"))
    lost = lines.join(fates, (F.col("c1") == F.col("f_c1")) & (F.col("c2") == F.col("f_c2"))).join(again, F.col("doc") == F.col("again"), "left")
    lost = lost.filter(F.col("f_matched") | (F.struct(*PLACE) != F.col("f_place")) | F.col("again").isNotNull())
    return lines, lost.select("doc", "line")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed and removed_lines, their numbers from 0, comma-joined.

    A null text is one empty line. Null and repeated ids are rows of their own. An empty table gives no rows. Other
    columns are ignored. Words are told apart as strings where pairs are verified; equal lines are known by
    128 bits of hashes."""
    lines, lost = later_matches(docs, id_col, text_col)
    each = lines.groupBy("doc").agg(F.first("id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"))
    gone = lost.groupBy(F.col("doc").alias("l_doc")).agg(F.array_sort(F.collect_list("line")).alias("gone"))
    gone = each.join(gone, F.col("doc") == F.col("l_doc"), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return gone.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later matching lines, all columns kept as they are; a text that loses every line is empty.

    The rows are numbered, stored and read again, so that texts and lines belong together whatever the ids are. Ties
    are broken as in ``later_matches``; nulls, repeats and an empty table are as in ``report``."""
    row, of, lines = scratch.fresh(docs, "row", "row_of", "lines_gone")
    numbered = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    # Rows keep their order by id: a row number stands behind it only where id and text agree.
    both = numbered.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(row).alias("row")).alias("doc_id"), F.col(text_col).alias("text"))
    gone = report(both, "doc_id", "text").filter("n_removed > 0")
    gone = gone.select(F.col("doc_id.row").alias(of), F.split("removed_lines", ",").cast("array<int>").alias(lines))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, at: ~F.array_contains(F.col(lines), at)), "\n")
    joined = numbered.join(gone, F.col(row) == F.col(of), "left")
    return joined.withColumn(text_col, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that an earlier line makes superfluous."""
    return report(scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(content, '[^\x20\x09-\x0D]+'))) AS s FROM l),
u AS (SELECT s, len(s) AS n, min(row(doc_id, line)) AS pl, row_number() OVER () AS sid FROM w WHERE len(s) > 0 GROUP BY s),
t AS (SELECT sid, n, pl, unnest(s) AS token FROM u),
p AS (SELECT a.sid AS sid, a.n AS n, b.n AS m, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND b.pl < a.pl AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.sid, b.sid, a.n, b.n),
k AS (SELECT DISTINCT sid FROM p WHERE 9 * c >= 4 * (n + m)),
f AS (SELECT w.doc_id, w.line, u.sid IS NOT NULL AND (k.sid IS NOT NULL OR u.pl <> row(w.doc_id, w.line)) AS removed FROM w LEFT JOIN u ON w.s = u.s LEFT JOIN k ON u.sid = k.sid)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (removed), '') AS removed_lines FROM f GROUP BY doc_id
"""
