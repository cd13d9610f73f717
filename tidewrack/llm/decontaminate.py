"""Benchmark decontamination by a distributed positional inverted index. Built-in functions only.

The index holds one posting (term, document, position) for each training token that any test item uses. A test window
can be met, as a phrase or with its words in any order near each other, only where its rarest term is: those postings
are its anchors. Anchors stay that have the window's second rarest term nearby; what lies around the ones that are
left is laid out once, however many windows meet there, and compared with them word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm import scratch

WINDOW = 13
#: Words that may lie among those of a window for a proximity match.
SLOP = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: So many document numbers, 8 bytes each, may be broadcast to thin out the postings.
FEW = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null. Plain ASCII takes the quick way to lower case."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """``items``: (item, q, term, n) of every test word, item being a number of its row; ``names``: (item, item_id);
    ``postings``: (doc, pos, term) of training tokens; ``docs``: (doc, doc_id, text_hash, n_words); ``rarity``: (term, df)."""

    items: DataFrame
    names: DataFrame
    postings: DataFrame
    docs: DataFrame
    rarity: DataFrame


def build(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Number the rows of both tables and store the postings. One pass over the texts.

    Each document ends in an empty token, which no word equals: its posting has term -1 and the number of words as
    position, and so stands for the document itself. Rows, not ids, are numbered: null and repeated ids are no matter.
    """
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    numbered = scratch.table(numbered.filter(F.size("w") > 0), "items")
    flat = numbered.select("item", F.size("w").alias("n"), F.posexplode("w").alias("q", "token"))
    vocabulary = flat.select("token").distinct().withColumn("term", F.monotonically_increasing_id())
    spark = docs.sparkSession
    vocabulary = scratch.table(vocabulary.unionByName(spark.range(1).select(F.lit("").alias("token"), F.lit(-1).cast("long").alias("term"))), "terms")
    items = scratch.table(flat.join(vocabulary, "token").select("item", "q", "n", "term"), "item_terms")
    tokens = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.array_append(words(F.col(text_col)), F.lit("")).alias("w"))
    tokens = tokens.select("doc", "doc_id", "text_hash", F.posexplode("w").alias("pos", "token"))
    ends = F.col("token") == ""
    stored = tokens.join(vocabulary, "token").select("term", "doc", "pos", F.when(ends, F.col("doc_id")).alias("doc_id"), F.when(ends, F.col("text_hash")).alias("text_hash"))
    stored = scratch.table(stored, "postings")
    postings = stored.filter("term >= 0").select("term", "doc", "pos")
    heads = stored.filter("term = -1").select("doc", "doc_id", "text_hash", F.col("pos").alias("n_words"))
    rarity = scratch.table(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "rarity")
    return Index(items, numbered.select("item", "item_id"), postings, heads, rarity)


def _windows(index: Index, window: int) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): each distinct sequence of ``window`` words of an item (all words, of a shorter one) with its
    number, terms, the rarest of them and its place, and the second rarest; and (wid, item). Only windows whose words
    all occur are there. Item words are given to the starts whose window holds them, ``window`` at most."""
    known = index.items.join(index.rarity, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    width = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - width + 1), F.least(F.col("q"), F.col("n") - width))
    each = known.select("item", F.explode(starts).alias("at"), F.col("q"), "term", "df")
    spelled = each.groupBy("item", "at").agg(F.array_sort(F.collect_list(F.struct("q", "term", "df"))).alias("ws")).filter(F.array_min("ws.df") > 0)
    spelled = spelled.select("item", F.col("ws.term").alias("terms"), F.array_sort(F.transform("ws", lambda w, at: F.struct(w["df"].alias("df"), at.alias("at"), w["term"].alias("term")))).alias("rare"))
    other = F.filter("rare", lambda w: w["term"] != F.col("rare")[0]["term"])
    distinct = spelled.groupBy("terms").agg(F.first("rare").alias("rare"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("wid"), "terms", F.col("rare")[0]["term"].alias("anchor_term"), F.col("rare")[0]["at"].alias("offset"), F.get(other, F.lit(0))["term"].alias("second"))
    distinct = scratch.table(distinct, "windows")
    owners = spelled.select("item", "terms").distinct().join(distinct.select("wid", "terms"), "terms").select("wid", "item")
    return distinct, scratch.table(owners, "owners")


def matches(index: Index, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(found, owners): found has one row for each stretch of a document around anchors: doc, from, phrases (start,
    words, wid) by start and near (wid). A phrase is a window's words in a row; a window is near where all its terms
    lie within its own length and ``slop`` words, in any order. owners is (wid, item).

    Both grow with the words of documents that anchors touch: a word that is repeated a thousand times in both a
    document and an item is one window with a thousand anchors, not a million pairs."""
    windows, owners = _windows(index, window)
    span = window + slop
    block = lambda pos: F.floor(pos / span)
    anchors = index.postings.join(windows, F.col("term") == F.col("anchor_term")).select("doc", F.col("pos").alias("anchor"), "wid", "second")
    # Blocks of one span make "nearby" an equality: within a span of an anchor is its own block or one beside it.
    there = index.postings.join(windows.select(F.col("second").alias("term")).distinct(), "term", "left_semi").select(F.col("term").alias("second"), "doc", block(F.col("pos")).alias("block")).distinct()
    asked = anchors.filter("second is not null").withColumn("block", F.explode(F.array(*(block(F.col("anchor")) + k for k in (-1, 0, 1)))))
    left = asked.join(there, ["second", "doc", "block"], "left_semi").select("doc", "anchor", "wid").distinct()
    left = scratch.table(left.unionByName(anchors.filter("second is null").select("doc", "anchor", "wid")), "anchors")
    wide = left.join(windows, "wid").select("doc", F.greatest(F.lit(0), F.col("anchor") - span + 1).alias("a"), (F.col("anchor") + span).alias("b"), F.struct((F.col("anchor") - F.col("offset")).alias("start"), "anchor", "wid", "terms").alias("c"))
    in_order = Window.partitionBy("doc").orderBy("a")
    fresh = F.col("a") > F.coalesce(F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    stretches = wide.withColumn("s", F.sum(fresh.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stretches = stretches.groupBy("doc", "s").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_list("c").alias("cs"))
    stretches = scratch.table(stretches, "stretches")
    some, near = index.postings, scratch.table(stretches.select("doc").distinct(), "near")
    if near.count() <= FEW:  # else one shuffle of all postings is cheaper than this and another
        some = some.join(F.broadcast(near), "doc", "left_semi")
    places = stretches.select("doc", "s", F.explode(F.sequence("a", F.col("b") - 1)).alias("pos"))
    words = places.join(some, ["doc", "pos"], "left").groupBy("doc", "s").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("term", F.lit(-2)).alias("term")))).alias("words"))
    laid = stretches.join(words.select(F.col("doc").alias("w_doc"), F.col("s").alias("w_s"), F.col("words.term").alias("words")), (F.col("doc") == F.col("w_doc")) & (F.col("s") == F.col("w_s")))

    def part(start: Column, n: Column | int) -> Column:
        return F.slice("words", (start - F.col("a") + 1).cast("int"), n)

    def is_phrase(c: Column) -> Column:
        return (c["start"] >= F.col("a")) & (part(F.greatest(c["start"], F.col("a")), F.size(c["terms"])) == c["terms"])

    def is_near(c: Column) -> Column:
        first = F.greatest(c["anchor"] - (F.size(c["terms"]) + slop) + 1, F.col("a"))
        around = part(first, 2 * (F.size(c["terms"]) + slop) - 1)
        lacking = lambda words: F.size(F.array_except(c["terms"], words)) == 0
        return lacking(around) & F.exists(F.sequence(first, c["anchor"]), lambda at: lacking(part(at, F.size(c["terms"]) + slop)))

    phrases = F.array_sort(F.transform(F.filter("cs", is_phrase), lambda c: F.struct(c["start"].alias("start"), F.size(c["terms"]).alias("words"), c["wid"].alias("wid"))))
    near = F.array_distinct(F.transform(F.filter("cs", is_near), lambda c: c["wid"]))
    return scratch.table(laid.select("doc", F.col("a").alias("from"), phrases.alias("phrases"), near.alias("near")), "found"), owners


def phrase_matches(index: Index, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(item_id, doc_id, start, words): every place where one of an item's windows stands word by word."""
    found, owners = matches(index, window, slop)
    return found.select("doc", F.inline("phrases")).join(owners, "wid").join(index.names, "item").join(index.docs, "doc").select("item_id", "doc_id", "start", "words").distinct()


def proximity_matches(index: Index, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """(item_id, doc_id): all distinct words of one of the item's windows lie within its length and ``slop`` words of
    the document, in any order."""
    found, owners = matches(index, window, slop)
    return found.select("doc", F.explode("near").alias("wid")).distinct().join(owners, "wid").join(index.names, "item").join(index.docs, "doc").select("item_id", "doc_id").distinct()


def _judged(index: Index, window: int, share: int, slop: int) -> DataFrame:
    """One row a document number: n_hit, ids, n_near and contaminated beside what ``index.docs`` has."""
    found, owners = matches(index, window, slop)
    owners = owners.join(index.names, "item").groupBy("wid").agg(F.collect_set("item_id").alias("ids"))
    # Stretches of a document do not overlap, so its hit words are the sum of theirs: of each phrase in order, what
    # lies beyond the ones before it.
    reach = lambda seen, p: F.struct(F.greatest(seen["end"], p["start"] + p["words"]).alias("end"), (seen["n"] + F.greatest(F.lit(0).cast("long"), p["start"] + p["words"] - F.greatest(seen["end"], p["start"]))).alias("n"))
    hit = F.aggregate("phrases", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), reach, lambda seen: seen["n"])
    hits = found.groupBy(F.col("doc").alias("h_doc")).agg(F.sum(hit).alias("n_hit"))
    met = found.select("doc", F.explode(F.array_distinct("phrases.wid")).alias("wid"), F.lit(True).alias("exact")).unionByName(found.select("doc", F.explode("near").alias("wid"), F.lit(False).alias("exact"))).distinct()
    met = met.join(owners, "wid").groupBy(F.col("doc").alias("m_doc")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("exact"), F.col("ids")))))).alias("ids"), F.size(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("exact"), F.col("ids")))))).alias("n_near"))
    judged = index.docs.join(hits, F.col("doc") == F.col("h_doc"), "left").join(met, F.col("doc") == F.col("m_doc"), "left")
    judged = judged.withColumns({"ids": F.coalesce("ids", F.array().cast("array<string>")), "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "n_near": F.coalesce("n_near", F.lit(0)).cast("long")})
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, slop: int = SLOP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside occurrences), n_items, items_sha256,
    contaminated (some hit and ``share`` * n_hit >= n_words) and n_near (items with a proximity match).

    Null and wordless texts have no words and no hits. Items without words have no windows; an item of a null id is
    hit but neither counted nor listed; rows of one item id are one item. Empty tables are defined as well.
    """
    judged = _judged(build(docs, benchmark), window, share, slop)
    return judged.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), "contaminated", "n_near",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated rows. All columns are kept as they are, whatever else they are called; null
    texts stay, equal rows share their fate, and an empty table stays so."""
    found = _judged(build(docs, benchmark), window, share, SLOP).filter("contaminated")
    id_name, hash_name = scratch.fresh(docs, "x_id", "x_hash")
    found = scratch.table(found.select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found[id_name]) & (F.xxhash64(docs["text"]) == found[hash_name]), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 13 words."""
    return report(scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id,
             coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), {WINDOW}) AS k, w, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS g FROM iw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc, k, w, unnest(range(len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k),
dg AS (SELECT doc, k, s, array_to_string(w[s + 1 : s + k], ' ') AS g FROM dw),
occ AS (SELECT DISTINCT doc, item_id, dg.k, s FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
pos AS (SELECT DISTINCT doc, unnest(range(s, s + k)) AS p FROM occ),
h AS (SELECT doc, count(*) AS n_hit FROM pos GROUP BY doc),
ws AS (SELECT row_number() OVER () AS wid, k, g, ts, len(ts) AS d FROM (SELECT DISTINCT k, g, list_distinct(string_split(g, ' ')) AS ts FROM win)),
wt AS (SELECT wid, k, d, unnest(ts) AS t FROM ws),
dt AS (SELECT doc, t, p FROM (SELECT doc, unnest(w) AS t, unnest(range(len(w))) AS p FROM d) WHERE t IN (SELECT t FROM wt)),
pr AS (SELECT wid, doc FROM (SELECT DISTINCT doc, t FROM dt) JOIN wt USING (t) GROUP BY wid, doc, d HAVING count(*) = d),
tp AS (SELECT wid, doc, k, d, t, p FROM pr JOIN wt USING (wid) JOIN dt USING (doc, t)),
nw AS (SELECT DISTINCT wid, doc FROM (SELECT a.wid, a.doc, a.p FROM tp a JOIN tp b ON a.wid = b.wid AND a.doc = b.doc AND b.p >= a.p AND b.p < a.p + a.k + {SLOP} GROUP BY a.wid, a.doc, a.p, a.d HAVING count(DISTINCT b.t) = a.d)),
nr AS (SELECT doc, count(DISTINCT item_id::VARCHAR) AS n_near FROM nw JOIN ws USING (wid) JOIN win USING (k, g) GROUP BY doc),
it AS (SELECT doc, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc, item_id::VARCHAR AS id FROM occ) GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc) LEFT JOIN it USING (doc) LEFT JOIN nr USING (doc)
"""
