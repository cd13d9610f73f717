"""Full-text search: postings, BM25, and a boolean query language compiled to joins of postings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.text import words
from tidewrack.operators.working import stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass
class TextIndex:
    """postings: (doc, term, pos); lengths: (doc, len). Any key column(s) packed in ``doc``.

    An index made on the spot also has ``tokens`` (doc, w), and boolean queries are then one filter over it. A stored
    one (``TextIndex(postings, lengths)`` over tables) answers them by joins of the postings that a query names."""

    postings: DataFrame
    lengths: DataFrame
    tokens: DataFrame | None = None

    @classmethod
    def of(cls, texts: DataFrame, key: str = "doc", text: str = "text") -> TextIndex:
        tokens = texts.select(F.col(key).alias("doc"), words(F.col(text)).alias("w"))
        return cls(tokens.select("doc", F.posexplode("w").alias("pos", "term")), tokens.select("doc", F.size("w").alias("len")), tokens)

    def bm25(self, terms: list[str]) -> DataFrame:
        """(doc, score): smaller is better, as sums of negative term scores. Corpus size and mean length are one-row
        aggregates; only postings of the asked terms are counted."""
        asked = list(dict.fromkeys(terms))
        if self.tokens is not None:
            return self._bm25_of_tokens(asked)
        tf = self.postings.filter(F.col("term").isin(asked)).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        corpus = self.lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
        idf = df.join(F.broadcast(corpus)).select("term", "mean", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
        idf = idf.select("term", "mean", F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.lit(LEAST_IDF)).alias("idf"))
        rows = tf.join(F.broadcast(idf), "term").join(self.lengths, "doc")  # as many idf rows as terms were asked for
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        return rows.groupBy("doc").agg((-F.sum(part)).alias("score"))

    def _bm25_of_tokens(self, asked: list[str]) -> DataFrame:
        """The same from whole token lists: texts are taken apart once, to one narrow row each (length and the counts
        of the asked terms), and everything else is an aggregate of these."""
        count = lambda t: F.size(F.filter("w", lambda w: w == t))
        counts = F.array(*map(count, asked)) if asked else F.array().cast("array<int>")
        rows = stored(self.tokens.select("doc", F.size("w").alias("len"), counts.alias("tf")))
        stats = [F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"), *(F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(asked)))]
        scored = rows.filter(F.exists("tf", lambda n: n > 0)).join(F.broadcast(rows.agg(*stats)))  # one row
        score = F.lit(0.0)
        for k in range(len(asked)):
            raw, tf = F.log((F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.col("tf")[k]
            idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
            score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)
        return scored.select("doc", (-score).alias("score"))

    # Each of the following gives the matching documents as a one-column frame (doc).
    def term(self, word: str, prefix: bool = False) -> DataFrame:
        fits = F.col("term").startswith(word) if prefix else F.col("term") == word
        return self.postings.filter(fits).select("doc").distinct()

    def phrase(self, terms: list[str], prefix: bool = False) -> DataFrame:
        """Positions shifted by their place in the phrase meet in one group: a phrase is a count, not a chain of joins."""
        fits = [((F.col("term").startswith(t) if prefix and i == len(terms) - 1 else F.col("term") == t), i) for i, t in enumerate(terms)]
        hits = None
        for condition, i in fits:
            part = self.postings.filter(condition).select("doc", (F.col("pos") - i).alias("start"), F.lit(i).alias("i"))
            hits = part if hits is None else hits.unionByName(part)
        return hits.groupBy("doc", "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(terms)).select("doc").distinct()

    def near(self, terms: list[str], within: int = 10) -> DataFrame:
        """Documents where all terms come within so many tokens of each other: over the ordered hits of a document,
        the last position of every term up to here is compared with this one."""
        order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.postings.filter(F.col("term").isin(terms)).select("doc", "pos", *(F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(order).alias(f"p{i}") for i, t in enumerate(terms)))
        earliest = F.least(*(F.col(f"p{i}") for i in range(len(terms)))) if len(terms) > 1 else F.col("p0")
        present = F.lit(True)
        for i in range(len(terms)):
            present = present & F.col(f"p{i}").isNotNull()
        return rows.filter(present & (F.col("pos") - earliest - len(terms) + 1 <= within)).select("doc").distinct()

    def match(self, query: str) -> DataFrame:
        """Documents that satisfy a boolean query: AND (also by juxtaposition), OR, NOT, NEAR(a b, n), "phrases",
        prefixes with *, parentheses. AND binds closer than OR, NOT closer than AND."""
        if self.tokens is not None:
            return self.tokens.filter(_Parser(_Scan(), query).parse()).select("doc")
        return _Parser(_Postings(self), query).parse()


class _Postings:
    """Queries as frames of matching documents."""

    def __init__(self, index: TextIndex):
        self.term, self.phrase, self.near = index.term, index.phrase, index.near

    def either(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.union(b).distinct()

    def both(self, a: DataFrame, b: DataFrame, negated: bool) -> DataFrame:
        return a.join(b, "doc", "left_anti" if negated else "left_semi")


class _Scan:
    """Queries as predicates on a document's words ``w``: no postings are made and nothing is shuffled."""

    def term(self, word: str, prefix: bool = False) -> Column:
        return F.exists("w", lambda x: F.startswith(x, F.lit(word))) if prefix else F.array_contains("w", word)

    def phrase(self, terms: list[str], prefix: bool = False) -> Column:
        text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
        return F.contains(text, F.lit(" " + " ".join(terms) + ("" if prefix else " ")))

    def near(self, terms: list[str], within: int = 10) -> Column:
        hits = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(terms))
        reach = within + len(terms) - 1
        in_reach = lambda t, h: F.exists(hits, lambda g: (g["x"] == t) & (g["i"] >= h["i"]) & (g["i"] <= h["i"] + reach))
        return F.exists(hits, lambda h: reduce(lambda a, b: a & b, [in_reach(t, h) for t in terms]))

    def either(self, a: Column, b: Column) -> Column:
        return a | b

    def both(self, a: Column, b: Column, negated: bool) -> Column:
        return a & (~b if negated else b)


class BadQuery(ValueError):
    """A query that cannot be parsed."""


TOKEN = re.compile(r'\s*(?:(NEAR)\s*\(\s*([^(),]*?)\s*(?:,\s*(\d+)\s*)?\)|(AND|OR|NOT)\b|([()])|"((?:[^"]|"")*)"(\*)?|([\w]+)(\*)?)', re.UNICODE)


class _Parser:
    def __init__(self, algebra: _Postings | _Scan, query: str):
        self.index, self.tokens, at = algebra, [], 0
        while at < len(query.rstrip()):
            m = TOKEN.match(query, at)
            if not m:
                raise BadQuery(f"near {query[at : at + 20]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def _peek(self) -> re.Match[str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def parse(self) -> Any:
        if not self.tokens:
            raise BadQuery("empty query")
        out = self._or()
        if self._peek():
            raise BadQuery("unbalanced parentheses")
        return out

    def _or(self) -> Any:
        out = self._and()
        while (t := self._peek()) and t[4] == "OR":
            self.at += 1
            out = self.index.either(out, self._and())
        return out

    def _and(self) -> Any:
        out = self._atom()
        while (t := self._peek()) and t[4] != "OR" and t[5] != ")":
            negated = t[4] == "NOT"
            self.at += t[4] in ("AND", "NOT")
            if t[4] == "AND" and (n := self._peek()) and n[4] == "NOT":
                negated, self.at = True, self.at + 1
            out = self.index.both(out, self._atom(), negated)
        return out

    def _atom(self) -> Any:
        t = self._peek()
        if t is None or t[4] or t[5] == ")":
            raise BadQuery("a term is missing")
        self.at += 1
        if t[5] == "(":
            out = self._or()
            if not (c := self._peek()) or c[5] != ")":
                raise BadQuery("unbalanced parentheses")
            self.at += 1
            return out
        if t[1]:
            return self.index.near(_terms(t[2]), int(t[3] or 10))
        if t[6] is not None:
            found = _terms(t[6])
            if not found:
                raise BadQuery("an empty phrase")
            return self.index.phrase(found, bool(t[7])) if len(found) > 1 else self.index.term(found[0], bool(t[7]))
        found = _terms(t[8])
        return self.index.phrase(found, bool(t[9])) if len(found) > 1 else self.index.term(found[0] if found else "", bool(t[9]))


def _terms(text: str) -> list[str]:
    from tidewrack.functions.text import FOLDED, MARKED

    low = text.lower().translate(str.maketrans(MARKED[: len(FOLDED)], FOLDED, MARKED[len(FOLDED) :]))
    return re.findall(r"[^\W_]+", low)


def sanitize(query: str) -> str:
    """A query with the barewords that cannot stand as they are put in quotes; operators, quotes and * stay."""
    out = []
    for piece in re.findall(r'"[^"]*"\*?|[()]|[^\s()"]+', query):
        plain = piece in ("AND", "OR", "NOT", "(", ")") or piece.startswith('"') or re.fullmatch(r"\w+\*?", piece) or piece.startswith("NEAR")
        out.append(piece if plain else '"' + piece.replace('"', '""') + '"')
    return " ".join(out)


def any_of(text: str) -> str:
    """Natural language to a query for any of its words of two letters or more."""
    return " OR ".join(f'"{w}"' for w in dict.fromkeys(re.findall(r"[\w-]+", text.lower())) if len(w) >= 2)


def group_hits(hits: DataFrame, snippets: int = 3) -> DataFrame:
    """(session_id, score, text) -> one row a session: best score, hits, the first snippets by score."""
    w = Window.partitionBy("session_id").orderBy("score", "turn")
    few = hits.withColumn("n", F.row_number().over(w))
    return few.groupBy("session_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("hits"), F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= snippets, F.struct("n", "snippet")))), lambda s: s["snippet"]).alias("snippets"))


def snippet(text: str, terms: list[str], width: int = 16) -> str:
    """The window of ``width`` tokens that holds most of the terms, marked."""
    found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
    if not found:
        return ""
    wanted = set(terms)
    hits = [w in wanted for _, _, w in found]
    first = max(range(max(1, len(found) - width + 1)), key=lambda i: (len({found[j][2] for j in range(i, min(i + width, len(found))) if hits[j]}), sum(hits[i : i + width]), -i))
    last = min(first + width, len(found))
    out, at = ["..." if first else ""], found[first][0]
    for j in range(first, last):
        a, b, _ = found[j]
        out += [text[at:a], f"[{text[a:b]}]" if hits[j] else text[a:b]]
        at = b
    return "".join(out) + ("..." if last < len(found) else "")
