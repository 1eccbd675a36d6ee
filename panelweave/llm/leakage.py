"""Held-out items in a corpus, through a stored positional index of the items' rarest words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.session import broadcast_if_small, stored

#: Consecutive words that make a leak.
RUN = 12
#: Posting lists that are intersected for a run, besides those that may fail for altered words.
LISTS = 2
#: Places by which two words of a passage may be shifted against each other and still be near.
BAND = 2
#: Rows up to which a table of terms or anchors is broadcast (some tens of MB); beyond, the same joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters of items up to which their words are broadcast.
BROADCAST_CHARS = 10_000_000


def _raw(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9A-Za-z]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits in lower case. Only ASCII is matched before letters are lowered, so no other letter is folded into it."""
    return F.transform(_raw(text), F.lower)


def _tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos, term): one row a word, named by the hash of its lower case. Exploded first, so that hashing is compiled."""
    return docs.select(*keep, F.posexplode(_raw(F.col("text"))).alias("pos", "w")).select(*keep, "pos", F.xxhash64(F.lower("w")).alias("term"))


def corpus_counts(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(term, n): how often each term of the vocabulary stands in the corpus. Added up on the map side either way; small: the vocabulary may be broadcast."""
    tokens = _tokens(docs).select("term")
    if small:
        tokens = tokens.join(F.broadcast(vocabulary), "term", "left_semi")
        return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "term", "left_semi")


def anchors(item_words: DataFrame, counts: DataFrame, run: int, altered: int) -> DataFrame:
    """(item, item_pos, term): of each run of item words the rarest that the corpus has, so many that LISTS stay when `altered` are missing.

    Words that the corpus lacks are among the missing; a run with more of them than that cannot be met.
    """
    n = F.coalesce("n", F.lit(0))
    frame = W.partitionBy("item").orderBy("item_pos").rowsBetween(0, run - 1)
    runs = item_words.join(counts, "term", "left").select("item", F.collect_list(F.struct(n.alias("n"), "item_pos", "term")).over(frame).alias("r")).where(F.size("r") == run)
    runs = runs.withColumn("there", F.array_sort(F.filter("r", lambda x: x["n"] > 0))).withColumn("lacking", run - F.size("there")).where(F.col("lacking") <= altered)
    return runs.select("item", F.explode(F.slice("there", F.lit(1), altered + LISTS - F.col("lacking"))).alias("a")).select("item", "a.item_pos", "a.term").distinct()


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos): the postings of the terms, stored in order of terms in each file. No text is shuffled while the terms may be broadcast."""
    tokens = _tokens(docs, "doc_id")
    return stored(tokens.join(terms, "term", "left_semi").select("term", "doc_id", "pos"), "term", "doc_id", "pos")


def intersect(index: DataFrame, anchored: DataFrame, run: int, band: int) -> DataFrame:
    """(doc_id, item, cell): where at least LISTS posting lists of one run meet once their offsets are taken off.

    The offset of a hit is its place in the document less that in the item. With band 1 a cell is one offset; else cell c
    takes the offsets from c * band to (c + 2) * band - 1, so that offsets up to `band` apart share a cell.
    """
    hits = index.join(anchored, "term")
    cell = F.floor((F.col("pos") - F.col("item_pos")) / F.lit(band)).cast("int")
    cells = F.array(cell) if band == 1 else F.array(cell, cell - 1)
    hits = hits.select("doc_id", "item", "item_pos", F.explode(cells).alias("cell"))
    # a group has at most the words of one item
    met = hits.groupBy("doc_id", "item", "cell").agg(F.array_sort(F.collect_set("item_pos")).alias("at")).where(F.size("at") >= LISTS)
    near = F.exists(F.sequence(F.lit(LISTS - 1), F.size("at") - 1), lambda k: F.get("at", k) - F.get("at", k - (LISTS - 1)) < run)
    return met.where(near).select("doc_id", "item", "cell")


def leaked_passages(docs: DataFrame, items: DataFrame, run: int = RUN, altered: int = 3, band: int = BAND) -> DataFrame:
    """(doc_id, item_id, kind, doc_pos, item_pos, run_words, shared_words): every document with wording of an item, one row a pair.

    docs (doc_id, text), items (item_id, text). kind 'phrase': `run` or more consecutive words of the item stand in the
    document in the same order with no other word between; run_words is the longest such run and doc_pos, item_pos its first
    place (from 0). kind 'proximity' (unless altered is 0): no phrase, but of some `run` consecutive words of the item all
    except `altered` stand in the document within one cell of offsets (see intersect), so words may be replaced, left out or
    put in; item_pos is the first of them, doc_pos where the cell begins there, run_words 0. shared_words is
    the greatest number of item words in one cell.

    Method: the item words are counted in the corpus; each run of item words is filed under its rarest words; the postings
    of these words are stored as a positional index; posting and item lists are intersected with their offsets taken off, which
    by the pigeonhole principle misses no match; the candidates are compared word by word. The corpus is read three times,
    whatever the number of items; items are tables throughout, and nothing but row counts reaches the driver.

    Defined cases: null ids, null and short texts match nothing; an item with under `run` words can't leak; repeated
    documents or items count once, several texts under one id match if one of them does; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    own = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    own = stored(own.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("item_words")).where(F.size("item_words") >= run))
    item_words = own.select("item", F.posexplode(F.transform("item_words", lambda w: F.xxhash64(w))).alias("item_pos", "term"))
    # sizes are known before anything is broadcast: words of all items, then anchors, then documents with a candidate
    n_words, chars = own.agg(F.sum(F.size("item_words")), F.sum(F.aggregate("item_words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)))).first()
    counts = corpus_counts(docs, item_words.select("term").distinct(), (n_words or 0) <= BROADCAST_ROWS)
    anchored = stored(anchors(item_words, counts, run, altered))
    hint = F.broadcast if anchored.count() <= BROADCAST_ROWS else (lambda df: df)
    band = band if altered else 1
    index = positional_index(docs, hint(anchored.select("term").distinct()))
    met = stored(intersect(index, hint(anchored), run, band))
    texts = docs.join(broadcast_if_small(met.select("doc_id").distinct(), BROADCAST_ROWS), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("doc_words"))
    both = met.join(F.broadcast(own) if (chars or 0) <= BROADCAST_CHARS else own, "item").join(texts, "doc_id")
    return _compared(both, run, altered, band)


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with value computed once: inside a lambda a plain expression is evaluated again at every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _compared(both: DataFrame, run: int, altered: int, band: int) -> DataFrame:
    """The exact check: words of document and item at the offsets of each cell."""
    n = F.size("item_words")
    places = F.sequence(F.lit(0), n - 1)
    stands = lambda i, offset: F.get("doc_words", i + offset) == F.get("item_words", i)  # noqa: E731  null beyond the document

    def longest(offset: Column) -> Column:
        breaks = F.concat(F.array(F.lit(-1)), F.filter(places, lambda i: ~F.coalesce(stands(i, offset), F.lit(False))), F.array(n))
        run_at = lambda b, k: F.struct((F.get(b, k) - F.get(b, k - 1) - 1).alias("run_words"), (-offset - F.get(b, k - 1) - 1).alias("doc"), (-F.get(b, k - 1) - 1).alias("item"))
        return _let(breaks, lambda b: F.array_max(F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda k: run_at(b, k))))  # of equal ones the first in the document

    reach = 2 * band if altered else 1
    near_by = F.sequence(F.col("cell") * band, F.col("cell") * band + reach - 1)
    need = run - altered
    window = lambda m: F.get(F.filter(F.sequence(F.lit(0), F.size(m) - need), lambda k: F.get(m, k + need - 1) - F.get(m, k) < run), F.lit(0))
    near = lambda m, k: F.when(k.isNotNull(), F.struct(F.size(m).alias("shared_words"), (-F.greatest(F.get(m, k) + F.col("cell") * band, F.lit(0))).alias("doc"), (-F.get(m, k)).alias("item")))
    in_cell = F.filter(places, lambda i: F.exists(near_by, lambda o: stands(i, o)))
    both = both.withColumn("near", _let(in_cell, lambda m: F.when(F.size(m) >= need, _let(window(m), lambda k: near(m, k))))).where("near is not null")
    # a phrase has all its words in one cell, so it is looked for where a window was met
    best = F.array_max(F.transform(F.sequence(F.col("cell") * band, F.col("cell") * band + band - 1), longest))
    both = both.select("doc_id", "item_id", "near", best.alias("best"))
    pairs = both.groupBy("doc_id", "item_id").agg(F.max(F.when(F.col("best.run_words") >= run, F.col("best"))).alias("p"), F.max("near").alias("near"))
    at = lambda c: -F.coalesce(F.col(f"p.{c}"), F.col(f"near.{c}"))
    kind = F.when(F.col("p").isNotNull(), "phrase").otherwise("proximity")
    return pairs.select("doc_id", "item_id", kind.alias("kind"), at("doc").alias("doc_pos"), at("item").alias("item_pos"), F.coalesce("p.run_words", F.lit(0)).alias("run_words"), F.col("near.shared_words").alias("shared_words"))
