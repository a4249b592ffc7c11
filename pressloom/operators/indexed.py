"""Search served from a stored index: postings in term buckets, and blocks of documents that cannot reach the top are left out.

The index is four Parquet tables below one folder. ``postings`` has a row for a field, a
word (its 64-bit hash) and a document, with count and length; it is partitioned by the
buckets of word and document and sorted by word and block of documents, so files skip
what a query does not ask for. ``heads`` has, for frequent words, the largest count and
smallest length of each block. ``documents`` has one row a document with what filters and
pages need, ``sizes`` the number and words of the documents of each bucket. A query reads the
buckets of its words alone. The heads bound what a document can score: the most promising blocks are
scored first, and blocks that cannot reach the score of the last hit wanted are not read.

Changed documents rewrite the tables' buckets of those documents only, by dynamic
partition overwrite. One writer at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.operators.search import K1, B, _let, run_lengths, terms
from pressloom.session import checkpointed

#: Blocks that are scored first, before the others are measured against their hits.
FIRST = 8
#: Documents of a bucket that make a word frequent, so that its blocks have stored heads; those of others are made from their few postings.
FREQUENT = 256
#: Blocks that are asked for by number; more are met by a join.
ASKED = 1000
#: Scores are rounded to so many digits; bounds are taken that much larger.
DIGITS = 6
#: Postings, roughly, that one task sorts and writes, and characters of text that make one; they affect the cost only.
TASK, CHARS = 1 << 20, 8
#: Partitions that a shuffle deals out without sorting; with more, tasks that take texts apart sort and spill all their words.
UNSORTED = 200
#: Classes of lengths, powers of two.
CLASSES = 32


def word_hash(word: Column) -> Column:
    return F.xxhash64(word)


def term_counts(text: Column) -> Column:
    """The distinct words of a text, as hashes, with their counts, and its number of words."""
    return _let(F.transform(terms(text), word_hash), lambda w: F.struct(run_lengths(w, "term", "bigint").alias("words"), F.size(w).alias("len")))


@dataclass(frozen=True)
class Index:
    """The index below ``folder`` of documents(id, ...): ``fields`` are searched, ``shown`` columns are kept. All stay the same for its whole life."""

    spark: SparkSession
    folder: str
    fields: tuple[str, ...] = ("content",)
    shown: tuple[str, ...] = ()
    #: Buckets of words and of documents, and blocks of one bucket's documents of similar length.
    term_buckets: int = 8
    doc_buckets: int = 4
    blocks: int = 2

    def _term_bucket(self, term: Column) -> Column:
        return F.pmod(term, F.lit(self.term_buckets)).cast("int")

    def _doc_bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.doc_buckets)).cast("int")

    def _block(self) -> Column:
        """Documents of a block have similar lengths, so its bound is near their scores."""
        spread = F.pmod(F.shiftright(F.xxhash64("id"), 20), F.lit(self.blocks))
        return ((F.col("doc_bucket") * CLASSES + F.floor(F.log2(F.col("len") + 1))) * self.blocks + spread).cast("int")

    def table(self, name: str) -> DataFrame:
        """postings, heads, documents or sizes."""
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _put(self, rows: DataFrame, name: str, by: list[str]) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _words(self, documents: DataFrame) -> DataFrame:
        counted = F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("field"), term_counts(F.col(f)).alias("text")) for k, f in enumerate(self.fields)))).alias("f")
        words = documents.select("id", self._doc_bucket(F.col("id")).alias("doc_bucket"), counted).select("id", "doc_bucket", "f.field", F.col("f.text.len").alias("len"), F.explode("f.text.words").alias("w"))
        return words.select("id", "doc_bucket", "field", "len", "w.term", "w.tf").withColumns({"term_bucket": self._term_bucket(F.col("term")), "block": self._block()})

    def _documents(self, documents: DataFrame) -> DataFrame:
        lens = F.array(*(F.size(terms(F.col(f))) for f in self.fields))
        return documents.select("id", *self.shown, lens.alias("lens"), self._doc_bucket(F.col("id")).alias("doc_bucket"))

    def _size(self, documents: DataFrame) -> int:
        """About how many postings the texts of ``documents`` make."""
        return (documents.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in self.fields), F.lit(0)).cast("long"))).first()[0] or 0) // CHARS

    def _store(self, words: DataFrame, documents: DataFrame, places: DataFrame, size: int) -> None:
        """Writes whole buckets, ``places``(term_bucket, doc_bucket): a row of nulls holds the place of each, so that one of which nothing is left is overwritten too."""
        both = ["term_bucket", "doc_bucket"]
        keep = lambda rows, by: rows.unionByName(places.select(*by).distinct(), allowMissingColumns=True)
        order = ["field", "term", "block"]
        # buckets are cut into parts by other digits of the hashes, so tasks that sort them grow in number until UNSORTED, and none holds a whole bucket
        parts = 1 << max(0, math.ceil(math.log2(max(1, size) / (TASK * self.term_buckets * self.doc_buckets))))
        tasks, part = min(UNSORTED, 2 * parts * self.term_buckets * self.doc_buckets), lambda h: F.pmod(F.shiftright(h, 40), F.lit(parts))
        cut = [*both, "part"]
        # one shuffle and one sort: the windows keep to the partitions and the order that are written
        dealt = keep(words.select(*both, *order, "id", "tf", "len"), both).withColumn("part", part(F.col("term"))).repartition(tasks, *cut).sortWithinPartitions(*cut, *order, "id")
        of_block, of_word = Window.partitionBy(*cut, *order), Window.partitionBy(*cut, "field", "term")
        facts = {"n": F.count("id").over(of_block), "max_tf": F.max("tf").over(of_block), "min_len": F.min("len").over(of_block), "first": F.row_number().over(of_block.orderBy("id")) == 1, "in_bucket": F.count("id").over(of_word)}
        self._put(dealt.withColumns(facts).drop("part"), "postings", both)
        heads = self.table("postings").join(F.broadcast(places.select("doc_bucket").distinct()), "doc_bucket", "left_semi")  # at most doc_buckets rows
        heads = heads.where(F.col("first") & (F.col("in_bucket") >= FREQUENT)).select(*both, *order, "n", "max_tf", "min_len")
        self._put(keep(heads, both), "heads", both)
        self._put(keep(documents, ["doc_bucket"]).repartition(min(UNSORTED, 2 * parts * self.doc_buckets), "doc_bucket", part(F.xxhash64("id"))), "documents", ["doc_bucket"])
        sizes = [F.struct(F.lit(k).alias("field"), F.count("id").alias("n"), F.coalesce(F.sum(F.col("lens")[k]), F.lit(0)).alias("words")) for k in range(len(self.fields))]
        sized = keep(documents, ["doc_bucket"]).groupBy("doc_bucket").agg(F.array(*sizes).alias("s")).select("doc_bucket", F.inline("s"))
        self._put(sized.repartition("doc_bucket"), "sizes", ["doc_bucket"])

    def write(self, documents: DataFrame) -> None:
        """A new index of ``documents``, one row an id; null texts have no words, a row without an id is left out."""
        some = documents.where("id is not null")
        self._store(self._words(some), self._documents(some), self._places(list(range(self.doc_buckets))), self._size(some))

    def _places(self, doc_buckets: list[int]) -> DataFrame:
        return self.spark.range(self.term_buckets).select(F.col("id").cast("int").alias("term_bucket"), F.explode(F.array(*map(F.lit, doc_buckets))).alias("doc_bucket"))

    def upsert(self, changed: DataFrame) -> int:
        """Puts ``changed``, one row an id, in place of the documents of the same ids; how many buckets of documents were rewritten.

        The words of the other documents are not taken from their texts again. Run twice, it leaves the same index.
        """
        # an id's bucket depends on its type
        changed = changed.withColumn("id", F.col("id").cast(self.table("documents").schema["id"].dataType))
        changed = checkpointed(changed.where("id is not null").select("id", *dict.fromkeys((*self.shown, *self.fields))))
        touched = sorted(r[0] for r in changed.select(self._doc_bucket(F.col("id"))).distinct().collect())  # at most doc_buckets numbers, the scans' partition filter
        if not touched:
            return 0
        here = F.col("doc_bucket").isin(touched) & F.col("id").isNotNull()
        fresh, ids = self._words(changed), changed.select("id")
        held = self.table("postings").where(here)
        words = held.select(*fresh.columns).join(ids, "id", "left_anti").select(*fresh.columns).unionByName(fresh)
        documents = self.table("documents").where(here).join(ids, "id", "left_anti").unionByName(self._documents(changed))
        self._store(words, checkpointed(documents), self._places(touched), held.count() + self._size(changed))
        return len(touched)

    # queries

    def _asked(self, name: str, words: list[str], field: str) -> DataFrame:
        """The rows of postings or heads of a query's words, with each word: only their buckets are read."""
        hashes = [word_hash(F.lit(w)) for w in words]
        buckets = F.col("term_bucket").isin(*(self._term_bucket(h) for h in hashes))
        return self.table(name).where(buckets & F.col("term").isin(*hashes) & (F.col("field") == self.fields.index(field)))

    def _heads(self, words: list[str], field: str) -> DataFrame:
        """(term, doc_bucket, block, n, max_tf, min_len) of every block that holds a word of the query."""
        columns = ["term", "doc_bucket", "block", "n", "max_tf", "min_len"]
        # a word that is rare in a bucket has fewer than FREQUENT postings there
        rare = self._asked("postings", words, field).where((F.col("in_bucket") < FREQUENT) & F.col("first"))
        return self._asked("heads", words, field).select(*columns).unionByName(rare.select(*columns))

    def _bm25(self, words: list[str], field: str, heads: DataFrame):
        """The score of one word in a document, from the statistics of the whole index."""
        n, total = self.table("sizes").where(F.col("field") == self.fields.index(field)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        counted = heads.groupBy("term").agg(F.sum("n").alias("df"))
        word = F.coalesce(*(F.when(F.col("term") == word_hash(F.lit(w)), F.lit(w)) for w in words))
        df = {r.word: r.df for r in counted.select(word.alias("word"), "df").collect()}  # a row a word of the query
        mean = total / n if total else 1.0
        idf = {w: math.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in words}
        weight = F.coalesce(*(F.when(F.col("term") == word_hash(F.lit(w)), F.lit(x)) for w, x in idf.items()))
        return lambda tf, length: weight * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / mean))

    def _scored(self, words: list[str], field: str, score, blocks: DataFrame | None) -> DataFrame:
        """(id, doc_bucket, score) of the documents of some ``blocks``, or of all."""
        rows = self._asked("postings", words, field)
        if blocks is not None:
            some = [tuple(r) for r in blocks.select("doc_bucket", "block").limit(ASKED + 1).collect()]
            if len(some) <= ASKED:
                rows = rows.where(F.col("doc_bucket").isin(sorted({b for b, _ in some})) & F.col("block").isin([b for _, b in some]))
            else:
                rows = rows.join(blocks.select("block"), "block", "left_semi")
        return rows.groupBy("id", "doc_bucket").agg(F.round(F.sum(score("tf", "len")), DIGITS).alias("score"))

    def _met(self, hits: DataFrame, equal: dict[str, str | None]) -> DataFrame:
        """Hits with what the index shows of them, those that the filters leave."""
        documents = self.table("documents")
        for column, value in equal.items():
            if value is not None:
                documents = documents.where(F.col(column) == value)
        return hits.join(documents.drop("lens"), ["id", "doc_bucket"]).drop("doc_bucket")

    def _blocks(self, query: str, limit: int, field: str, equal: dict) -> tuple[list[str], object, DataFrame, float | None]:
        words = sorted(set(query.lower().split())) or [""]
        heads = self._heads(words, field)
        score = self._bm25(words, field, heads)
        bounds = checkpointed(heads.groupBy("doc_bucket", "block").agg((F.sum(score("max_tf", "min_len")) + 10.0**-DIGITS).alias("bound")))
        first = checkpointed(bounds.orderBy(F.desc("bound"), "doc_bucket", "block").limit(FIRST))
        best = self._met(self._scored(words, field, score, first), equal).select("score").orderBy(F.desc("score")).limit(limit).agg(F.count("*"), F.min("score")).first()
        return words, score, bounds, best[1] if best[0] == limit else None

    def considered(self, query: str, limit: int, field: str = "content", **equal: str | None) -> tuple[int, int]:
        """(blocks that a search takes apart, all blocks that hold a word of it)."""
        _, _, bounds, least = self._blocks(query, limit, field, equal)
        return bounds.where(F.lit(True) if least is None else F.col("bound") >= least).count(), bounds.count()

    def search(self, query: str, limit: int, field: str = "content", **equal: str | None) -> DataFrame:
        """(id, score, shown columns), the best ``limit``: BM25, then the newest, then the id; exactly what a scan of all texts finds.

        ``equal`` are filters on shown columns, which must all hold; they leave hits out, not
        documents of the statistics. Null asks nothing. ``published_at`` must be shown.
        """
        words, score, bounds, least = self._blocks(query, limit, field, equal)
        hits = self._scored(words, field, score, bounds if least is None else bounds.where(F.col("bound") >= least))
        found = self._met(hits if least is None else hits.where(F.col("score") >= least), equal)
        return found.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "id").limit(limit)

    def matches(self, query: str, field: str = "content", **equal: str | None) -> DataFrame:
        """(id, score, shown columns) of every document that holds a word of the query."""
        words = sorted(set(query.lower().split())) or [""]
        return self._met(self._scored(words, field, self._bm25(words, field, self._heads(words, field)), None), equal)
