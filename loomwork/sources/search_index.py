"""A stored positional index of the texts that a search looks into.

Two tables grow by generations, so a reader never sees half an update: postings (generation, token, property, text_id,
course_id, positions), written in ranges of tokens so that a query's few tokens prune files and row groups, and texts
(generation, property, text_id and what a match shows). A later generation of a text replaces the earlier ones; one
without tokens removes it. Queries on postings read no text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import english
from loomwork.operators.search import FOUND, Request

#: A text of the index.
TEXT = ["property", "text_id"]


class SearchIndex:
    """The index at a folder that all executors share; stemmed says whether its tokens are stems."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = False):
        self.spark, self.path, self.stemmed = spark, path.rstrip("/"), stemmed

    def add(self, vectors: DataFrame, generation: int) -> None:
        """Stores texts, as search.vectors() makes them, as a generation; of texts that earlier ones hold it takes the place.

        A generation that is added again is overwritten. A text with null matched_text is removed from the index.
        """
        rows = vectors.select(*TEXT, "course_id", F.posexplode("tokens").alias("position", "token")).where("token <> ''")
        ranges = rows.repartitionByRange("token", *TEXT)  # the lists are made within these ranges: one shuffle
        postings = ranges.groupBy("token", *TEXT, "course_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))
        postings.sortWithinPartitions("token", *TEXT).write.mode("overwrite").parquet(f"{self.path}/postings/generation={generation}")
        vectors.select("property", "text_id", *[c for c in FOUND if c != "property"]).write.mode("overwrite").parquet(f"{self.path}/texts/generation={generation}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of texts that no later generation has. Only what was replaced is looked up, by ids alone."""
        ids = self._read("texts").select(*TEXT, "generation")
        newest = ids.groupBy(*TEXT).agg(F.max("generation").alias("newest"), F.min("generation").alias("oldest")).where("newest > oldest").select(*TEXT, "newest")
        return rows.join(newest, TEXT, "left").where("newest is null or newest = generation").drop("newest")

    def texts(self) -> DataFrame:
        return self._current(self._read("texts")).where("matched_text is not null").drop("generation")

    def hits(self, request: Request) -> DataFrame:
        """property, text_id, course_id of the texts that meet the request, from postings alone.

        A query that asks only for what a text must not hold meets all texts without it, whose ids come from texts.
        """
        asked = {name: self._terms(english.course_code_query(request.query) if name == "course" else request.query) for name in request.properties}
        words = sorted({w for some in asked.values() for a in some for t in a for w in t.words if w})
        entry = F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at")
        held = self._current(self._read("postings").where(F.col("token").isin(words))).groupBy(*TEXT, "course_id").agg(entry)
        if any(all(t.negated for t in a) for some in asked.values() for a in some):
            held = self.texts().select(*TEXT, "course_id").join(held.select(*TEXT, "at"), TEXT, "left").withColumn("at", F.coalesce("at", F.create_map().cast("map<string,array<int>>")))
        meets = F.lit(False)
        for name, some in asked.items():
            meets = meets | ((F.col("property") == name) & self._meets(some))
        return held.where(F.col("property").isin(list(request.properties)) & meets).select(*TEXT, "course_id")

    def _terms(self, query: str) -> list[list[english.Term]]:
        """Alternatives of terms; with stems, stop words are empty places of phrases, and ask for nothing alone."""
        own = lambda w: ("" if w in english.STOP_WORDS else english.stem(w)) if self.stemmed else w
        some = [[english.Term(tuple(map(own, t.words)), t.negated) for t in a] for a in english.parse(query)]
        return [kept for a in some if (kept := [t for t in a if any(t.words)])]

    def _meets(self, alternatives: list[list[english.Term]]) -> Column:
        one = lambda a: reduce(lambda x, y: x & y, [~self._holds(t) if t.negated else self._holds(t) for t in a])
        return reduce(lambda x, y: x | y, map(one, alternatives), F.lit(False))

    def _holds(self, term: english.Term) -> Column:
        """A word by its posting; a phrase by an intersection of positions, each less the word's place in the phrase."""
        places = [(k, w) for k, w in enumerate(term.words) if w]
        lists = [F.coalesce(F.try_element_at("at", F.lit(w)), F.array().cast("array<int>")) for _, w in places]
        if len(places) == 1:
            return F.size(lists[0]) > 0
        before = lambda k: lambda p: p - k
        starts = [F.transform(positions, before(k)) for (k, _), positions in zip(places, lists, strict=True)]
        return F.size(reduce(F.array_intersect, starts)) > 0

    def matches(self, request: Request) -> DataFrame:
        """FOUND of the texts that meet the request, as search.matches_in() has them."""
        return self.texts().join(self.hits(request).select(*TEXT), TEXT, "left_semi").select(*FOUND)
