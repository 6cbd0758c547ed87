"""Title search, blind to accents, case and hyphens."""

from __future__ import annotations

import heapq
import math
from typing import TYPE_CHECKING

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import like_fragments, like_regex, like_text, like_tokens, search_form
from marquee.plans.catalogue import DEFAULT_PAGE_SIZE, Catalogue, InvalidArgument, Page, check_page, summary, with_genres
from marquee.session import staged

if TYPE_CHECKING:
    from marquee.plans.title_index import TitleIndex

# Query length bounds, relevance scores and preset sizes.
SHORTEST_QUERY = 2
LONGEST_QUERY = 100
EXACT, PREFIX, CONTAINS, ORIGINAL = 100, 50, 10, 5
SUGGESTIONS = 8
RESULTS_PAGE = 50


def with_search_forms(movies: DataFrame) -> DataFrame:
    """Store the compared forms of both titles once, so searches need not derive them per query."""
    return movies.withColumns({"title_form": search_form(F.col("title")), "original_form": search_form(F.col("original_title"))})


def checked_query(query: str) -> str:
    text = query.strip()
    if not SHORTEST_QUERY <= len(text) <= LONGEST_QUERY:
        raise InvalidArgument(
            "invalid_search_query", f"a query needs {SHORTEST_QUERY} to {LONGEST_QUERY} characters, got {len(text)}"
        )
    return text


def relevance(exact: Column, source: Column, plain: Column | None = None) -> tuple[Column, Column]:
    """(match, score) over ``title_form`` and ``original_form`` of a query's form and its form as LIKE text.

    Constant patterns are planned as contains and prefix tests where they have no wildcard. For patterns
    in a column, ``plain`` tells which have none and need no pattern matching.
    """
    title, original = F.col("title_form"), F.col("original_form")

    def holds(text: Column) -> Column:
        like = F.like(text, F.concat(F.lit("%"), source, F.lit("%")))
        return F.coalesce(like if plain is None else F.when(plain, F.contains(text, source)).otherwise(like), F.lit(False))

    def begins(text: Column) -> Column:
        like = F.like(text, F.concat(source, F.lit("%")))
        return like if plain is None else F.when(plain, F.startswith(text, source)).otherwise(like)

    in_title, in_original = holds(title), holds(original)
    score = F.when(title == exact, EXACT).when(begins(title), PREFIX).when(in_title, CONTAINS).when(in_original, ORIGINAL).otherwise(0)
    return in_title | in_original, score


def hits(movies: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """Matching movies with ``relevance_score``."""
    if "title_form" not in movies.columns:
        movies = with_search_forms(movies)
    match, score = relevance(search_form(F.lit(query)), search_form(like_text(F.lit(query), literal)))
    return movies.filter(match).withColumn("relevance_score", score)


def search(
    catalogue: Catalogue, query: str, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE, literal: bool = False, index: TitleIndex | None = None
) -> Page:
    """One page of title matches, best first, and how many there are in all; with an index of the titles only its lists for the query are read."""
    text, offset = checked_query(query), check_page(page, page_size)
    found = hits(catalogue.movies, text, literal) if index is None else index.hits(text, literal)
    order = [F.desc("relevance_score"), F.col("popularity").desc_nulls_last(), F.col("id").asc()]
    columns = ["id", "title", "release_date", "poster_path", "vote_average", "vote_count", "popularity"]
    rows = summary(found.select(*columns, "relevance_score").orderBy(*order).offset(offset).limit(page_size))
    return Page(with_genres(catalogue, rows), page, page_size, found.count())


def suggest(catalogue: Catalogue, typed: str) -> DataFrame | None:
    """The few best matches while typing; None while the text is too short to search."""
    if len(typed.strip()) < SHORTEST_QUERY:
        return None
    return search(catalogue, typed, 1, SUGGESTIONS).items


def results(catalogue: Catalogue, query: str) -> Page:
    """The first results screen."""
    return search(catalogue, query, 1, RESULTS_PAGE)


# ---- a table of queries ----------------------------------------------------------------------------------------

ROWS_PER_TASK = 200_000
QUERIES_PER_TASK = 20_000


def checked_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query, error): stripped of white space as a single query is; ``error`` names why a query is refused, else it is null."""
    text = F.regexp_replace("query", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    fits = F.length("query").between(SHORTEST_QUERY, LONGEST_QUERY)
    stripped = queries.select("query_id", text.alias("query"))
    return stripped.withColumn("error", F.when(~F.coalesce(fits, F.lit(False)), F.lit("invalid_search_query")))


class Patterns:
    """The patterns of some queries behind one automaton over their longest literal fragments."""

    def __init__(self, exact: list[str], sources: list[str]):
        self.exact, self.sources = exact, sources
        # As in ``relevance``, an escape at a query's end escapes the wildcard behind it.
        inside = [f"%{s}%" for s in sources]
        live = [i for i, s in enumerate(inside) if sum(wild for _, wild in like_tokens(s)) != 2 or "\\" in s]
        self.inside, self.start = {i: like_regex(inside[i]) for i in live}, {i: like_regex(f"{sources[i]}%") for i in live}
        self.by_fragment: dict[str, list[int]] = {}
        #: Patterns of wildcards alone, by the characters that they ask for: such a pattern only looks at a text's length.
        self.by_length: dict[int, list[int]] = {}
        for i, source in enumerate(sources):
            parts = like_fragments(f"%{source}%")
            if parts:
                self.by_fragment.setdefault(max(parts, key=len), []).append(i)
            else:
                self.by_length.setdefault(source.count("_"), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for fragment, owners in self.by_fragment.items():
            self.automaton.add_word(fragment, owners)
        if self.by_fragment:
            self.automaton.make_automaton()

    def near(self, text: str | None) -> set[int]:
        """The patterns whose fragment stands in a text."""
        return {i for _, owners in self.automaton.iter(text) for i in owners} if text and self.by_fragment else set()

    def score(self, i: int, title: str | None, original: str | None) -> int:
        """The relevance of a title to a pattern, 0 without a match; the same as ``relevance``."""
        def holds(text: str | None) -> bool:
            return text is not None and (self.inside[i].fullmatch(text) is not None if i in self.inside else self.sources[i] in text)

        in_title = holds(title)
        if not in_title:
            return ORIGINAL if holds(original) else 0
        if title == self.exact[i]:
            return EXACT
        begins = self.start[i].fullmatch(title) is not None if i in self.start else title.startswith(self.sources[i])
        return PREFIX if begins else CONTAINS


def _best(k: int):
    def run(titles: pa.Table, queries: pa.Table) -> pa.Table:
        asked, placed, scores = [], [], []
        if len(titles) and len(queries):
            patterns = Patterns(*(queries.column(c).to_pylist() for c in ("exact", "source")))
            forms, originals, popular, ids = (titles.column(c).to_pylist() for c in ("title_form", "original_form", "popularity", "id"))
            found: dict[int, list[tuple]] = {}

            def add(i: int, place: int, score: int) -> None:
                held = found.setdefault(i, [])
                held.append((-score, popular[place] is None, -(popular[place] or 0), ids[place], place))
                if len(held) > 8 * k:
                    held[:] = heapq.nsmallest(k, held)

            named: dict[str, list[int]] = {}
            for place, (title, original) in enumerate(zip(forms, originals)):
                for i in patterns.near(title) | patterns.near(original):
                    if score := patterns.score(i, title, original):
                        add(i, place, score)
                if patterns.by_length and title is not None:
                    named.setdefault(title, []).append(place)
            for length, owners in patterns.by_length.items():
                # All patterns of a length share their best; a title that is written like the pattern itself comes first.
                shared: list[tuple] = []
                for place, (title, original) in enumerate(zip(forms, originals)):
                    score = PREFIX if title is not None and len(title) >= length else ORIGINAL if original is not None and len(original) >= length else 0
                    if score:
                        shared.append((-score, popular[place] is None, -(popular[place] or 0), ids[place], place))
                shared = heapq.nsmallest(k, shared)
                for i in owners:
                    same = set(named.get(patterns.exact[i], ()))
                    found[i] = [x for x in shared if x[-1] not in same]
                    for place in same:
                        if score := patterns.score(i, forms[place], originals[place]):
                            add(i, place, score)
            for i, held in found.items():
                for score, *_, place in heapq.nsmallest(k, held):
                    asked.append(i)
                    placed.append(place)
                    scores.append(-score)
        rows, owners = titles.take(pa.array(placed, pa.int64())), queries.take(pa.array(asked, pa.int64()))
        return pa.table([owners.column("query_id"), *(rows.column(c) for c in ("id", "title", "popularity")), pa.array(scores, pa.int32())], names=["query_id", "id", "title", "popularity", "relevance_score"])

    return run


def search_many(
    movies: DataFrame, queries: DataFrame, k: int = SUGGESTIONS, literal: bool = False, rows_per_task: int = ROWS_PER_TASK, queries_per_task: int = QUERIES_PER_TASK
) -> DataFrame:
    """The k best matches of every query in a table (query_id, query), as ranked rows; a refused query has one row with its ``error``.

    Titles and queries are dealt to parts of bounded size, and a task runs one part's titles through an automaton (Aho-Corasick) over one part's literal fragments, so a title meets
    the queries whose longest fragment it holds and no others; wildcards are verified after that. Queries of wildcards alone are answered once for each number of characters they ask for. A task hands
    on k rows for each query. Movies with equal titles score alike, so beforehand each distinct title keeps its k most popular.
    """
    refused = checked_queries(queries).filter(F.col("error").isNotNull())
    queries = checked_queries(queries).filter(F.col("error").isNull()).select("query_id", "query")
    movies = movies if "title_form" in movies.columns else with_search_forms(movies)
    popular = [F.col("popularity").desc_nulls_last(), F.col("id").asc()]
    place = F.row_number().over(Window.partitionBy("title_form", "original_form").orderBy(*popular))
    best = movies.select("id", "title", "popularity", "title_form", "original_form")
    best = staged(best.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place"), "search-titles")
    sought = staged(queries.select("query_id", search_form(F.col("query")).alias("exact"), search_form(like_text(F.col("query"), literal)).alias("source")), "search-queries")

    chunks, parts = max(1, math.ceil(best.count() / rows_per_task)), max(1, math.ceil(sought.count() / queries_per_task))
    spark = movies.sparkSession
    chunks = max(chunks, spark.sparkContext.defaultParallelism // parts)
    held = best.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = sought.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kinds = dict(best.dtypes) | dict(sought.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "id", "title", "popularity")) + ", relevance_score int"
    found = held.groupBy("chunk", "part").cogroup(asked.groupBy("chunk", "part")).applyInArrow(_best(k), shape)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), *popular))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    answers = ranked.select("query_id", "rank", "id", "title", "popularity", "relevance_score", F.lit(None).cast("string").alias("error"))
    return answers.unionByName(refused.select("query_id", "error"), allowMissingColumns=True)
