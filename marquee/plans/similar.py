"""Recommendations: the movies whose embedding is closest to that of a given movie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import neighbours as nn
from marquee.plans.catalogue import Catalogue, InvalidArgument, check_min_votes, summary, with_genres

# Bounds and presets of the query.
MOST_SIMILAR = 50
DEFAULT_SIMILAR = 10
POPULAR_MIN_VOTES = 50


def similar(
    catalogue: Catalogue, movie_id: int, k: int = DEFAULT_SIMILAR, min_votes: int | None = None,
    index: nn.VectorIndex | None = None,
) -> DataFrame | None:
    """Summaries with ``similarity``, closest first; None when the movie has no vector.

    Vectors are reduced to (id, similarity) before they meet the movies, and only the k best fetch the
    rest of their summary.
    """
    if not 1 <= k <= MOST_SIMILAR:
        raise InvalidArgument("invalid_limit", f"limit must be 1 to {MOST_SIMILAR}, got {k}")
    check_min_votes(min_votes)
    vectors = catalogue.embeddings.withColumnRenamed("movie_id", "id").select("id", "embedding")
    reference = nn.reference_vector(vectors, movie_id)
    if reference is None:
        return None
    movies = catalogue.movies if min_votes is None else catalogue.movies.filter(F.col("vote_count") >= min_votes)
    if index is None:
        scored = nn.nearest(vectors, reference, movie_id).join(movies.select("id"), "id", "left_semi")
        best = scored.orderBy(*nn.by_similarity()).limit(k)
    else:
        best = index.search(reference, k, movie_id, allowed=movies)
    best = best.collect()  # at most MOST_SIMILAR rows
    spark = catalogue.movies.sparkSession
    scores = spark.createDataFrame(best, "id bigint, similarity double")
    cards = summary(catalogue.movies.filter(F.col("id").isin([r["id"] for r in best])))
    return with_genres(catalogue, cards.join(scores, "id").orderBy(*nn.by_similarity()))


def similar_popular(catalogue: Catalogue, movie_id: int) -> DataFrame | None:
    """The preset of the details page: well-voted neighbours only."""
    return similar(catalogue, movie_id, DEFAULT_SIMILAR, POPULAR_MIN_VOTES)
