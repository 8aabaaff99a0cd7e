"""Relevance datasets: pools, labels, splits, training pairs, error analysis.

Candidates in long form: ``query_id, query, candidate_collection, program_id,
source_id, candidate_source, baseline_rank, candidate_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import text as T
from quarrylight.operators.groups import hashed_position, numbered


def candidate_key() -> Column:
    return (
        F.when(F.col("program_id").isNotNull(), F.concat(F.lit("program:"), "program_id"))
        .when(F.col("source_id").isNotNull(), F.concat(F.lit("source:"), "source_id"))
        .when(F.coalesce("canonical_url", F.lit("")) != "", F.concat(F.lit("url:"), "canonical_url"))
    )


def seeded(seed: int, key: Column) -> Column:
    return F.concat_ws("-", F.lit(str(seed)), key)


def random_negatives(queries: DataFrame, known: DataFrame, items: DataFrame, item: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` items per query that are not in known(query_id, item).

    All items lie on a ring in hashed order. Each query starts at its own
    hashed place and takes the next ``n`` unknown items. Nobody walks: a known
    item's distance less the number of known ones before it is the number of
    unknown items before it, so the known ones that lie before the j-th unknown
    item are counted, which gives its distance. A query has ``n`` steps however
    many items it knows, and these are numbered in slices. Places join items by
    equality: queries and items are never multiplied.
    """
    ring = hashed_position(items.select(item), seeded(seed, F.col(item)), "place")
    total = items.agg(F.count("*")).scalar()
    start = F.conv(F.substring(F.md5(seeded(seed, F.col("query_id")).cast("binary")), 1, 8), 16, 10).cast("long")
    met = known.select("query_id", item).distinct().join(ring, item).withColumn("total", total)
    met = met.select("query_id", F.pmod(F.col("place") - start, F.col("total")).alias("distance"))
    gaps = numbered(met, ["query_id"], "distance", F.lit(0.0), total.cast("double"), "passed").withColumn("at", F.col("distance") - F.col("passed"))
    passed = gaps.where(F.col("at") < n).groupBy("query_id", "at").agg(F.count("*").alias("size"))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    walk = queries.select("query_id", steps.alias("at")).join(passed, ["query_id", "at"], "left")
    so_far = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    walk = walk.withColumn("step", F.col("at") + F.coalesce(F.sum("size").over(so_far), F.lit(0))).withColumn("total", total)
    walk = walk.where(F.col("step") < F.col("total")).withColumn("place", (start + F.col("step")) % F.col("total"))
    return walk.join(ring, "place").select("query_id", item, (F.col("at") + 1).alias("negative_no"))


def candidate_pool(queries: DataFrame, existing: DataFrame, retrieved: DataFrame, items: DataFrame, item: str, n: int, seed: int = 42) -> DataFrame:
    """Existing candidates by item, then retrieved ones, then random negatives.

    Existing candidates are numbered in slices, as a query may have very many;
    of the others a query has the depth of retrieval plus ``n`` at most.
    """
    pair = ["query_id", item]
    fresh = retrieved.join(existing.select(*pair), pair, "left_anti").select(
        *pair, F.lit(V.HARD_CANDIDATE).alias("candidate_source"), F.col("rank").alias("baseline_rank"), F.lit(1).alias("part"), F.col("rank").alias("no"),
    )
    old = existing.select(*pair, "candidate_source", F.lit(None).cast("long").alias("baseline_rank"))
    known = old.select(*pair).unionByName(fresh.select(*pair))
    extra = random_negatives(queries, known, items, item, n, seed).select(
        *pair, F.lit(V.RANDOM_NEGATIVE).alias("candidate_source"), F.lit(None).cast("long").alias("baseline_rank"),
        F.lit(2).alias("part"), F.col("negative_no").alias("no"),
    )
    sizes = old.groupBy("query_id").agg(F.count("*").alias("before"))
    w = Window.partitionBy("query_id").orderBy("part", "no")
    added = fresh.unionByName(extra).withColumn("at", F.row_number().over(w)).join(sizes, "query_id", "left")
    added = added.withColumn("candidate_no", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long"))
    low, high = (items.agg(f(item).cast("double")).scalar() for f in (F.min, F.max))
    first = numbered(old, ["query_id"], item, low, high, "at").withColumn("candidate_no", F.col("at") + 1).drop("at")
    return first.unionByName(added.drop("part", "no", "at", "before"))


def teacher_score(query: Column, words: Column) -> Column:
    """Share of query terms that occur among the words of a candidate."""
    terms = F.array_distinct(T.tokens(query))
    # The second of the two is hashed for each row: the few terms.
    return F.round(F.size(F.array_intersect(words, terms)) / F.greatest(F.size(terms), F.lit(1)), 6)


def bootstrap_labels(scored: DataFrame) -> DataFrame:
    """Grades by score rank within a query: 1-2 -> 3, 3-5 -> 2, 6-10 -> 1, else 0."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("candidate_no"))
    rank = F.row_number().over(w)
    grade = F.when(F.col("r") <= 2, 3).when(F.col("r") <= 5, 2).when(F.col("r") <= 10, 1).otherwise(0)
    rows = scored.withColumn("r", rank).withColumn("relevance", grade.cast("long"))
    return rows.withColumn("reason", F.lit(V.TEACHER_REASON)).drop("r")


def human_overrides(labels: DataFrame, human: DataFrame) -> DataFrame:
    """Labels where matching human(query_id, program_id, relevance) replace grades."""
    h = human.select("query_id", "program_id", F.col("relevance").alias("human"))
    rows = labels.join(h, ["query_id", "program_id"], "left")
    rows = rows.withColumn("reason", F.when(F.col("human").isNotNull(), V.HUMAN_REASON).otherwise(F.col("reason")))
    return rows.withColumn("relevance", F.coalesce("human", "relevance")).drop("human")


def unmatched_judgments(labels: DataFrame, human: DataFrame) -> DataFrame:
    return human.join(labels.where("program_id IS NOT NULL"), ["query_id", "program_id"], "left_anti")


def query_splits(queries: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, split): 70/15/15 by hashed order, each part non-empty if possible."""
    placed = hashed_position(queries.select("query_id").distinct(), seeded(seed, F.col("query_id")))
    total = queries.agg(F.countDistinct("query_id")).scalar()
    rows = placed.withColumn("n", total)
    n = F.col("n")
    train = F.bround(n * F.lit(0.70)).cast("long")
    validation = train + F.bround(n * F.lit(0.15)).cast("long")
    t = F.when(n >= 3, F.least(F.greatest(train, F.lit(1)), n - 2)).when(n == 2, 1).otherwise(train)
    v = F.when(n >= 3, F.least(F.greatest(validation, t + 1), n - 1)).when(n == 2, 1).otherwise(validation)
    split = F.when(F.col("position") < t, "train").when(F.col("position") < v, "validation").otherwise("test")
    return rows.select("query_id", split.alias("split"))


def train_splits(queries: DataFrame, authoritative: DataFrame, seed: int = 42) -> DataFrame:
    """Splits where authoritative(query_id) queries always train."""
    placed = hashed_position(queries.select("query_id").distinct(), seeded(seed, F.col("query_id")))
    total = queries.agg(F.countDistinct("query_id")).scalar()
    n = F.col("n")
    train = F.greatest(F.lit(1), F.bround(n * F.lit(0.70)).cast("long"))
    end = F.least(F.greatest(train + 1, train + F.bround(n * F.lit(0.15)).cast("long")), n - 1)
    own = authoritative.select("query_id", F.lit(True).alias("own")).distinct()
    rows = placed.join(own, "query_id", "left").withColumn("n", total)
    rows = rows.select("query_id", (F.coalesce("own", F.lit(False)) | (F.col("position") < train)).alias("trains"), (end - train).alias("want"))
    rest = hashed_position(rows.where("NOT trains").select("query_id", "want"), seeded(seed, F.col("query_id")))
    left = rows.where("NOT trains").agg(F.count("*")).scalar()
    size = F.when(F.col("left") >= 2, F.least(F.col("left") - 1, F.greatest(F.lit(1), F.col("want")))).otherwise(0)
    held = rest.withColumn("left", left).select(
        "query_id", F.when(F.col("position") < size, "validation").otherwise("test").alias("split")
    )
    return rows.where("trains").select("query_id", F.lit("train").alias("split")).unionByName(held)


def training_pairs(labels: DataFrame, splits: DataFrame, copies: int = 5) -> DataFrame:
    """Labelled pairs with their split; human pairs count ``copies`` times in training."""
    rows = labels.join(splits, "query_id")
    human = (F.col("reason") == V.HUMAN_REASON) & (F.col("split") == "train")
    times = F.when(human, copies).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def error_template(queries: DataFrame, rankings: DataFrame) -> DataFrame:
    """A review sheet: one row a query with its ranking as text, and category and notes for people to fill in."""
    key = F.coalesce(F.concat(F.lit("program:"), "program_id"), F.concat(F.lit("source:"), "source_id"))
    line = F.struct("rank", F.concat_ws(" ", F.col("rank").cast("string"), key, F.col("relevance").cast("string")).alias("text"))
    # A ranking is as long as the depth of retrieval at most.
    lists = rankings.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "|").alias("ranking"))
    none = F.lit(None).cast("string")
    return queries.join(lists, "query_id", "left").select(
        "query_id", "query", none.alias("category"), none.alias("notes"), F.lit("draft").alias("status"),
        F.lit("|".join(V.ERROR_CATEGORIES)).alias("allowed_categories"), F.coalesce("ranking", F.lit("")).alias("ranking"),
    )


def error_summary(reviews: DataFrame) -> DataFrame:
    """(category, reviews, share) of valid categories, and the unreviewed count.

    Categories are a fixed set, so the window sees at most nine rows.
    """
    valid = reviews.where(F.col("category").isin(*V.ERROR_CATEGORIES)).groupBy("category").agg(F.count("*").alias("reviews"))
    all_ = Window.partitionBy(F.lit(1))
    shares = valid.withColumn("share", F.round(F.col("reviews") / F.sum("reviews").over(all_), 6))
    open_ = reviews.agg(F.count_if(F.coalesce("category", F.lit("")) == "").alias("reviews")).select(
        F.lit("(unreviewed)").alias("category"), "reviews", F.lit(None).cast("double").alias("share")
    )
    return shares.unionByName(open_)
