"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and an inverted index holds every distinct code under each of its segments. A query
probes all segment values within a radius that grows by one in each round. After radius r all codes at a distance of
less than segments * (r + 1) have been met, so a query is done when its kth verified neighbour is no further
than that. A pair that is met in several segments is told from its bits, and a pair further apart than the k codes that its query
already has is left out at once, so neither is shuffled. Queries and rows with equal codes are searched once; a code keeps its k smallest ids, as no answer can hold more.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 64
#: Queries that the number of segments is chosen by.
SAMPLE = 32


def sign_code(vector: Column) -> Column:
    """Bit i is set where the vector's entry i is above 0; entries past the 64th are folded in by exclusive or. A short vector leaves
    the other bits unset, an empty one gives 0, a null one null; a NaN counts as above 0, a null entry as not."""
    bits = F.transform(vector, lambda x, i: F.when(F.coalesce(x > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), (i % BITS).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def n_segments(n_codes: int, distance: int) -> int:
    """The number of segments with the least work to cover ``distance``: probes, and the codes that they meet in
    buckets of even size."""

    def work(m: int) -> float:
        width, radius = BITS // m, -(-(distance + 1) // m) - 1
        return m * sum(comb(width, i) for i in range(min(radius, width) + 1)) * (1 + n_codes / 2.0**width)

    return min((2, 4, 8, 16), key=work)


def usual_distance(codes: DataFrame, pending: DataFrame, k: int, sample: int = SAMPLE) -> int:
    """How far away the kth code is for nine in ten of at most ``sample`` queries (those with the smallest hashes). One pass over
    the codes; what is collected is a histogram of 65 distances for each of these queries."""
    some = [r.query for r in pending.orderBy(F.xxhash64("query")).limit(sample).collect()]
    rows = codes.select("code", F.explode(F.lit(some).cast("array<long>")).alias("query"))
    counted = rows.groupBy("query", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance")).count().orderBy("distance").collect()
    seen, reach = dict.fromkeys(some, 0), {}
    for r in counted:
        seen[r.query] += r["count"]
        if seen[r.query] > k:
            reach.setdefault(r.query, r.distance)
    far = sorted(reach.get(q, BITS) for q in some)
    return far[int(0.9 * (len(far) - 1))]


def masks(width: int, weight: int) -> list[int]:
    """All numbers of ``width`` bits of which ``weight`` are set."""
    from itertools import combinations

    return [sum(1 << i for i in some) for some in combinations(range(width), weight)]


def segments(code: Column, m: int) -> Column:
    width = BITS // m
    return F.array(*(F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1)) for s in range(m)))


def met_first(x: Column, segment: Column, m: int, radius: int) -> Column:
    """Whether a round meets a pair, whose codes differ by the bits of x, in this segment for the first time: rounds before have met
    the pairs of which any segment differs by fewer bits, and of the segments that differ by ``radius`` bits the first one counts."""
    width = BITS // m
    apart = [F.bit_count(F.shiftrightunsigned(x, s * width).bitwiseAND(F.lit((1 << width) - 1))) for s in range(m)]
    return reduce(lambda a, b: a & b, [n >= F.lit(radius) + (F.lit(s) < segment).cast("int") for s, n in enumerate(apart)])


def search(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """base and queries: (id long, code long). -> (query_id, rank, neighbour_id, distance), rank from 1, for each
    query id the k nearest base rows other than its own id; ties go to the smaller id. Fewer than k rows only
    where base has fewer. Rows with a null id or code are neither found nor searched; a repeated id counts once
    (with its smallest code)."""
    clean = lambda df: df.where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))
    rows, asked = stored(clean(base), "codes"), stored(clean(queries), "asked")
    # k + 1 ids: one of them may be the query itself.
    by_code = Window.partitionBy("code").orderBy("id")
    lists = rows.withColumn("turn", F.row_number().over(by_code)).where(F.col("turn") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    codes = stored(lists, "lists")
    n_codes = codes.count()
    # bound: no code further away is among the k + 1 nearest.
    pending = stored(asked.select(F.col("code").alias("query"), F.lit(BITS).alias("bound")).distinct(), "pending")
    if pending.isEmpty():
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance")).limit(0)
    m = n_segments(n_codes, usual_distance(codes, pending, k))
    width = BITS // m
    index = stored(codes.select("code", F.posexplode(segments(F.col("code"), m)).alias("segment", "value"), F.size("ids").alias("size"), F.get("ids", F.lit(0)).alias("low")), "index")
    best, radius = None, 0
    while not pending.isEmpty():
        flips = F.lit(masks(width, radius)).cast("array<long>")
        probes = pending.select("query", "bound", F.posexplode(segments(F.col("query"), m)).alias("segment", "own")).select("query", "bound", "segment", F.explode(F.transform(flips, lambda x: F.col("own").bitwiseXOR(x))).alias("value"))
        # A merge join: what the probes grow to can't be told from the queries' size, so neither side is broadcast.
        x = F.col("query").bitwiseXOR(F.col("code"))
        near = (F.bit_count(x) <= F.col("bound")) & met_first(x, F.col("segment"), m, radius)
        met = probes.hint("merge").join(index, ["segment", "value"]).where(near).select("query", "code", "size", "low", F.bit_count(x).cast("int").alias("distance"))
        every = met if best is None else met.union(best.join(pending, "query", "left_semi").select("query", "code", "size", "low", "distance"))
        # The first k + 1 codes, by distance and smallest id, hold the k nearest rows besides the query's own: each code that comes before
        # a row's code has a row that comes before it. So ties, however many, keep no more.
        ranked = every.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("distance", "low"))).where(F.col("turn") <= k + 1).drop("turn")
        finished = None if best is None else best.join(pending, "query", "left_anti")
        best = stored(ranked if finished is None else ranked.unionByName(finished), "best")
        covered = m * (radius + 1) - 1
        inside = F.col("distance") <= covered
        reached = best.groupBy("query").agg(F.sum(F.when(inside, F.col("size"))).alias("rows"), F.count(F.when(inside, 1)).alias("n"), F.when(F.count("*") > k, F.max("distance")).otherwise(BITS).alias("bound"))
        sure = F.coalesce((F.col("rows") >= k + 1) | (F.col("n") >= n_codes), F.lit(False))
        radius += 1
        left = pending.select("query").join(reached, "query", "left").where(~sure).select("query", F.coalesce("bound", F.lit(BITS)).alias("bound"))
        pending = stored(left if radius <= width else left.limit(0), "pending")
    answers = best.join(codes, "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    short = answers.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id"))).where(F.col("turn") <= k + 1)
    full = asked.join(short, asked["code"] == short["query"]).where("id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))
    return full.select(F.col("id").alias("query_id"), rank.alias("rank"), "neighbour_id", "distance").where(F.col("rank") <= k)
