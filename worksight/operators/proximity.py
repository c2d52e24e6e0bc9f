"""Projects whose sites lie within a few hundred metres of each other.

Equal coordinates are first collapsed into one site with a count (a district
centroid entered for a third of all projects is one site).  Sites are joined
through a cubic grid, so work follows the number of real neighbours, not the
square of the table; crowded cells are spread over several tasks.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import MIN_ROWS_FOR_PAIRS, OVERLAP_KM
from ..functions.columns import clean_double, round_even
from ..functions.geo import forward_steps, grid_cell, haversine_km, inside_cell
from ..plans.materialize import materialize
from ..plans.skew import ROWS_PER_TASK, crowded_keys, lookup_join, salt_of, salts

c = F.col
SITE = ["latitude", "longitude"]


def located(projects: DataFrame, *keep: str) -> DataFrame:
    """Rows with both coordinates."""
    rows = projects.select("project_id", *keep, *[clean_double(c(x)).alias(x) for x in SITE])
    return rows.where(c("latitude").isNotNull() & c("longitude").isNotNull())


def sites(points: DataFrame, threshold_km: float, *more: Column, min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """Distinct coordinates, the projects on each, ``more`` aggregates, and the grid cell.

    Written once: four narrow columns that the steps below read repeatedly.
    With fewer than ``min_rows`` located projects there are no pairs at all (a
    rule of the analysis, not of the plan).
    """
    enough = points.agg(F.count("*")).scalar() >= min_rows
    places = (points.groupBy(*SITE).agg(F.count("*").alias("projects"), *more).where(enough)
              .withColumn("cell", grid_cell(c("latitude"), c("longitude"), threshold_km)))
    return materialize(places, "sites")


def near_sites(places: DataFrame, threshold_km: float = OVERLAP_KM,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each unordered pair of different sites within the threshold, once, with the columns of both."""
    axes = [f"_inside_{i}" for i in range(3)]
    inside = inside_cell(c("latitude"), c("longitude"), threshold_km)
    steps = forward_steps(c("latitude"), c("longitude"), threshold_km, [c(x) for x in axes])
    visitors = (places.withColumns(dict(zip(axes, inside))).withColumn("step", F.explode(steps))
                .withColumn("cell", c("cell") + c("step")).drop(*axes))
    home, keys = places, ["cell"]
    crowded = crowded_keys(places, ["cell"], rows_per_task)
    if crowded is not None:
        # Some cells hold too many sites for one task.
        visitors = visitors.join(crowded, "cell", "left").withColumn(
            "salt", salt_of(c("n"), F.struct(*SITE), rows_per_task))
        home = home.join(crowded, "cell", "left").withColumn("salt", F.explode(salts(c("n"), rows_per_task)))
        keys = ["cell", "salt"]
    columns = [x for x in places.columns if x != "cell"]
    visitors = visitors.select(*keys, (c("step") != 0).alias("away"), *[c(x).alias(f"{x}_1") for x in columns])
    home = home.select(*keys, *[c(x).alias(f"{x}_2") for x in columns])
    one, two = F.struct("latitude_1", "longitude_1"), F.struct("latitude_2", "longitude_2")
    km = haversine_km(c("latitude_1"), c("longitude_1"), c("latitude_2"), c("longitude_2"))
    return (visitors.join(home, keys)
            .where(c("away") | (one < two))      # inside a cell: each pair once
            .withColumn("km", km).where(c("km") <= threshold_km)
            .drop("away", *keys))


def geo_pairs(projects: DataFrame, threshold_km: float = OVERLAP_KM, names: bool = True,
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every pair of projects within the threshold, smaller id first.

    As large as its answer: m projects on one spot are m(m-1)/2 pairs.  Scores
    use ``geo_risk``, which counts them without forming the pairs.
    """
    keep = ["project_name"] if names else []
    points = materialize(located(projects, *keep), "located")      # read by the sites and by both sides of a pair
    places = sites(points, threshold_km)
    between = near_sites(places, threshold_km, rows_per_task)
    within = places.where(c("projects") > 1).select(
        *[c(x).alias(f"{x}_{s}") for s in "12" for x in SITE], F.lit(0.0).alias("km"),
        *[c("projects").alias(f"projects_{s}") for s in "12"])
    # Both joins meet all projects of a site, so both are salted by their number.
    links = between.unionByName(within).withColumn("salt_1", F.explode(salts(c("projects_1"), rows_per_task)))
    sized = points.join(places.drop("cell"), SITE).withColumn("a", F.struct("project_id", *keep))
    one = sized.select(*[c(x).alias(f"{x}_1") for x in SITE], "a",
                       salt_of(c("projects"), c("project_id"), rows_per_task).alias("salt_1"))
    two = sized.select(*[c(x).alias(f"{x}_2") for x in SITE], c("a").alias("b"),
                       F.explode(salts(c("projects"), rows_per_task)).alias("salt_2"))
    met = (links.join(one, ["latitude_1", "longitude_1", "salt_1"])
           .withColumn("salt_2", salt_of(c("projects_2"), c("a.project_id"), rows_per_task))
           .join(two, ["latitude_2", "longitude_2", "salt_2"]))
    same = (c("latitude_1") == c("latitude_2")) & (c("longitude_1") == c("longitude_2"))
    met = met.where(~same | (c("a.project_id") < c("b.project_id")))
    first, second = F.least("a", "b"), F.greatest("a", "b")
    columns: list[Column] = []
    for field in ["project_id", *keep]:
        columns += [first[field].alias(f"{field}_1"), second[field].alias(f"{field}_2")]
    return met.select(*columns, round_even(c("km"), 3).alias("distance_km"))


def site_stats(places: DataFrame, threshold_km: float = OVERLAP_KM) -> DataFrame:
    """Other projects in reach of a project on each site, and the nearest."""
    # One row per side from a single pass over the pairs.
    sides = F.array(*[F.struct(*[c(f"{x}_{me}").alias(x) for x in SITE], c("km"), c(f"projects_{other}").alias("n"))
                      for me, other in (("1", "2"), ("2", "1"))])
    near = near_sites(places, threshold_km).select(F.inline(sides))
    own = places.where(c("projects") > 1).select(*SITE, F.lit(0.0).alias("km"), (c("projects") - 1).alias("n"))
    return near.unionByName(own).groupBy(*SITE).agg(
        round_even(F.min("km"), 3).alias("geo_nearest_km"), F.sum("n").alias("geo_overlap_count"))


def geo_hits(projects: DataFrame, threshold_km: float = OVERLAP_KM, min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """Score of the projects that overlap with another one."""
    points = located(projects)
    places = sites(points, threshold_km, min_rows=min_rows)
    stats = site_stats(places, threshold_km)
    limit = F.lit(float(threshold_km))
    closeness = F.greatest((limit - c("geo_nearest_km")) / limit, F.lit(0.0))
    bonus = F.least(c("geo_overlap_count"), F.lit(3)) * 10
    sizes = places.select(*SITE, c("projects").alias("n"))
    return lookup_join(points, stats, SITE, "project_id", sizes=sizes).select(
        "project_id", F.lit(True).alias("geo_anomaly"),
        round_even(F.least(closeness * 70 + bonus, F.lit(100.0)), 2).alias("geo_risk_score"),
        "geo_overlap_count", "geo_nearest_km")


def geo_risk(projects: DataFrame, threshold_km: float = OVERLAP_KM, min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """The same for every project, 0 without overlap."""
    return projects.select("project_id").join(geo_hits(projects, threshold_km, min_rows), "project_id", "left").select(
        "project_id", F.coalesce(c("geo_anomaly"), F.lit(False)).alias("geo_anomaly"),
        F.coalesce(c("geo_risk_score"), F.lit(0.0)).alias("geo_risk_score"),
        F.coalesce(c("geo_overlap_count"), F.lit(0)).alias("geo_overlap_count"), "geo_nearest_km")


def closest_overlaps(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The first pairs of a listing by distance, then ids."""
    return pairs.orderBy("distance_km", "project_id_1", "project_id_2").limit(k)


def closest_pairs(projects: DataFrame, k: int = 20, threshold_km: float = OVERLAP_KM, names: bool = True,
                  min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """``closest_overlaps(geo_pairs(projects), k)`` without the listing.

    A pair of sites has its first project pair from the smallest id of each,
    so the k best site pairs in that order, and the k best sites with several
    projects, hold the k first project pairs.  Of a site, the k + 1 smallest
    ids suffice: any other pair comes after k pairs with smaller ids.
    """
    keep = ["project_name"] if names else []
    points = materialize(located(projects, *keep), "located")
    places = sites(points, threshold_km, F.min("project_id").alias("low"), F.max("project_id").alias("high"),
                   min_rows=min_rows)
    ends = {s: [f"{x}_{s}" for x in SITE] for s in "12"}
    lows = [F.least("low_1", "low_2"), F.greatest("low_1", "low_2")]
    between = (near_sites(places, threshold_km).select(*ends["1"], *ends["2"], round_even(c("km"), 3).alias("km"),
                                                       lows[0].alias("p"), lows[1].alias("q"))
               .orderBy("km", "p", "q").limit(k).drop("p", "q"))
    within = places.where(c("low") < c("high")).orderBy("low").limit(k).select(
        *[c(x).alias(f"{x}_{s}") for s in "12" for x in SITE], F.lit(0.0).alias("km"))
    picked = materialize(between.unionByName(within), "closest-sites")       # at most 2 k rows
    wanted = picked.select(F.inline(F.array(*[F.struct(*[c(n).alias(x) for n, x in zip(ends[s], SITE)]) for s in "12"])))
    # Ranking with a constant limit is cut in each task before the shuffle, so a crowded site sends little.
    by_id = Window.partitionBy(*SITE).orderBy("project_id")
    heads = materialize(points.join(F.broadcast(wanted.distinct()), SITE).withColumn("place", F.dense_rank().over(by_id))
                        .where(c("place") <= k + 1).select(*SITE, F.struct("project_id", *keep).alias("at")), "site-heads")
    met = picked
    for s in "12":
        met = met.join(heads.select(*[c(x).alias(f"{x}_{s}") for x in SITE], c("at").alias(f"at_{s}")), ends[s])
    same = (c("latitude_1") == c("latitude_2")) & (c("longitude_1") == c("longitude_2"))
    met = met.where(~same | (c("at_1.project_id") < c("at_2.project_id")))
    first, second = F.least("at_1", "at_2"), F.greatest("at_1", "at_2")
    columns = [side[field].alias(f"{field}_{s}") for field in ["project_id", *keep]
               for s, side in (("1", first), ("2", second))]
    return closest_overlaps(met.select(*columns, c("km").alias("distance_km")), k)
