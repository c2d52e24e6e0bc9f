"""Projects whose name and type read almost the same.

TF-IDF over words and neighbouring word pairs, cosine similarity, threshold.
The exact all-pairs join follows Bayardo, Ma and Srikant (2007):

* Projects with the same word sequence have the same vector, so vectors are
  built once per distinct text ("group").  A group of copies, however large,
  is one row from there on.
* Terms are ordered from rare to frequent.  A pair can only reach the
  threshold if its first common term lies in the part of each vector before
  the remaining length drops below the threshold; only that prefix is joined.
* The prefix is a little longer than that (``DEPTH``), and a term is joined
  only where its best partner leaves enough.  The products over common prefix
  terms are added up per pair.  What the rest of the two vectors can still add
  is at most the product of their remaining lengths, and less than where the
  prefix ends; pairs that cannot reach the threshold are dropped there.  A pair
  that shares a few rare terms by chance falls here, before any vector moves.
* The candidates left are scored on their complete vectors, sorted arrays that
  go once to each bucket of pairs: no row is made for a term or holds a pair.

No term, partner or candidate is capped.
"""

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import ENGLISH_STOP_WORDS, MIN_ROWS_FOR_PAIRS, TEXT_SIMILARITY
from ..functions import vectors as _vectors
from ..functions.columns import round_even
from ..functions.text import ngrams, tokens
from ..plans.materialize import discard, materialize, spread
from ..plans.skew import BROADCAST_KEYS, ROWS_PER_TASK, lookup_join, salt_of, salts

# The helpers travel inside the tasks: executors need no installed package.
cloudpickle.register_pickle_by_value(_vectors)

c = F.col
# Float sums in another order may differ in the last bits; pruning keeps this margin.
MARGIN = 1e-6
# Groups from which on a term may be frequent: it goes to the rows that bear it.
FREQUENT = 10
# Pairs of a listing that one task makes for each row it may hold.
PAIRS_OF_A_ROW = 100
# Common terms count until the product of what both vectors have left is below this part of the threshold.
DEPTH = 0.95


def project_text(name: str = "project_name", kind: str = "project_type") -> Column:
    return F.concat(F.coalesce(c(name), F.lit("")), F.lit(" "), F.coalesce(c(kind), F.lit("")))


def text_members(docs: DataFrame, doc_id: str, text: Column,
                 stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS), name: str | None = None) -> DataFrame:
    """``(id, text_key, words)``, with ``name`` if one is given: rows with equal ``text_key`` have equal vectors."""
    label = [] if name is None else [c(name).alias("name")]
    return _keyed(docs.select(c(doc_id).alias("id"), tokens(text, stop_words).alias("words"), *label))


def _keyed(words: DataFrame) -> DataFrame:
    return words.select("id", F.unhex(F.md5(F.array_join("words", " "))).alias("text_key"), "words", *words.columns[2:])


def text_groups(members: DataFrame) -> DataFrame:
    """One row per distinct text: its smallest id, which names the group, and
    the number of copies."""
    # Words hold no blank; put together they are half as long on their way.
    groups = members.groupBy("text_key").agg(
        F.min("id").alias("group"), F.count("*").alias("copies"), F.any_value(F.array_join("words", " ")).alias("said"))
    words = F.when(c("said") == "", F.array().cast("array<string>")).otherwise(F.split("said", " "))
    return groups.select("text_key", "group", "copies", words.alias("words"))


def count_terms(groups: DataFrame) -> DataFrame:
    """Occurrences of each term in each group, with ``copied``, the key of a text that has copies."""
    # Grouping by text_key as well keeps the counts where the groups already are.
    return (groups.select("text_key", "group", "copies", F.explode(ngrams(c("words"))).alias("term"))
            .groupBy("text_key", "group", "copies", "term").agg(F.count("*").alias("tf"))
            .withColumn("copied", F.when(c("copies") > 1, c("text_key"))).drop("text_key")
            .withColumn("hash", F.xxhash64("term")))


def shared_terms(counted: DataFrame) -> DataFrame:
    """Terms of more than one group, numbered.  Written once: the pair joins
    then carry a number in place of the term."""
    # The hash only speeds up comparisons; word pairs share long beginnings.
    return materialize(
        counted.groupBy("hash", "term").agg(F.sum("copies").alias("df"), F.count("*").alias("holders"))
        .where(c("holders") > 1).withColumn("term_id", F.monotonically_increasing_id()), "shared-terms")


def _raw_weight(total: Column) -> Column:
    return c("tf") * (F.ln((F.lit(1.0) + total) / (F.lit(1.0) + c("df"))) + F.lit(1.0))


def _frequent_from(shared: DataFrame) -> int:
    """Holders above which there are at most ``BROADCAST_KEYS`` terms, ``FREQUENT`` at least."""
    # Four rows for each doubling.
    sizes = (shared.where(c("holders") > FREQUENT).groupBy(F.ceil(4 * F.log2(c("holders") / FREQUENT)).alias("power"))
             .agg(F.count("*").alias("terms"), F.max("holders").alias("most")).orderBy(c("power").desc()).collect())
    terms = 0
    for size in sizes:
        terms += size["terms"]
        if terms > BROADCAST_KEYS:
            return size["most"]
    return FREQUENT


def _numbered(counted: DataFrame, shared: DataFrame) -> DataFrame:
    """``counted`` with the numbers of its terms.

    Most rows bear one of the more frequent terms.  As many of those as can be sent, from the most frequent on, go to
    the rows, so only rows of rarer terms move and all frequent terms of a group stay together.
    """
    keys, frequent = ["hash", "term"], c("holders") > _frequent_from(shared)
    tried = counted.join(F.broadcast(shared.where(frequent)), keys, "left")
    met, rest = tried.where(c("term_id").isNotNull()), tried.where(c("term_id").isNull()).select(*counted.columns)
    found = met.unionByName(rest.join(shared.where(~frequent), keys, "left"))
    # A term that one group alone holds is as frequent as that group has copies.
    return found.withColumns({"df": F.coalesce("df", "copies"), "holders": F.coalesce("holders", F.lit(1))})


def _weighted(counted: DataFrame, shared: DataFrame, total: Column) -> DataFrame:
    return _numbered(counted, shared).withColumn("raw", _raw_weight(total))


def tfidf_terms(counted: DataFrame, shared: DataFrame, total: Column) -> DataFrame:
    """One row per group and term: weight in the normalised vector, how many
    groups hold the term, and the vector length that remains after it."""
    weighted = _weighted(counted, shared, total)
    # Inside one group, so over as many rows as a text has terms; from rare to
    # frequent, with shared terms in the same order in every vector.
    walk = Window.partitionBy("group").orderBy("df", "term_id")
    square = c("raw") * c("raw")
    sized = weighted.withColumns({
        "_all": F.sum(square).over(walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_seen": F.sum(square).over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    left = F.greatest(c("_all") - c("_seen"), F.lit(0.0))
    return sized.select(
        "group", "term_id", "term", "tf", "df", "holders", (c("raw") / F.sqrt("_all")).alias("weight"),
        F.sqrt(left / c("_all")).alias("rest"), F.sqrt((left + square) / c("_all")).alias("rest_with"))


def shared_vectors(counted: DataFrame, shared: DataFrame, total: Column, least: float = 0.0) -> DataFrame:
    """The rows of ``tfidf_terms`` whose term several groups hold, with the vector length that remains from the term on.

    A term of one group alone only adds to the length, and comes first.  The terms of a group are put together in
    each task, so one row per group moves and not one per term.  Left out are groups whose shared terms together are
    shorter than ``least``: that is the most they have in common with any other.
    """
    alone, square, parts = c("holders") == 1, c("raw") * c("raw"), ["df", "term_id", "holders", "tf"]
    vectors = _weighted(counted.select("group", "copies", "hash", "term", "tf"), shared, total).groupBy("group").agg(
        F.coalesce(F.sum(F.when(alone, square)), F.lit(0.0)).alias("_alone"),
        # Lists of numbers, in the same order, are half as long on their way as one of structs.
        *[F.collect_list(F.when(~alone, c(x))).alias(x) for x in parts])
    walk = Window.partitionBy("group").orderBy("df", "term_id")
    terms = vectors.select("group", "_alone", F.inline(F.arrays_zip(*parts))).withColumn("raw", _raw_weight(total))
    sized = terms.withColumns({
        "_all": c("_alone") + F.sum(square).over(walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_seen": c("_alone") + F.sum(square).over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    left = F.greatest(c("_all") - c("_seen"), F.lit(0.0))
    enough = F.sqrt((c("_all") - c("_alone")) / c("_all")) >= least
    return sized.where(enough).select("group", "term_id", "holders", (c("raw") / F.sqrt("_all")).alias("weight"),
                                      F.sqrt((left + square) / c("_all")).alias("rest_with"), "raw", F.sqrt("_all").alias("size"))


def candidate_groups(shared: DataFrame, threshold: float, rows_per_task: int) -> DataFrame:
    """Pairs that can reach the threshold, from the rare part of each vector."""
    # At the first common term of a pair that reaches the threshold, what both vectors have left from
    # there on must reach it (Cauchy-Schwarz); terms count down to ``deep``, so less than that is not seen.
    deep = F.lit(threshold * DEPTH)
    prefix = shared.where(c("rest_with") >= deep - MARGIN)
    few = c("holders") <= rows_per_task
    calm = prefix.where(few).withColumn("most", F.max("rest_with").over(Window.partitionBy("term_id")))
    # A frequent term is spread over several tasks.
    crowded = prefix.where(~few)
    crowded = crowded.join(crowded.groupBy("term_id").agg(F.max("rest_with").alias("most"), F.count("*").alias("n")), "term_id")
    useful = c("rest_with") * c("most") >= deep - MARGIN
    sides = []
    for i in "12":
        columns = [c("term_id"), c("group").alias(f"group_{i}"), c("weight").alias(f"w{i}"), c("rest_with").alias(f"a{i}")]
        salt = salt_of(c("n"), c("group"), rows_per_task) if i == "1" else F.explode(salts(c("n"), rows_per_task))
        sides.append((calm.where(useful).select(*columns), crowded.where(useful).select(*columns, salt.alias("salt"))))
    (calm_1, crowded_1), (calm_2, crowded_2) = sides
    met = calm_1.join(calm_2, "term_id").unionByName(crowded_1.join(crowded_2, ["term_id", "salt"]).drop("salt"))
    met = met.where((c("group_1") < c("group_2")) & (c("a1") * c("a2") >= deep - MARGIN))
    left = {f"r{i}": F.sqrt(F.greatest(F.min(c(f"a{i}") * c(f"a{i}") - c(f"w{i}") * c(f"w{i}")), F.lit(0.0))) for i in "12"}
    pairs = met.groupBy("group_1", "group_2").agg(
        F.sum(c("w1") * c("w2")).alias("got"), *[x.alias(name) for name, x in left.items()])
    # The rows that pass are a pair's first common terms; the others come after the last of them.
    return pairs.where(c("got") + F.least(c("r1") * c("r2"), deep) >= threshold - MARGIN).select("group_1", "group_2")


def _side_by_side(candidates: DataFrame, rows_per_block: int) -> DataFrame:
    """The candidates with the number of the ``bucket`` that scores them.

    Texts that are all alike mostly have the same smallest partner, so their pairs meet in one bucket, which needs
    each vector once.  Many such texts are dealt into blocks, so a bucket holds few vectors at any size.
    """
    ends = candidates.select(F.inline(F.array(*[F.struct(c(f"group_{i}").alias("group"), c(f"group_{j}").alias("other"))
                                                for i, j in ("12", "21")])))
    homes = ends.groupBy("group").agg(F.least(F.min("other"), c("group")).alias("home"))
    homes = materialize(homes, "homes")
    sized = homes.join(homes.groupBy("home").agg(F.count("*").alias("n")), "home")
    blocks = materialize(sized.select("group", F.xxhash64("home", salt_of(c("n"), c("group"), rows_per_block)).alias("block")), "blocks")
    placed = candidates
    for i in "12":
        placed = placed.join(blocks.select(c("group").alias(f"group_{i}"), c("block").alias(f"block_{i}")), f"group_{i}")
    ordered = F.xxhash64(F.least("block_1", "block_2"), F.greatest("block_1", "block_2"))
    buckets = 2 * candidates.count() // rows_per_block + 1
    return placed.select("group_1", "group_2", F.pmod(ordered, F.lit(buckets)).alias("bucket"))


def similar_groups(terms: DataFrame, threshold: float = TEXT_SIMILARITY,
                   rows_per_task: int = ROWS_PER_TASK, rows_per_block: int = 1000) -> DataFrame:
    """Pairs of distinct texts at or above the threshold: ``group_1 < group_2``."""
    shared = terms.where(c("holders") > 1)
    candidates = materialize(candidate_groups(shared, threshold, rows_per_task), "candidates")
    pairs = materialize(_side_by_side(candidates, rows_per_block), "placed-pairs")
    # Only the vectors of candidates are put together, and each goes once to a bucket.
    wanted = candidates.select(F.explode(F.array("group_1", "group_2")).alias("group")).distinct()
    vectors = shared.join(wanted, "group", "left_semi").groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("v"))
    needed = pairs.select("bucket", F.explode(F.array("group_1", "group_2")).alias("group")).distinct()
    sent = needed.join(vectors, "group").select(c("bucket").alias("at"), "group", c("v.term_id").alias("ids"), c("v.weight").alias("w"))
    key = terms.schema["group"].dataType.simpleString()
    scored = pairs.groupBy("bucket").cogroup(sent.groupBy("at")).applyInArrow(
        _vectors.score_pairs, f"group_1 {key}, group_2 {key}, cosine double")
    return scored.where(c("cosine") >= threshold).select(
        "group_1", "group_2", round_even(c("cosine"), 3).alias("similarity_score"))


def _prepare(docs: DataFrame, doc_id: str, text: Column, stop_words, min_rows: int, threshold: float, name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with the key of their text, the texts, and the shared terms of the texts."""
    members, groups, counted, terms = _prepared(docs, doc_id, text, stop_words, min_rows, threshold, name)
    discard(counted)
    return members, groups, terms


def _prepared(docs: DataFrame, doc_id: str, text: Column, stop_words, min_rows: int, threshold: float,
              name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # ``min_rows``: a smaller table has no pairs at all (a rule of the analysis, not of the plan).
    rows = docs.count()
    # Texts are split into words once; all later steps read the result.  The key is longer than most texts, so it is made again.
    words = _keyed(materialize(text_members(spread(docs, rows), doc_id, text, stop_words, name).drop("text_key"), "words"))
    enough = F.lit(rows >= min_rows)
    total = F.lit(rows)
    groups = text_groups(words.where((F.size("words") > 0) & enough))
    # A term that only one text holds counts for its length, then is done.  Written, since two steps read it.
    # From there on two hashes of 96 bits together stand for the term: they are shorter on their way, but not at rest.
    counted = materialize(count_terms(groups).drop("hash"), "term-counts").withColumns(
        {"hash": F.xxhash64("term"), "term": F.hash("term")})
    # What remains after a term matters in the prefix alone.
    deep = threshold * DEPTH - MARGIN
    in_prefix = c("rest_with") >= deep
    shared = shared_terms(counted)
    # Weights before division are few numbers, and a bound that is rounded up (by a bit of a float) stays one.
    bound = F.when(in_prefix, c("rest_with") * (1 + 2 ** -23)).cast("float").alias("rest_with")
    terms = materialize(shared_vectors(counted, shared, total, deep - MARGIN).select(
        "group", "term_id", "holders", "raw", "size", bound), "tfidf").select(
        "group", "term_id", "holders", (c("raw") / c("size")).alias("weight"), c("rest_with").cast("double").alias("rest_with"))
    discard(shared)
    return words.drop("words"), groups.select("text_key", "group", "copies"), counted, terms


def similar_texts(docs: DataFrame, doc_id: str, text: Column, threshold: float = TEXT_SIMILARITY,
                  stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS),
                  min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """Similar pairs of distinct texts with the copies on each side.

    Linear in the copies: a text used by a million projects is one row
    ``(group, group, copies, copies, 1.0)``, not a million squared.
    """
    _, groups, terms = _prepare(docs, doc_id, text, stop_words, min_rows, threshold)
    a = groups.select(c("group").alias("group_1"), c("copies").alias("copies_1"))
    b = groups.select(c("group").alias("group_2"), c("copies").alias("copies_2"))
    between = similar_groups(terms, threshold).join(a, "group_1").join(b, "group_2")
    within = groups.where(c("copies") > 1).select(
        c("group").alias("group_1"), c("group").alias("group_2"), c("copies").alias("copies_1"),
        c("copies").alias("copies_2"), F.lit(1.0).alias("similarity_score"))
    return between.select(*within.columns).unionByName(within)


def _tasks(loads: DataFrame, load: str, most: int) -> int:
    return loads.sparkSession.sparkContext.defaultParallelism + 2 * ((loads.agg(F.sum(load)).first()[0] or 0) // most)


def duplicate_pairs(docs: DataFrame, doc_id: str = "project_id", text: Column | None = None,
                    name: str | None = None, threshold: float = TEXT_SIMILARITY,
                    stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS),
                    rows_per_task: int = ROWS_PER_TASK, min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """Every similar pair of projects, smaller id first.

    This listing is as large as its answer; a text with m copies has
    m(m-1)/2 pairs.  Scores use ``duplicate_risk`` and reports
    ``similar_texts``, which stay linear.  Large groups are spread by salt,
    and the tasks are as many as the pairs ask for: ``rows_per_task`` times
    ``PAIRS_OF_A_ROW`` pairs each, whatever the rows behind them weigh.
    """
    members, groups, terms = _prepare(docs, doc_id, project_text() if text is None else text, stop_words, min_rows, threshold, name)
    groups = materialize(groups, "text-groups")
    row = F.struct(c("id"), *[c(x) for x in members.columns if x == "name"])
    self_pairs = groups.where(c("copies") > 1).select(
        c("group").alias("group_1"), c("group").alias("group_2"), F.lit(1.0).alias("similarity_score"))
    links = materialize(similar_groups(terms, threshold, rows_per_task).unionByName(self_pairs)
                        .join(groups.select(c("group").alias("group_1"), c("copies").alias("n_1")), "group_1")
                        .join(groups.select(c("group").alias("group_2"), c("copies").alias("n_2")), "group_2"), "links")
    # The first join meets the members of a group once for each link, the second makes its pairs.
    most = rows_per_task * PAIRS_OF_A_ROW
    firsts = materialize(links.groupBy("group_1").agg(F.sum("n_1").alias("load_1")), "first-loads")
    seconds = materialize(links.groupBy("group_2").agg(F.sum(c("n_1") * c("n_2")).alias("load_2")), "second-loads")
    sized = members.join(groups, "text_key")
    one = sized.withColumnRenamed("group", "group_1").join(firsts, "group_1").select(
        "group_1", row.alias("a"), salt_of(c("load_1"), c("id"), most).alias("salt_1"))
    two = sized.withColumnRenamed("group", "group_2").join(seconds, "group_2").select(
        "group_2", row.alias("b"), F.explode(salts(c("load_2"), most)).alias("salt_2"))
    spread_links = links.join(firsts, "group_1").join(seconds, "group_2").withColumn(
        "salt_1", F.explode(salts(c("load_1"), most))).drop("load_1", "n_1", "n_2")
    # A number of partitions that is asked for is kept; by their bytes, many heavy keys would share a task.
    tasks = {i: _tasks(table, f"load_{i}", most) for i, table in (("1", firsts), ("2", seconds))}

    def dealt(rows: DataFrame, i: str) -> DataFrame:
        return rows.repartition(tasks[i], f"group_{i}", f"salt_{i}")

    ones = (dealt(spread_links, "1").join(dealt(one, "1"), ["group_1", "salt_1"])
            .withColumn("salt_2", salt_of(c("load_2"), c("a.id"), most)).drop("load_2"))
    met = dealt(ones, "2").join(dealt(two, "2"), ["group_2", "salt_2"])
    in_order = c("a.id") <= c("b.id")
    pairs = met.where((c("group_1") != c("group_2")) | (c("a.id") < c("b.id"))).select(
        F.when(in_order, c("a")).otherwise(c("b")).alias("a"), F.when(in_order, c("b")).otherwise(c("a")).alias("b"), "similarity_score")
    names = [] if name is None else [c("a.name").alias(f"{name}_1"), c("b.name").alias(f"{name}_2")]
    return pairs.select(c("a.id").alias(f"{doc_id}_1"), c("b.id").alias(f"{doc_id}_2"), "similarity_score", *names)


def most_similar_pairs(docs: DataFrame, doc_id: str = "project_id", text: Column | None = None, k: int = 20,
                       threshold: float = TEXT_SIMILARITY,
                       stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS),
                       min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """The first ``k`` of ``duplicate_pairs`` by similarity, then ids, without the listing.

    A group is named by its smallest id, so the first pair of two groups is
    that of their names, and the k best pairs of groups hold the k first
    pairs.  Of a group, the k + 1 smallest ids suffice.
    """
    members, groups, terms = _prepare(docs, doc_id, project_text() if text is None else text, stop_words, min_rows, threshold)
    between = (similar_groups(terms, threshold)
               .select("similarity_score", F.least("group_1", "group_2").alias("group_1"),
                       F.greatest("group_1", "group_2").alias("group_2"))
               .orderBy(c("similarity_score").desc(), "group_1", "group_2").limit(k))
    within = (groups.where(c("copies") > 1).orderBy("group").limit(k)
              .select(F.lit(1.0).alias("similarity_score"), c("group").alias("group_1"), c("group").alias("group_2")))
    picked = materialize(between.unionByName(within), "similar-groups")      # at most 2 k rows
    wanted = picked.select(F.explode(F.array("group_1", "group_2")).alias("group")).distinct()
    keys = groups.join(F.broadcast(wanted), "group").select("text_key", "group")
    # Ranking with a constant limit is cut in each task before the shuffle, so a crowded text sends little.
    by_id = Window.partitionBy("group").orderBy("id")
    heads = materialize(members.join(F.broadcast(keys), "text_key").select("group", "id")
                        .withColumn("place", F.row_number().over(by_id)).where(c("place") <= k + 1), "group-heads")
    met = picked
    for side in ("1", "2"):
        met = met.join(heads.select(c("group").alias(f"group_{side}"), c("id").alias(f"id_{side}")), f"group_{side}")
    a, b = c("id_1"), c("id_2")
    return (met.where((c("group_1") != c("group_2")) | (a < b))
            .select(F.least(a, b).alias(f"{doc_id}_1"), F.greatest(a, b).alias(f"{doc_id}_2"), "similarity_score")
            .orderBy(c("similarity_score").desc(), f"{doc_id}_1", f"{doc_id}_2").limit(k))


def duplicate_risk(projects: DataFrame, doc_id: str = "project_id", text: Column | None = None,
                   threshold: float = TEXT_SIMILARITY,
                   stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS),
                   min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """Best match of each project.  A copy scores 1.0 from the group size
    alone, and the best partner is found per distinct text, so no pair of
    copies is ever formed."""
    members, groups, terms = _prepare(projects, doc_id, project_text() if text is None else text, stop_words, min_rows, threshold)
    best = _best_partners(terms, threshold)
    # by text: a copy scores 1.0, any other text its best partner
    by_text = groups.join(best, "group", "left").select(
        "text_key", F.when(c("copies") > 1, F.lit(1.0)).otherwise(c("best")).alias("best"))
    return _scored(lookup_join(members, by_text, "text_key", "id", how="left"), doc_id)


def _best_partners(terms: DataFrame, threshold: float) -> DataFrame:
    # One row per side from a single pass over the pairs.
    sides = similar_groups(terms, threshold).select(
        F.explode(F.array("group_1", "group_2")).alias("group"), "similarity_score")
    return sides.groupBy("group").agg(F.max("similarity_score").alias("best"))


def _scored(rows: DataFrame, doc_id: str) -> DataFrame:
    match = F.coalesce(c("best"), F.lit(0.0))
    return rows.select(
        c("id").alias(doc_id), (match > 0).alias("duplicate_anomaly"),
        round_even(F.least(match * 100, F.lit(100.0)), 2).alias("duplicate_risk_score"),
        match.alias("duplicate_match_score"))


def duplicate_hits(projects: DataFrame, doc_id: str = "project_id", text: Column | None = None,
                   threshold: float = TEXT_SIMILARITY,
                   stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS),
                   min_rows: int = MIN_ROWS_FOR_PAIRS) -> DataFrame:
    """The rows of ``duplicate_risk`` that have a match.

    A text without copies bears the id of its only project, so its match needs no join; projects are looked up
    for copied texts alone, whose keys are written first and, where they are few, sent to the projects.
    """
    members, _, counted, terms = _prepared(projects, doc_id, project_text() if text is None else text, stop_words, min_rows, threshold)
    copied = materialize(counted.where(c("copied").isNotNull()).select(c("copied").alias("text_key"), "group").distinct(),
                         "copied-texts")
    discard(counted)
    copies = members.join(copied.select("text_key"), "text_key", "left_semi").select("id", F.lit(1.0).alias("best"))
    near = (_best_partners(terms, threshold).join(copied.select("group").distinct(), "group", "left_anti")
            .select(c("group").alias("id"), "best"))
    return _scored(copies.unionByName(near), doc_id)
