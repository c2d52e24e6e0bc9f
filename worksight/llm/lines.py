"""Remove multi-line passages that repeat anywhere in the corpus.

Every window of ``min_lines`` lines takes part, so each line of a passage of
that length or more is in a window that repeats with it, wherever the passage
begins and ends.  Content-defined chunks take part as well: a line ends one
where a hash of the last lines' hashes is divisible by ``divisor``, so an
insertion moves boundaries only near it.  What occurred before, in the order
of id and line, goes.  Equal hashes count after the bytes were compared.  Only
DataFrame functions are used.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.materialize import materialize

c = F.col


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _starts(window: int, divisor: int) -> Column:
    """The first line of each chunk, over the column ``hashes``."""
    def begins(i):
        first = F.greatest(i - window, F.lit(0))
        return (i == 0) | (F.pmod(F.xxhash64(F.slice("hashes", first + 1, i - first)), F.lit(divisor)) == 0)
    return F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), begins)


def _passages(min_lines: int) -> Column:
    """start, n and hash of each passage that takes part, over ``hashes``, ``solid`` (is a line not blank) and ``starts``.

    Beside the windows and the longer chunks these are the stretches of blank
    lines, with the lines around them, that windows do not span.
    """
    n, full = F.size("hashes"), F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.get("solid", i))
    span = lambda s, m: F.struct(s.alias("start"), m.alias("n"))
    windows = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda s: s + min_lines <= n), lambda s: span(s, F.lit(min_lines)))
    chunks = F.transform("starts", lambda s, i: span(s, F.coalesce(F.get("starts", i + 1), n) - s))
    gaps = F.zip_with(full, F.slice(full, 2, n), lambda s, t: span(s, F.coalesce(t, s) - s + 1))
    every = F.concat(windows, F.filter(chunks, lambda x: x["n"] > min_lines), F.filter(gaps, lambda x: x["n"] > 2 * min_lines))
    some = F.filter(every, lambda x: F.exists(F.slice("solid", x["start"] + 1, x["n"]), lambda y: y))
    return F.transform(some, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"),
                                                F.xxhash64(F.slice("hashes", x["start"] + 1, x["n"])).alias("h")))


def _chunk_text(start: Column, n: Column) -> Column:
    return F.array_join(F.slice("lines", start + 1, n), "\n")


def deduplicate_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 2, divisor: int = 3,
                      min_lines: int = 2) -> DataFrame:
    """The columns of ``docs``, with the text cut, plus n_lines and n_removed.

    A line goes if it is in a passage of at least ``min_lines`` lines, not all
    blank, that occurred before, by (id, hash of the text, line), a null id
    first, and does not overlap that occurrence.  So each line that goes has an
    equal one that stays.  Of several blank lines at an end of a passage, those
    beyond ``min_lines - 1`` go only with a chunk.  Rows that are equal in id
    and text are one document.  A null text stays null, an empty one has one
    line; an empty table gives an empty one.  Columns named n_lines and
    n_removed are replaced.  ``docs`` is read three times.
    """
    names = [x for x in docs.columns if x not in ("n_lines", "n_removed")]
    marked = docs.select(F.struct(*[c(f"`{x}`") for x in names]).alias("row"), c(f"`{id}`").alias("id"),
                         F.xxhash64(f"`{text}`").alias("mark"))
    lines = lines_of(c("row")[text]).alias("lines")
    cut = (marked.select("id", "mark", lines)
           .select("id", "mark", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
                   F.transform("lines", lambda x: x.rlike(r"\S")).alias("solid"))
           .select("id", "mark", "hashes", "solid", _starts(window, divisor).alias("starts"))
           .select("id", "mark", F.explode(_passages(min_lines)).alias("at")))
    chunks = materialize(cut.select("id", "mark", "at.*"), "chunks")
    again = chunks.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    seen = materialize(chunks.join(again, "h"), "chunks-seen")

    # Bytes: equal hashes with different texts are told apart by grouping on the text itself.
    lists = seen.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n", "h")).alias("at"))
    # Both lists grow with the corpus, so these joins are never broadcast.
    key = marked.select(c("id").alias("_id"), c("mark").alias("_mark"), c("row")[text].alias("text"))
    bodies = (key.join(lists.hint("merge"), c("_id").eqNullSafe(c("id")) & (c("_mark") == c("mark")))
              .select("id", "mark", lines_of(c("text")).alias("lines"), F.explode("at").alias("at"))
              .select("id", "mark", "at.*", _chunk_text(c("at.start"), c("at.n")).alias("body")))
    texts = materialize(bodies.groupBy("h", "body").agg(F.min(F.struct("id", "mark", "start")).alias("first")), "chunk-texts")
    unique = texts.groupBy("h").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    same = c("id").eqNullSafe(c("first.id")) & (c("mark") == c("first.mark"))
    later = ~same | (c("start") >= c("first.start") + c("n"))
    removed = seen.join(unique.where("texts = 1"), "h").where(later).select("id", "mark", "start", "n")
    mixed = unique.where("texts > 1").select("h")
    if mixed.limit(1).count():
        both = bodies.join(mixed, "h").join(texts.select("h", "body", "first"), ["h", "body"]).where(later)
        removed = removed.union(both.select("id", "mark", "start", "n"))
    gone = removed.groupBy(c("id").alias("_id"), c("mark").alias("_mark")).agg(F.collect_set(F.struct("start", "n")).alias("gone"))

    joined = marked.join(gone.hint("merge"), c("_id").eqNullSafe(c("id")) & (c("_mark") == c("mark")), "left").select(
        "row", lines, F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))).alias("gone"))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    body = F.when(c("gone").isNull(), c("row")[text]).otherwise(F.array_join(stays, "\n"))
    return joined.select(*[body.alias(x) if x == text else c("row")[x].alias(x) for x in names],
                         F.size("lines").cast("long").alias("n_lines"), F.when(c("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
