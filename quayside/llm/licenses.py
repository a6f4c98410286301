"""License scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window as W

from quayside.llm.common import body, content_key
from quayside.llm.license_texts import BASE, SENTENCES, TEXTS
from quayside.llm.line_dedup import LOWER, UPPER
from quayside.session import settle

# Words of the grams that short and long templates are searched by; a template is long from this many words.
SHORT_GRAM, LONG_GRAM, LONG_FROM = 2, 4, 12
# Share of a template's grams that must stand in order: one changed word takes two grams of a
# short template, four of a long one.
SHORT_NEEDED, LONG_NEEDED = 0.84, 0.66
# A span may gain or lose a word for so many words of its template, and this many at most.
WORDS_PER_SHIFT, MOST_SHIFT = 8, 8

_SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_ROW = ["doc_id", "t1", "t2"]
TEMPLATE_SCHEMA = "template int, label string, is_base boolean, gram int, shift int, needed double, text string"


def words(text: Column) -> Column:
    """Words of letters, digits and all characters beyond ASCII; only A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), _SEPARATOR, -1), "")


def template_table(spark: SparkSession, texts: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Templates ``{text: label}`` as a table; ``base`` phrases count only word for word.

    A caller with many templates builds the same columns from files: ``template`` (a number),
    ``label``, ``is_base``, ``gram`` (words per gram), ``shift`` (words a span may gain or
    lose), ``needed`` (share of grams) and ``text``.
    """
    texts = {**SENTENCES, **TEXTS} if texts is None else texts
    rows = []
    for phrase, label, is_base in [*((p, x, True) for p, x in (BASE if base is None else base).items()), *((p, x, False) for p, x in texts.items())]:
        n = len([w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in phrase).split() if w])
        long = n >= LONG_FROM and not is_base
        rows.append((len(rows), label, is_base, LONG_GRAM if long else SHORT_GRAM, 0 if is_base else min(n // WORDS_PER_SHIFT, MOST_SHIFT),
                     1.0 if is_base else LONG_NEEDED if long else SHORT_NEEDED, phrase))
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def _rolling(words_of: Column, size: int) -> Column:
    """All runs of ``size`` words, each with where it starts."""
    shifted = [F.slice(words_of, F.lit(i + 1), F.greatest(F.size(words_of) - size + 1, F.lit(0))).alias(f"w{i + 1}") for i in range(size)]
    return F.arrays_zip(*shifted)


def template_grams(templates: DataFrame) -> DataFrame:
    """A row per gram of each template: where it stands, its hash, and its words joined by spaces."""
    parts = templates.withColumn("words", words(F.col("text")))
    places = F.expr("transform(sequence(0, greatest(size(words) - gram, 0)), i -> struct(i as at, array_join(slice(words, i + 1, gram), ' ') as said))")
    grams = parts.filter(F.size("words") >= F.col("gram")).withColumn("grams", F.size("words") - F.col("gram") + 1)
    return grams.select("template", "label", "is_base", "gram", "shift", "needed", "grams", F.inline(places)) \
        .withColumn("gram_hash", F.xxhash64("said"))


def _longest_chain(votes: Column, grams: Column) -> Column:
    """The most votes ``(pos, at)`` that stand in the text in the order of the template, from votes sorted by place.

    ``best[at]`` is the longest chain that ends with the gram ``at``; a vote makes it one more
    than the best chain of an earlier gram. Votes of one place come latest gram first, so
    that none follows another of its own place.
    """
    def add(best: Column, vote: Column) -> Column:
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), vote["at"])), F.lit(0))
        return F.transform(best, lambda x, i: F.when(i == vote["at"], F.greatest(x, before + 1)).otherwise(x))
    ordered = F.array_sort(F.transform(votes, lambda v: F.struct(v["pos"].alias("pos"), (-v["at"]).alias("late"), v["at"].alias("at"))))
    return F.aggregate(ordered, F.array_repeat(F.lit(0), grams), add, F.array_max)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """``(doc_id, t1, t2, label, is_base, first_word, end_word, score, verified)``: a row per span that looks like a template.

    All rolling grams of a text are hashed and joined with those of the templates; equal
    hashes are checked by their words. A match at word ``p`` of a text and gram ``q`` of a
    template votes for the diagonal ``p - q``, and votes are summed per diagonal. A diagonal
    and those up to ``shift`` words after it, which inserted words cause, are one span; so a
    span is never longer than its template and the shift. It is verified when the longest
    run of grams that the text has in the template's order reaches the share ``needed``;
    base phrases need all their words one after the other. ``score`` is that share.

    Only matches are shuffled. A text that repeats a template many times has a span for each.
    """
    templates = template_table(docs.sparkSession) if templates is None else templates
    grams = settle(template_grams(templates), "grams")  # written, so that the planner knows how few they are
    text = body(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), *(h.alias(n) for h, n in zip(content_key(text), ("t1", "t2"), strict=True)),
                        words(text).alias("words"))
    votes = None
    # the sizes of grams that occur, two unless a caller brings others
    for size in sorted(r[0] for r in templates.select("gram").distinct().collect()):
        said = F.concat_ws(" ", *(F.col(f"run.w{i + 1}") for i in range(size)))
        rolled = texts.select(*_ROW, F.posexplode(_rolling(F.col("words"), size)).alias("pos", "run")) \
            .select(*_ROW, "pos", said.alias("run_said")).withColumn("run_hash", F.xxhash64("run_said"))
        mine = rolled.join(grams.filter(F.col("gram") == size), (F.col("run_hash") == F.col("gram_hash")) & (F.col("run_said") == F.col("said")))
        mine = mine.select(*_ROW, "pos", "template", "label", "is_base", "gram", "shift", "needed", "grams", "at")
        votes = mine if votes is None else votes.unionAll(mine)
    if votes is None:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema[id_col], *T.StructType.fromDDL(
            "t1 long, t2 long, label string, is_base boolean, first_word long, end_word long, score double, verified boolean")]))
    template = ["template", "label", "is_base", "gram", "shift", "needed", "grams"]
    diagonals = votes.groupBy(*_ROW, *template, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("hits"))
    # votes of a diagonal and of the few after it
    near = W.partitionBy(*_ROW, "template").orderBy("diagonal").rangeBetween(0, MOST_SHIFT)
    spans = diagonals.withColumn("near", F.collect_list(F.struct("diagonal", "hits")).over(near))
    place = lambda d: F.transform(d["hits"], lambda at: F.struct((d["diagonal"] + at).alias("pos"), at.alias("at")))
    inside = F.filter("near", lambda d: d["diagonal"] - F.col("diagonal") <= F.col("shift"))
    spans = spans.withColumn("votes", F.flatten(F.transform(inside, place)))
    score = _longest_chain(F.col("votes"), F.col("grams")) / F.col("grams")
    starts = F.transform("votes", lambda v: v["pos"])
    return spans.select(*_ROW, "label", "is_base", F.array_min(starts).cast("long").alias("first_word"),
                        (F.array_max(starts) + F.col("gram")).cast("long").alias("end_word"), score.alias("score"), "needed") \
        .withColumn("verified", F.col("score") >= F.col("needed")).drop("needed")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start; ``labels`` also has those of verified spans; ``score`` is the
    largest share of a template that any span has in order, 0 without spans. Null and empty
    texts have no words; null ids are told apart by their text; repeated rows get the same
    answer; an empty table gives an empty result; other columns are not read.
    """
    spans = license_spans(docs, id_col, text_col, templates)
    base = F.col("is_base") & F.col("verified")
    found = spans.groupBy(*_ROW).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label"))))).alias("labels"),
        F.max("score").alias("score")).withColumnsRenamed({c: f"f_{c}" for c in _ROW})
    text = body(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(h.alias(n) for h, n in zip(content_key(text), ("t1", "t2"), strict=True)),
                       F.size(words(text)).cast("long").alias("n_words"))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in _ROW))
    return rows.join(found, match, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
